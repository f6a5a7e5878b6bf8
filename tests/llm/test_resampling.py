import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tests.compare import same
from textloom.llm import resampling as R


def plain(rows, target, percent=10, least=20, seed=2024, buckets=10_000, longest=1):
    """The contract, one row at a time."""
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(az))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in runs)

    own = [features(t) for _, t in rows]
    s, t = sum((f for _, f in own), Counter()), sum((features(x)[1] for x in target), Counter())
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def test_matches_sql(spark, duck, sf_dir):
    same(R.op11_resampling(spark, sf_dir), duck.execute(R.ORACLES["op11_resampling"]).fetchdf())


@pytest.mark.parametrize(("percent", "least", "buckets", "longest"), [(10, 20, 10_000, 1), (100, 0, 97, 1), (50, 2, 10_000, 3)])
def test_edges_match_plain_python(spark, edge_docs, edge_rows, percent, least, buckets, longest):
    target = [r[1] for r in edge_rows[:1]] + [None, "", "ONE two; three"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = R.resample(edge_docs, bench, percent, least, buckets=buckets, longest=longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in out.collect()) == plain([r[:2] for r in edge_rows], target, percent, least, buckets=buckets, longest=longest)


def test_slices_cells_and_long_texts(spark, monkeypatch):
    """Texts cut into slices, runs across their edges, and parts split into many cells."""
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(i % 90))) for i in range(300)] + [(999, "Ab,c " * 9_000 + "x" * 5_000), (998, "é" * 3_000)]
    known = R._Buckets(1_000)
    want = [R._counted(t.encode(), known, 3) for _, t in rows]
    with monkeypatch.context() as m:
        m.setattr(R, "SLICE", 97)
        for (_, t), (n, at, c) in zip(rows, want, strict=True):
            m_n, m_at, m_c = R._counted(t.encode(), known, 3)
            assert (m_n, m_at.tolist(), m_c.tolist()) == (n, at.tolist(), c.tolist())
        m.setattr(R, "CELL_BATCHES", 1)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13, "doc_id")
        out = R.resample(docs, spark.createDataFrame([("w1 w2 w7 ab",)], "text string"))
        assert Counter(tuple(r) for r in out.collect()) == plain(rows, ["w1 w2 w7 ab"])


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "text string")
    assert R.resample(no_docs, none).count() == 0
    assert R.resample(edge_docs, none).count() == edge_docs.count()
