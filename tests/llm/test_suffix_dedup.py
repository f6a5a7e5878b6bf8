import collections
import hashlib
import random

import numpy as np
from textloom.llm import suffix_dedup as S


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        cut = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                cut[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(int), [0]])) == 1)
        out.append((len(r), int(cut.sum()), len(edges), hashlib.sha256(np.frombuffer(r, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_cover():
    assert {(a - b) % S.COVER_MOD for a in S.COVER for b in S.COVER} == set(range(S.COVER_MOD))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [line(n) for n in (150, 200, 201, 260, 700)]
    texts = []
    for i in range(60):
        parts = [line(rng.randrange(0, 300)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared)[: rng.randrange(100, 701)])
        texts.append("".join(parts))
    texts += ["a" * 199, "a" * 200, "b" * 201, "b" * 450, texts[3], texts[3], None, "", "é" * 101]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
    assert rows(S.repeated_spans(df)) == want


def test_suffixes_are_sorted_and_ties_resolved():
    rng = random.Random(1)
    for trial in range(40):
        base = ["".join(rng.choice("ab" if trial % 2 else "abcdef") for _ in range(rng.randrange(60, 300))) for _ in range(3)]
        texts, depth = [], 40
        for _ in range(rng.choice([1, 5, 60, 300])):
            b = rng.choice(base)
            k = rng.randrange(len(b) - 45)
            t = list(b[k : k + rng.randrange(40, 90)])
            t[rng.randrange(len(t))] = rng.choice("abz")
            if len(t) >= depth:
                texts.append("".join(t).encode())
        if not texts:
            continue
        counts = [len(t) - depth + 1 for t in texts]
        seen = collections.Counter(t[i : i + depth] for t, m in zip(texts, counts, strict=True) for i in range(m))
        for t, m, found in zip(texts, counts, S.repeated_starts(texts, counts, depth), strict=True):
            assert found.tolist() == [seen[t[i : i + depth]] > 1 for i in range(m)]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        order, _ = S.sorted_starts(buf, np.arange(len(buf) - depth), depth)
        strings = [buf[i : i + depth].tobytes() for i in order.tolist()]
        assert strings == sorted(strings)


def test_pieces_and_anchors(monkeypatch):
    """Every start of a text is in exactly one window, with its anchor in reach, however the text is cut."""
    rng = random.Random(2)
    raws = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 199, 200, 201, 950, 3000)] + [b" " * 1500]
    for slice_ in (350, 10**6):
        monkeypatch.setattr(S, "SLICE", slice_)
        starts = collections.Counter()
        for text, base, parts in S.pieces(raws, 200):
            buf, piece, lo, hi, anchor = S.anchored(parts, 200)
            off = np.cumsum([0, *map(len, parts[:-1])])
            for p, a, b, x in zip(piece, lo, hi, anchor, strict=True):
                assert a <= b <= x <= a + 132
                starts.update((text[p], int(i - off[p] + base[p])) for i in range(a, b + 1))
        assert starts == {(t, i): 1 for t, r in enumerate(raws) for i in range(len(r) - 199)}


def test_long_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    passage = text[200_000:230_000]
    docs = [(2**53 + 1, text), (None, " " * 300_000), (3, "x" + passage + "y" * 150), (4, text[:150] + "!" + text[399_900:400_500])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert rows(S.repeated_spans(df)) == sorted(((d, *x) for (d, _), x in zip(docs, brute([t for _, t in docs]), strict=True)), key=str)


def test_edges(spark, edge_docs, no_docs, edge_rows):
    want = sorted(((r[0], *x) for r, x in zip(edge_rows, brute([r[1] for r in edge_rows]), strict=True)), key=str)
    assert rows(S.repeated_spans(edge_docs)) == want
    assert S.repeated_spans(no_docs).count() == 0


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()]
    assert rows(S.op10_suffix_dedup(spark, sf_dir)) == sorted(((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs]), strict=True)), key=str)
