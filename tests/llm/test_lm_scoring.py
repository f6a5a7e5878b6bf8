import collections
import itertools
import math
import re
import zlib

import numpy as np
from textloom.llm import lm_scoring as M


def test_base_and_model(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()}
    toks = {i: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in docs.items()}
    c = collections.Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    out = M.op4_lm_scoring(spark, sf_dir).toPandas()
    assert len(out) == len(docs)
    for r in out.itertuples():
        ws = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_expectation_maximisation_finds_the_better_estimate():
    cells = np.array([[3, 0.3, 1e-3, 100.0], [3, 0.1, 1e-3, 50.0], [5, 0, 0.1, 80.0], [0, 0, 0, 5.0]])
    w = M.expectation_maximisation(cells, -5.0)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.9 and w[5, 1] > 0.9 and w[0, 2] > 0.9


def test_probabilities_sum_to_at_most_one(spark):
    """All one-word texts and the empty one, each an outcome of its own."""
    rows = [(i, f"a b c d a b {'xyz'[i % 3]}") for i in range(60)]
    asked = [(1000 + i, t) for i, t in enumerate(["", *"abcdxyz", "never", "seen"])]
    out = M.score_documents(spark.createDataFrame(rows + asked * 1, "doc_id long, text string")).toPandas().set_index("doc_id")
    mass = sum(10 ** out.score[i] for i, _ in asked)
    assert 0 < mass <= 1 + 1e-9 and (out.score < 0).all()


def test_scores_match_plain_counts(spark, sf_dir):
    """Counts by dictionaries, weights from every held-out occurrence by itself."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").limit(120)
    part = {r["doc_id"]: r["h"] == 0 for r in df.select("doc_id", F.expr(f"pmod(xxhash64(cast(doc_id AS string), 17), {M.DELETED})").alias("h")).collect()}
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    toks = {i: [None, *re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    main = [i for i in train if not part[i]]

    def counts(ids):
        return collections.Counter(w for i in ids for w in toks[i][1:]), collections.Counter(p for i in ids for p in itertools.pairwise(toks[i]))

    one, two = counts(main)
    n = sum(one.values())
    cells = [(M.context_bucket(np.array([one[a]]))[0], two[a, b] / max(one[a], 1), one[b] / n, 1) for i in train if part[i] for a, b in itertools.pairwise(toks[i])]
    every, pairs = counts(train)
    total, vocab = sum(every.values()), len(every)
    w = M.expectation_maximisation(np.array(cells, float), -math.log10(vocab + 1))
    got = {r["doc_id"]: r["score"] for r in M.score_documents(df).collect()}
    for i, t in toks.items():
        want = 0.0
        for a, b in itertools.pairwise(t):
            k = w[M.context_bucket(np.array([every[a]]))[0]]
            p = k[0] * pairs[a, b] / max(every[a], 1) + k[1] * every[b] / total + k[2] / (vocab + 1)
            want += math.log10(p / (1 - k[0]) if every[a] == 0 and k[0] > 0 else p)
        assert math.isclose(got[i], want, rel_tol=2e-3), (i, got[i], want)


def test_edges(spark, edge_docs, no_docs):
    out = M.score_documents(edge_docs).toPandas()
    assert len(out) == edge_docs.count() and out[out.doc_id == 4].n_tokens.tolist() == [1] and np.isfinite(out.score).all()
    assert M.score_documents(no_docs).count() == 0
    only_held = edge_docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1")
    assert np.isfinite(M.score_documents(only_held).toPandas().score).all()
