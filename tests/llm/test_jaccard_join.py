import random
import re

import numpy as np
from textloom.llm import jaccard_join as J

from tests.llm.conftest import sentence


def brute(docs, k, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    link = J.Linked(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                link.join(i, j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[link.find(i)] = min(low.get(link.find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(link.find(i))) for i, (d, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(seed=5):
    rng = random.Random(seed)
    docs, i = [], 0
    for g in range(25):
        base = sentence(rng.randrange(3, 120), rng.choice([3, 5, 7]), g).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
            docs.append((i, " ".join(w)))
            i += 1
    return docs


def test_matches_brute_force(spark):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80), (2, 50)):
        assert rows(J.near_components(df, k, percent)) == brute(docs, k, percent)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    docs = near_copies(9)
    assert rows(J.near_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85)) == brute(docs, 4, 85)


def test_trees(monkeypatch):
    rng = np.random.default_rng(0)
    for own in (1 << 15, 0):
        monkeypatch.setattr(J, "OWN_BITS", own)
        for _ in range(25):
            base = [rng.choice(10**6, rng.integers(1, 60), replace=False).astype(np.uint64) for _ in range(5)]
            sets = [np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.2], rng.integers(10**7, 10**8, 1 + rng.integers(0, 3)).astype(np.uint64)])) for b in (base[rng.integers(5)] for _ in range(rng.integers(1, 50)))]
            n = np.array([len(s) for s in sets])
            got, want = J.Linked(len(sets)), J.Linked(len(sets))
            for a, b in J.tree_links(sets, n, 80):
                got.join(a, b)
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 80 * (n[i] + n[j] - both):
                        want.join(i, j)
            assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_edges(spark, edge_docs, no_docs, edge_rows):
    assert rows(J.near_components(edge_docs, 4, 85)) == brute([(r[0], r[1]) for r in edge_rows], 4, 85)
    assert J.near_components(no_docs).count() == 0
    kept = J.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 4, 5, 6, 9} <= set(ids) and 2 not in ids and 3 not in ids and ids.count(7) == 1


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()]
    assert rows(J.op9_jaccard_join(spark, sf_dir)) == brute(docs, 4, 85)
