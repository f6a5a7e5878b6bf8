import random

import numpy as np
from textloom.llm import shared as S
from textloom.llm.jaccard_join import Linked


def test_components_match_union_find(spark):
    rng = random.Random(7)
    for n, m in ((40, 25), (60, 80), (30, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 160)] if m else [])
        got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        link = Linked(200)
        for a, b in pairs:
            link.join(a, b)
        low = {i: link.find(i) for i in range(200)}
        assert got == {i: low[i] for i in range(200) if low[i] != i}


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    """Several tasks contract, and star rounds join what they leave."""
    rng = random.Random(11)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    link = Linked(400)
    for a, b in pairs:
        link.join(a, b)
    want = {i: link.find(i) for i in range(400) if link.find(i) != i}
    for edges, hot in ((7, 1_000), (40, 3)):
        monkeypatch.setattr(S, "CONTRACT_EDGES", edges)
        monkeypatch.setattr(S, "HOT_ROWS", hot)
        df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long").repartition(6)
        assert {r["node"]: r["component"] for r in S.components(df).collect()} == want


def test_span_hashes_depend_on_bytes_only():
    a = np.frombuffer(b"xxabcabcyy abc", np.uint8)
    h = S.span_hashes(a, np.array([2, 5, 11, 0]), np.array([5, 8, 14, 2]))
    assert h[0] == h[1] == h[2] != h[3]
    assert S.span_hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))[0] == h[0]


def test_words():
    buf, s, e, doc = S.words_of(["The CAT", None, " é\tB ", ""])
    assert [(buf[a:b].tobytes().decode(), d) for a, b, d in zip(s, e, doc, strict=True)] == [("the", 0), ("cat", 0), ("é", 2), ("b", 2)]


def test_slices_cover():
    assert list(S.slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)] and list(S.slices([], 10)) == []
