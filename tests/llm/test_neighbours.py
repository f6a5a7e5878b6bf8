import numpy as np
from textloom.llm import neighbours as N


def brute(vecs, k):
    out = {}
    ok = {i: np.array(v, float) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, a in ok.items():
        if q % 50 == 0:
            near = sorted((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in ok.items() if i != q and len(b) == len(a))
            out[q] = near[:k]
    return out


def test_recall_and_scores(spark, sf_dir):
    vecs = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(sf_dir + "/embeddings.parquet").collect()]
    want = brute(vecs, 5)
    rows = N.op7_neighbours(spark, sf_dir).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    assert np.mean([len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) / 5 for q in want]) >= 0.9
    table = {i: np.array(v) for i, v in vecs}
    for q, near in got.items():
        assert [r for r, _, _ in sorted(near)] == [1, 2, 3, 4, 5]
        for _, i, s in near:
            a, b = table[q], table[i]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def clustered(n, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    return [(i, (centres[rng.integers(40)] + 0.4 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_recall_over_many_leaves_and_rounds(spark, monkeypatch):
    """Leaves of 16 in parts of 8: the queries need several rounds, and leave leaves out."""
    monkeypatch.setattr(N, "PART_ROWS", 8)
    vecs = clustered(4000)
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    want = brute(vecs, 5)
    got = {}
    for r in N.nearest(df, lambda i: i % 50 == 0, leaf_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(got[q]) == 5 for q in want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for _, i in want[q]}) / 5 for q in want])
    assert recall >= 0.9


def test_whole_numbers_beyond_doubles_and_repeated_ids(spark):
    big = 2**53 + 1
    rows = [(0, [1.0, 0.0]), (big, [1.0, 0.1]), (big, [1.0, 0.01]), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in N.nearest(df, lambda i: i % 50 == 0).collect())
    assert out == [(1, big, 0.99995), (2, 7, 0.0)]


def test_chi_square():
    assert abs(N.chi_square_cdf(np.array([7.344]), 8)[0] - 0.5) < 1e-3 and abs(N.chi_square_cdf(np.array([15.507]), 8)[0] - 0.95) < 1e-3


def test_edges(spark):
    same_v = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, same_v), (50, same_v), (100, None), (150, [0.0] * 4), (200, [1.0, None, 2.0, 3.0]), (250, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (350, [1.0, 2.0]), (None, same_v), (400, []), (0, same_v)]
    rows += [(i, same_v) for i in range(1, 30)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, h int, block int, ids int")
    got = {}
    for r in N.nearest(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert got == {0: {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}, 50: {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}}
    assert N.nearest(df.where("1 = 0"), lambda i: i % 50 == 0).count() == 0
