import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from textloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(a is not None and math.isfinite(a) for a in v)]
    if not kept:
        return Counter()
    exact = lambda a: int(a) * scale if abs(a) > 2**53 else math.floor(a * scale)
    dim = len(kept[0][1])
    x = [[[exact(a) for a in v[dim * p // parts : dim * (p + 1) // parts]] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0))
    books = [[x[r][p] for r in order[:entries]] for p in range(parts)]

    def assign():
        sq = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
        return [[min((sq(row[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for row in x]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            by = defaultdict(list)
            for row, a in zip(x, own, strict=True):
                by[a[p][1]].append(row[p])
            for e, members in by.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    own = assign()
    label = Counter()
    for (_, _, lab), a in zip(kept, own, strict=True):
        label[lab] += sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(a) for b in books for c in b for a in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), label[lab], sha) for (i, _, lab), a in zip(kept, own, strict=True))


def told(df, **options):
    return Counter(tuple(r) for r in V.compress(df, **options)[0].collect())


def test_matches_sql(spark, duck, sf_dir):
    same(V.op13_vector_codes(spark, sf_dir), duck.execute(V.ORACLES["op13_vector_codes"]).fetchdf())


@pytest.mark.parametrize(("dim", "options"), [(8, {}), (6, {"entries": 3}), (18, {"parts": 9, "entries": 5, "rounds": 2}), (2, {"entries": 4})])
def test_edges_match_plain_python(spark, dim, options):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(0, 0.3, dim).round(3).tolist(), ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(100 + i, [0.25] * dim, "a") for i in range(80)] + [rows[3], (None, [0.5] * dim, None)]  # one part with most rows
    rows += [(1000, None, "a"), (-1, [None] + [0.0] * (dim - 1), "a"), (-2, [math.nan] * dim, "b"), (-3, [math.inf] + [0.0] * (dim - 1), "b")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("key", "n", "vec", "parts", "code", "error", "position")]).repartition(5, "vec_id")
    assert told(df, **options) == plain(rows, **options)


def test_wide_numbers_are_exact(spark):
    """Parts of every width, sums and distances beyond doubles and longs."""
    rows = [(i, [s * m, 1.0, -s * m / 3, 2.0], "a") for i, (s, m) in enumerate((s, m) for m in (1e-3, 40.0, 3e5, 1e7, 3e12, 1e14) for s in (1, -1, 1.001))]
    small = [r for r in rows if max(map(abs, r[1])) < 1e6]
    assert told(spark.createDataFrame(small, SCHEMA), entries=2) == plain(small, entries=2)
    got, want = told(spark.createDataFrame(rows, SCHEMA), entries=2), plain(rows, entries=2)
    cut = Counter({(i, c, min(e, V.MOST), min(t, V.MOST), s): n for (i, c, e, t, s), n in want.items()})
    assert {r[:2] + r[4:] for r in got} == {r[:2] + r[4:] for r in cut} and {r[3] for r in got} == {V.MOST}


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, [0.1] * 8, "a"), (2, [0.2] * 8, None), (3, [0.3] * 4, "a"), (4, [], "a")]
    assert told(spark.createDataFrame(rows, SCHEMA)) == plain(rows[:2])
    assert told(spark.createDataFrame([], SCHEMA)) == Counter()
    assert told(spark.createDataFrame([(1, [], "a"), (2, [], "a")], SCHEMA)) == plain([(1, [], "a"), (2, [], "a")])
