"""Vector code compression: product codes learned on distinct integer parts.

Components become integers and vectors are cut into equal parts. Equal parts of a position are one weighted row (combined in
each task before they meet), and Lloyd's rounds run over these distinct rows: tasks assign their rows to the nearest entry of
the position's codebook and send one weighted sum an entry. Codes and errors are then joined back to the vectors; parts with
very many vectors are broadcast, so that no task gets all of them. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freed, freed_group, join_counted, materialize, small_batches, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: The largest error a long holds; larger ones (components of 10**6 and more) are given as this.
MOST = (1 << 63) - 1


def _edges(dim: int, parts: int) -> list[int]:
    return [dim * k // parts for k in range(parts + 1)]


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles (scale: a power of two): int64, or Python integers where that is too small."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if not v.size or np.abs(v).max() < 2.0**62:
        return v.astype(np.int64)
    return np.array([int(a) * scale if abs(a) >= 2.0**53 else int(np.floor(a * scale)) for a in x.ravel()], object).reshape(x.shape)


def _key(position: int, v: np.ndarray) -> bytes:
    """Name of one part: its position, its width in bytes (0: decimal text), and its integers. Equal parts, equal names."""
    most = max(map(abs, v.tolist()), default=0)
    width = next((w for w in (2, 4, 8) if most < 1 << 8 * w - 1), 0)
    return bytes([position, width]) + (v.astype(f"<i{width}").tobytes() if width else ",".join(map(str, v.tolist())).encode())


def _keys(position: int, v: np.ndarray) -> list[bytes]:
    if not v.size or v.dtype == object or np.abs(v).max() >= 1 << 15:
        return [_key(position, row) for row in v]
    raw, step, head = v.astype("<i2").tobytes(), 2 * v.shape[1], bytes([position, 2])
    return [head + raw[i : i + step] for i in range(0, len(raw), step)]


def _values(keys: list[bytes]) -> np.ndarray:
    """The integers of parts of one position, a row each."""
    if all(k[1] == 2 for k in keys):
        return np.frombuffer(b"".join(k[2:] for k in keys), "<i2").reshape(len(keys), -1).astype(np.int64)
    rows = [np.frombuffer(k, f"<i{k[1]}", offset=2).tolist() if k[1] else [int(x) for x in k[2:].decode().split(",")] for k in keys]
    return np.array(rows, object if any(not k[1] for k in keys) else np.int64)


def _as(kind: type, *arrays: np.ndarray) -> list[np.ndarray]:
    return [a.astype(kind) for a in arrays]


def _exact(bound: int) -> type:
    """A type in which whole numbers up to bound add and multiply exactly."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of book, ties to the lower one; squared distance) of each row of v."""
    if not v.shape[1]:
        return np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    most = max(int(np.abs(v).max()), int(np.abs(book).max()))
    x, c = _as(_exact(4 * v.shape[1] * most * most), v, book)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    best = d[np.arange(len(v)), at]
    return at, np.array([min(MOST, e) for e in best], np.int64) if best.dtype == object else best.astype(np.int64)


def _by_position(keys: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, integers) of the positions in a batch of parts."""
    first = np.array([k[0] for k in keys], np.int64)
    for p in np.unique(first).tolist():
        at = np.flatnonzero(first == p)
        yield p, at, _values([keys[i] for i in at])


def cut(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec, vec_id, label, parts) of the vectors that hold only finite numbers, as a written table: vec numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("x")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out: list = [None] * b.num_rows
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                v = _integers(flat[starts[own][:, None] + np.arange(dim)], scale)
                cols = [_keys(p, v[:, lo:hi]) for p, (lo, hi) in enumerate(pairwise(_edges(dim, parts)))]
                for i, keys in zip(own.tolist(), zip(*(c or [_key(p, v[0, :0])] * len(own) for p, c in enumerate(cols)), strict=True), strict=True):
                    out[i] = list(keys)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.binary()))], names=["vec_id", "label", "dim", "parts"])

    x = F.col(vector_col).cast("array<double>")
    finite = x.isNotNull() & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    src = small_batches(vectors).where(finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    kinds = dict(src.dtypes)
    rows = src.mapInArrow(freed(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, parts array<binary>")
    return materialize(rows.withColumn("vec", F.monotonically_increasing_id()), "vectors")


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, component sums) of every used (position, entry): at most one row for each entry of the codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            weight = b.column("n").to_numpy()
            for p, at, v in _by_position(b.column("key").to_pylist()):
                own, w = nearest(v, books[p])[0], weight[at]
                most = int(np.abs(v).max()) if v.size else 0
                kind = _exact(max(1, most) * int(w.sum()))
                hit = np.zeros((len(books[p]), len(at)), kind)
                hit[own, np.arange(len(at))] = w
                here = np.column_stack([hit.sum(1), hit @ v.astype(kind)])
                here = np.array([[int(a) for a in row] for row in here], object)
                total[p] = total[p] + here if p in total else here
        rows = [(p, e, [str(a) for a in row]) for p, t in total.items() for e, row in enumerate(t.tolist()) if row[0]]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["part", "entry", "sums"]), pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.string()))]), preserve_index=False)

    def added(rows: pd.DataFrame) -> pd.DataFrame:  # one row a task
        sums = [str(sum(int(a) for a in c)) for c in zip(*rows["sums"], strict=True)]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "sums": [sums]})

    schema = "part int, entry int, sums array<string>"
    out = distinct.mapInArrow(freed(run), schema).groupBy("part", "entry").applyInPandas(freed_group(added), schema)
    return {(r["part"], r["entry"]): (int(r["sums"][0]), [int(a) for a in r["sums"][1:]]) for r in out.collect()}


def _updated(books: list[np.ndarray], sums: dict) -> list[np.ndarray]:
    out = []
    for p, book in enumerate(books):
        rows = [[a // sums[p, e][0] for a in sums[p, e][1]] if (p, e) in sums else row for e, row in enumerate(book.tolist())]
        small = all(abs(a) < 1 << 62 for row in rows for a in row)
        out.append(np.array(rows, np.int64 if small else object).reshape(book.shape))
    return out


def _assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(key, n, code, error) of every distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for p, at, v in _by_position(b.column("key").to_pylist()):
                code[at], error[at] = nearest(v, books[p])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(code), pa.array(error)], names=["key", "n", "code", "error"])

    return distinct.mapInArrow(freed(run), "key binary, n long, code long, error long")


def learn(cut_vectors: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of all positions: they start as the parts of the vectors with the smallest ids (ties by their parts; null
    ids last), and each round replaces an entry by the floor of the mean of the parts nearest to it."""
    firsts = [r["parts"] for r in cut_vectors.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).collect()]
    books = [_values([bytes(f[p]) for f in firsts]) for p in range(parts)]
    for _ in range(rounds):
        books = _updated(books, _sums(distinct, books))
    return books


def _total(c: str):
    """Sum of errors; as large as a long can be where it is larger."""
    return F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks). codes has one row per kept row of vectors: id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold a null or a number that is not finite are dropped; so are vectors of another length than
    that of the smallest kept id (ties: the smaller length). A length that `parts` does not divide gives parts that differ
    by one. Repeated rows each give a row; null ids come last; null labels are one label; an empty table gives no rows.
    """
    cut_ = cut(vectors, id_col, vector_col, label_col, parts, scale)
    kinds = dict(cut_.dtypes)
    first = cut_.orderBy(F.asc_nulls_last("vec_id"), "dim").limit(1).collect()
    if not first:
        return cut_.select(F.col("vec_id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")), []
    kept = cut_.where(F.col("dim") == first[0]["dim"])
    distinct = materialize(small_batches(kept).select(F.explode("parts").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "distinct")
    books = learn(kept, distinct, parts, entries, rounds)
    sha = hashlib.sha256(",".join(str(a) for book in books for row in book.tolist() for a in row).encode()).hexdigest()

    total = kept.count()
    codes = materialize(_assigned(distinct, books), "codes")
    cells = kept.select("vec", "vec_id", "label", F.posexplode("parts").alias("position", "key"))
    met = join_counted(cells, codes, "key", parts * total)
    names = []
    for lo in range(0, parts, 7):  # seven codes fit into a long
        hi = min(parts, lo + 7)
        byte = F.when(F.col("position").between(lo, hi - 1), F.expr(f"shiftleft(code, 8 * ({hi - 1} - position))"))
        names.append(F.lpad(F.lower(F.hex(F.sum(byte))), 2 * (hi - lo), "0"))
    coded = met.groupBy("vec", "vec_id", "label").agg(F.concat(*names).alias("code"), _total("error").alias("error"))
    coded = materialize(coded.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")), "coded")
    labels = coded.groupBy("key").agg(_total("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_counted(coded, labels, "key", total)
    return out.select(F.col("vec_id").cast(kinds["vec_id"]).alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    squared = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "SELECT k, p, min({{'d': {d}, 'e': e}}) AS s FROM x JOIN b{r} USING (p) GROUP BY k, p"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(d=squared, r=r)})")
        if r < ROUNDS:
            steps.append(f"u{r} AS (SELECT p, e, list(m ORDER BY j) AS m FROM (SELECT p, s.e AS e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM a{r} JOIN x USING (k, p), range(1, 1 + (SELECT max(len(x)) FROM x)) q(j) GROUP BY p, s.e, j) GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN u{r} USING (p, e))")
    return f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, list_transform(embedding, lambda a: floor({SCALE} * a::DOUBLE)::BIGINT) AS i FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
    x AS MATERIALIZED (SELECT k, p, i[p * len(i) // {PARTS} + 1:(p + 1) * len(i) // {PARTS}] AS x FROM v, range({PARTS}) q(p)),
    b0 AS (SELECT p, k AS e, x AS c FROM x WHERE k < {ENTRIES}), {", ".join(steps)},
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
    o AS (SELECT k, string_agg(lower(lpad(to_hex(s.e), 2, '0')), '' ORDER BY p) AS code, sum(s.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (k), h"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}
