"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

A text's features (runs of consecutive words) fall into hashed buckets. Documents become postings (bucket, document, count),
sorted by bucket and packed for each batch of documents and each part, a run of buckets. Postings are shuffled by part; where
they meet, the part's counts in both corpora are beside them (co-grouped), so that each bucket's gain is worked out there
and every document's contributions leave packed; they are reduced by document. A part is split into cells of a bounded
number of batches, so a frequent bucket never has all its postings in one task; counts of buckets are summed in each task
before they meet.

The draw is by the largest perturbed weights (Gumbel noise from a hash of the id), ranked by one range sort.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, as_sent, freed, freed_group, materialize, small_batches, table

BUCKETS, LONGEST = 10_000, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Parts that the buckets are cut into, and batches of documents (about, by hash) whose postings of one part meet in a group.
PARTS, CELL_BATCHES = 25, 64
#: Features whose bucket a task remembers.
REMEMBERED = 500_000
#: Rows of a batch, at most: a posting's document is its place there, in 16 bits.
MOST_ROWS = 1 << 16

_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


class _Buckets(dict):
    """Bucket of a feature's bytes."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def _counted(text: bytes | None, known: _Buckets, longest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets, counts) of one text, read a slice at a time; slices end where a word does."""
    n_words, total, small, tail = 0, None, [], []
    raw, pos = (text or b"").lower(), 0
    while pos < len(raw):
        gap = _GAP.search(raw, pos + SLICE) if len(raw) - pos > SLICE else None
        end = gap.start() if gap else len(raw)
        words = _WORD.findall(raw, pos, end)
        pos, n_words = end, n_words + len(words)
        ids = list(map(known.__getitem__, words))
        if longest > 1:
            words = tail + words
            for size in range(2, longest + 1):  # runs that end in this slice
                ids += [known[b" ".join(words[i - size : i])] for i in range(max(size, len(tail) + 1), len(words) + 1)]
            tail = words[1 - longest :]
        if len(ids) > known.buckets // 2:
            more = np.bincount(ids, minlength=known.buckets)
            total = more if total is None else total + more
        else:
            small.extend(ids)
    if total is not None:
        total += np.bincount(small, minlength=known.buckets) if small else 0
        at = np.flatnonzero(total)
        return n_words, at, total[at]
    at, n = np.unique(np.array(small, np.int64), return_counts=True)
    return n_words, at, n


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_POSTING = ("<u2", "<u2", "<u4")  # bucket within the part, place in the batch, count


def _width(buckets: int) -> int:
    return -(-buckets // PARTS)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(batch, part, data, ids, words, features) as a written table, so that batches keep their numbers: for each batch of
    documents a row of postings for each part it has any in, and a row with part -1, its ids, words and features; for each
    task and part a row with batch -1, the sums of its counts by bucket."""

    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, number = _Buckets(buckets), np.zeros(width * PARTS, np.int64), TaskContext.get().partitionId() << 32

        def rows(of: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*of, strict=True), kinds, strict=True)], names=["batch", "part", "data", "ids", "words", "features"])

        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for whole in batches:
            for at in range(0, whole.num_rows, MOST_ROWS):
                b = whole.slice(at, MOST_ROWS)
                found = [_counted(t.as_py(), known, longest) for t in b.column("text")]
                where = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
                bucket, count = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                sums[:] += np.bincount(bucket.astype(np.int64), count, len(sums)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, where, count = bucket[order], where[order], count[order]
                edges = np.searchsorted(bucket, np.arange(PARTS + 1) * width)
                out = [(number, -1, None, b.column("id").to_pylist(), [f[0] for f in found], [int(f[2].sum()) for f in found])]
                for p in range(PARTS):
                    lo, hi = edges[p], edges[p + 1]
                    if hi > lo:
                        data = _pack(*(c[lo:hi].astype(k) for c, k in zip((bucket - p * width, where, count), _POSTING, strict=True)))
                        out.append((number, p, data, None, None, None))
                number += 1
                yield rows(out)
        if sums.any():
            yield rows([(-1, p, _pack(sums[p * width : (p + 1) * width]), None, None, None) for p in range(PARTS) if sums[p * width : (p + 1) * width].any()])

    src = small_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(src.mapInArrow(freed(run), "batch long, part int, data binary, ids array<string>, words array<long>, features array<long>"), "postings")


def bucket_counts(of: DataFrame) -> DataFrame:
    """(part, bucket within it, n) of a table of postings, from the sums of its tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["part"], b["data"], strict=True):
                (n,) = _unpack(data, "<i8")
                at = np.flatnonzero(n)
                yield pd.DataFrame({"part": p, "bucket": at, "n": n[at]})

    sums = of.where("batch = -1").select("part", "data").mapInPandas(freed(run), "part int, bucket int, n long")
    return sums.groupBy("part", "bucket").agg(F.sum("n").alias("n"))


def gains(s: np.ndarray, t: np.ndarray, of_source: int, of_target: int, buckets: int) -> np.ndarray:
    """Thousandths of a bucket's log-probability in the target (t of of_target) over that in the source, add-one smoothed."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * float(of_source + buckets) / ((s + 1) * float(of_target + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight (the sum of its features' gains; none: 0).

    Null texts have no words. Repeated rows each give a row, and each counts in the corpus. Null ids stay null. Other columns
    are not looked at; an empty target or an empty table counts 0 everywhere.
    """
    width = _width(buckets)
    own = postings(docs, id_col, text_col, buckets, longest)
    theirs = postings(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", buckets, longest)
    counts = materialize(bucket_counts(own).withColumn("target", F.lit(False)).unionByName(bucket_counts(theirs).withColumn("target", F.lit(True))), "counts")
    total = {r["target"]: r["n"] for r in counts.groupBy("target").agg(F.sum("n").alias("n")).collect()}  # two rows
    of_source, of_target = total.get(False, 0), total.get(True, 0)
    cells = max(1, -(-own.where("part = -1").count() // CELL_BATCHES))
    split = lambda c: F.pmod(F.xxhash64("batch"), F.lit(c)).cast("int").alias("cell")

    def side_by_side(rows: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, width), np.int64)
        both[rows["target"].to_numpy(np.int64), rows["bucket"].to_numpy()] = rows["n"]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "data": [_pack(*both)]})

    def contributions(rows: pd.DataFrame, corpora: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            gain = gains(*_unpack(corpora["data"].iat[0], "<i8", "<i8"), of_source, of_target, buckets)
            for batch, data in zip(rows["batch"], rows["data"], strict=True):
                bucket, where, count = _unpack(data, *_POSTING)
                has = np.unique(where)
                sums = np.bincount(where, gain[bucket] * count.astype(np.float64))[has]  # whole numbers far below 2**53
                out.append((batch, _pack(has, sums.astype("<i8"))))
        return pd.DataFrame(out, columns=["batch", "data"])

    def reduced(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        ids = of["ids"].iat[0]
        weight = np.zeros(len(ids), np.int64)
        for data in rows["data"]:
            has, sums = _unpack(data, "<u2", "<i8")
            weight[has] += sums
        return pd.DataFrame({"id": ids, "n_words": of["words"].iat[0], "n_features": of["features"].iat[0], "weight": weight})

    packed = counts.groupBy("part").applyInPandas(side_by_side, "part int, data binary")  # at most 2 * width rows a part
    packed = packed.select("part", "data", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    block = own.where("part >= 0 AND batch >= 0").select("part", split(cells), "batch", "data")
    sent = block.groupBy("part", "cell").cogroup(packed.groupBy("part", "cell")).applyInPandas(_freed_pair(contributions), "batch long, data binary")
    of_docs = own.where("part = -1").select("batch", "ids", "words", "features")
    out = sent.groupBy("batch").cogroup(of_docs.groupBy("batch")).applyInPandas(_freed_pair(reduced), "id string, n_words long, n_features long, weight long")
    return out.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "n_words", "n_features", "weight")


def _freed_pair(run):
    return lambda a, b: freed_group(lambda rows: run(rows, b))(a)


def noise(id_col: str, seed: int) -> Column:
    """Thousandths of Gumbel noise from the hash of seed and id (a null id counts as an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    Of the documents with at least `least_words` words, `percent` of a hundred (rounded down) with the highest scores are
    drawn and ranked from 1; ties go to the smaller id, a null id last; the others' rank is null. See `weights` for the rest.
    """
    scored = materialize(weights(docs, target, id_col, text_col, target_text, buckets, longest).withColumn("score", F.col("weight") + noise(id_col, seed)), "scored")
    may = F.col("n_words") >= least_words
    drawn = scored.where(may).count() * percent // 100
    order = (F.desc("score"), F.asc_nulls_last(id_col), F.desc("n_features"))
    # a row's place: its task's number in the range order above bit 33, below it its place there
    ranged = materialize(scored.where(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranged")
    runs = ranged.groupBy(F.shiftright("place", 33).alias("run")).agg(F.count(F.lit(1)).alias("n")).orderBy("run").collect()  # one row a task
    before = np.cumsum([0] + [r["n"] for r in runs]).tolist()
    first = docs.sparkSession.createDataFrame([(r["run"], a) for r, a in zip(runs, before[:-1], strict=True)], "run long, first long")
    rank = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.withColumn("run", F.shiftright("place", 33)).join(F.broadcast(first), "run").withColumn("rank", F.when(rank <= drawn, rank))
    cols = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(cols).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(cols))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    digits = "list_transform(range(0, strlen(w)), lambda i: instr('0123456789ABCDEF', substr(hex(encode(w)), (2 * i + 1)::INT, 1)) * 16 - 17 + instr('0123456789ABCDEF', substr(hex(encode(w)), (2 * i + 2)::INT, 1)))"
    return f"""
    WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
    d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM documents), dw AS (SELECT k, unnest(ws) AS w FROM d), bw AS (SELECT unnest({words}) AS w FROM benchmark),
    v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    vb AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({digits}, lambda x: x::BIGINT)), lambda a, x: xor(a // 256, t[(xor(a, x) % 256 + 1)::INT])), 4294967295) % {BUCKETS} AS b FROM v, tab),
    s AS (SELECT b, count(*) AS n FROM dw JOIN vb USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN vb USING (w) GROUP BY b),
    tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
    g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1) * (ss + {BUCKETS}) / ((s.n + 1) * (tt + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), tot),
    f AS (SELECT k, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN vb USING (w) JOIN g USING (b) GROUP BY k),
    h AS (SELECT k, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (k)),
    z AS (SELECT k, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
    r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)"""


QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": _sql()}
