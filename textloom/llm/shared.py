"""What the corpus operators share: tables, the shared work folder, packed counting keys, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch. At Spark's own 10,000 rows a batch of texts takes some 35 MB, several times over in a
#: worker, and workers keep what they once took.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of bounded size in its session where that still has Spark's defaults."""
    conf = df.sparkSession.conf
    for key, default, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{key}", None) == default:
            conf.set(f"spark.sql.execution.arrow.{key}", str(own))
    return df


def _release() -> None:
    """Give back what the C heap and Arrow hold free: workers live on between tasks, and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def freed(run):
    """run, a function for mapInPandas or mapInArrow, that releases memory at its end."""

    def task(batches):
        yield from run(batches)
        _release()

    return task


def freed_group(run):
    """run, a function of one group for applyInPandas, that releases memory at its end."""

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        out = run(rows)
        _release()
        return out

    return task


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; where that is unset on one machine (tests), one is made and
    set, and on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def as_sent(df: DataFrame, col: str = "id") -> DataFrame:
    """df with a whole-number column as text: pandas would turn a column with a null into doubles and lose digits."""
    return df.withColumn(col, F.col(col).cast("string")) if dict(df.dtypes)[col] in ("tinyint", "smallint", "int", "bigint") else df


def sent_type(df: DataFrame, col: str) -> str:
    """Type in which Python sees a column that `as_sent` sends."""
    kind = dict(df.dtypes)[col]
    return "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def hash_sample(df: DataFrame, most: int, key: str, *tie: str) -> DataFrame:
    """At most `most` rows of df, by hash of key (then of the tie columns). About twice as many are ordered, however many
    tasks there are."""
    n = max(1, df.count())
    u = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30))
    near = df.withColumn("__u", u).where(F.col("__u") < min(1 << 30, int((2 * most + 100) / n * (1 << 30)) + 1))
    return near.orderBy("__u", key, F.xxhash64(*tie) if tie else F.lit(0)).limit(most).drop("__u")


# --- hashing whole batches of text at once -------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 2**64)
_TAB = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time: what a prefix sum needs beside its spans stays at some MB, however long a text is.
_BLOCK = 1 << 17


def _powers(m: int, n: int) -> np.ndarray:
    """m**0 .. m**(n - 1) modulo 2**64."""
    full = np.full(n, np.uint64(m), np.uint64)
    full[:1] = 1
    return np.cumprod(full)


_POW, _POW_INV = _powers(_MULT, _BLOCK), _powers(_MULT_INV, _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; spreads what differs over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prefix_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Prefix sums of the weighted bytes of buf at the given places, a block of buf at a time."""
    order = None if len(places) < 2 or (places[1:] >= places[:-1]).all() else np.argsort(places, kind="stable")
    asked = places if order is None else places[order]
    out, carry, scale = np.empty(len(places), np.uint64), np.uint64(0), 1
    for at in range(0, len(buf) + 1, _BLOCK):
        own = buf[at : at + _BLOCK]
        pre = np.empty(len(own) + 1, np.uint64)
        pre[0] = 0
        np.cumsum(_TAB[own] * _POW[: len(own)], out=pre[1:])
        lo, hi = np.searchsorted(asked, (at, at + _BLOCK))
        out[lo:hi] = carry + np.uint64(scale) * pre[asked[lo:hi] - at]
        with np.errstate(over="ignore"):
            carry = carry + np.uint64(scale) * pre[-1]
        scale = scale * pow(_MULT, _BLOCK, 2**64) % 2**64
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of buf, from prefix sums; equal bytes, equal hash."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    high = _powers(pow(_MULT_INV, _BLOCK, 2**64), len(buf) // _BLOCK + 1)
    inverse = _POW_INV[starts % _BLOCK] * high[starts // _BLOCK]
    return mix((_prefix_at(buf, ends) - _prefix_at(buf, starts)) * inverse + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


_GAP = re.compile(r"[\x20\x09-\x0D]")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes but space and 09-0D, A-Z lower-cased) of a batch: (bytes, starts, ends, text index of each word)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    word = ~_SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return buf, starts, ends, np.searchsorted(text_ends, starts, side="right")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each word. A long text is hashed in parts cut before white space, so that only its words'
    hashes stand in memory at once."""
    parts, own, total = [], [], 0

    def flush() -> None:
        if own:
            buf, starts, ends, at = words_of([t for _, t in own])
            parts.append((span_hashes(buf, starts, ends), np.array([i for i, _ in own])[at]))

    for i, t in enumerate(texts):
        pos, n = 0, len(t or "")
        while pos < n:
            end = n
            if n - pos > SLICE and (gap := _GAP.search(t, pos + SLICE)):
                end = gap.start()
            own.append((i, t[pos:end]))
            total += end - pos
            pos = end
            if total >= SLICE:
                flush()
                own, total = [], 0
    flush()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


#: Characters of text that a task hashes at a time; about 50 bytes of arrays each.
SLICE = 400_000


def slices(lengths: list[int], most: int):
    """Cut a run of items into slices of at most `most` units (a larger item stands alone)."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


# --- a fixed-size filter over keys ------------------------------------------------------------------------------------

#: Bits of the filter that says which texts may need another look (false positives only cost time): 16 for each key, in a
#: power of two between these bounds, which keep the largest at 4 MB.
SIFT_LEAST, SIFT_MOST = 1 << 16, 1 << 25


def sift_of(keys: DataFrame) -> np.ndarray:
    """Bit filter over a column `key` of a written table; SIFT_MOST / 32 rows reach the driver at most."""
    n = keys.count()
    bits = min(SIFT_MOST, max(SIFT_LEAST, 1 << (16 * n).bit_length()))
    slot = F.pmod(F.col("key"), F.lit(bits))
    words = keys.select(F.shiftright(slot, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 32 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = words.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def in_sift(sift: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys % np.uint64(32 * len(sift))
    return (sift[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def cuts(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values: only those that occur."""
    if not len(sorted_values):
        return []
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return list(zip(sorted_values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)], strict=True))


# --- connected components -------------------------------------------------------------------------------------------


#: A key with more rows than this (or a 100,000th of all, if that is more) is hot: at most 100,000 keys can be.
HOT_ROWS = 1_000


def join_counted(rows: DataFrame, table_: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with a table of one row for each key, whose column n counts the key's rows (total: of all keys).

    Hot keys, whose number is bounded, are broadcast to their rows; the others are shuffled. So no key's rows meet in one
    task. Rows without a match go.
    """
    hot = F.col("n") > max(HOT_ROWS, total // 100_000)
    marked = rows.join(F.broadcast(table_.where(hot).drop("n").withColumn("__hot", F.lit(True))), key, "left")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(table_.where(~hot).drop("n"), key)
    return marked.where("__hot").drop("__hot").unionByName(rest)


#: Edges that a task gathers before it contracts them.
CONTRACT_EDGES = 500_000


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) over some edges, for all nodes but the smallest ones."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) with fewer edges and the same components: what each task holds becomes stars round its smallest nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for b in batches:
            held.append(b.to_numpy())
            waiting += len(b)
            if waiting >= CONTRACT_EDGES:
                yield pd.DataFrame(dict(zip("uv", star(*np.concatenate(held).T), strict=True)))
                held, waiting = [], 0
        if held:
            yield pd.DataFrame(dict(zip("uv", star(*np.concatenate(held).T), strict=True)))

    return edges.where("u IS NOT NULL AND v IS NOT NULL").mapInPandas(freed(run), "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node (whole numbers) reachable over undirected edges, for nodes with an edge to
    another node.

    Edges are contracted, CONTRACT_EDGES to a task, again and again while that makes them fewer. What is left alternates
    large-star and small-star steps; each step is a grouped minimum, and every round is a written table, the one before it
    deleted. A node's neighbours never meet in one task: minima are combined before they are shuffled, and
    the minima of hubs, whose number is bounded, are broadcast to their edges. Null nodes are left out.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        t = materialize(df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        return t, tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e, before = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    while before[0]:
        tasks = -(-before[0] // CONTRACT_EDGES)
        last = e
        e, now = written(contracted(e.coalesce(tasks)))
        discard(last)
        if tasks == 1:  # one task has seen every edge: these are the stars
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        shrunk = now[0] <= 0.7 * before[0]
        before = now
        if not shrunk:
            break
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = join_counted(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small_low, "u")
        last = e
        e, now = written(step.select("u", F.col("m").alias("v")).unionByName(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        discard(last)
        if now == before:  # nothing moves: every node hangs on its component's smallest
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
