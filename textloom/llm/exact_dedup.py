"""Exact dedup as a stateful stream, in DataFrame operations alone.

Documents stream through a state keyed by the digest of their text. The state lies on disk (RocksDB), never expires, and
keeps of each digest how many rows had it, the largest id, and the locator of that row (its file and its place there). Rows
are combined in their task before they meet their state, so a text with any number of copies is one row a task.

A digest that several rows share is a hit: the text that its locator names is fetched again and compared, byte for byte,
with all texts that led to it. Digests that fail (collisions) are grouped by the whole texts instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_counted, materialize, table, work_dir

#: Slots of the table that says which digests may be hits: 32 for each hit in a power of two between these bounds (a bit each).
SLOTS_LEAST, SLOTS_MOST = 1 << 16, 1 << 22
#: Cells over which the texts of one digest are compared before the cells' extremes are.
CELLS = 64
#: The state's store: bounded memory in an executor, and no disk taken before it is needed (some 4 MB for each partition).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _rows(files: DataFrame, id_col: str, text_col: str, digits: int, *more: str) -> DataFrame:
    """id, sha, digest, at (locator), and what else is asked for, of Parquet files at rest or streaming."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = files.select(F.col(id_col).alias("id"), text.alias("text"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return rows.select("id", sha.alias("sha"), F.unhex(F.substring(sha, 1, digits)).alias("digest"), "at", *more)


def observed(stream: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", digits: int = 64) -> DataFrame:
    """Run a stream of Parquet files through the state in `folder`; (digest, n, keep_id, keep_at) of every digest so far.

    Files already seen under this folder are not read again; their rows count on in the state. A batch that is run again
    overwrites its own output.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        top = F.max(F.struct(F.col("id").alias("keep_id"), F.col("at").alias("keep_at"))).alias("top")
        kept = _rows(stream, id_col, text_col, digits).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), top)
        sink = kept.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        sink.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"digest binary, n long, top struct<keep_id: {dict(stream.dtypes)[id_col]}, keep_at: struct<file: string, row: long>>, batch long"
    out = spark.read.schema(schema).option("basePath", f"{folder}/groups").parquet(f"{folder}/groups/*")
    if out.select("batch").distinct().limit(2).count() > 1:  # of several batches the last one that saw a digest has its totals
        out = out.groupBy("digest").agg(F.max_by(F.struct("n", "top"), "batch").alias("s")).select("digest", "s.*")
    return out.select("digest", "n", "top.keep_id", "top.keep_at")


def _slot(digest: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(slots))


def _sieve(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A table of one row, known: 64 slots in each of its numbers, a bit set where a key falls; and its slots.

    It is broadcast as a table: as a literal it would stand, in digits, in every description of a plan that the driver keeps."""
    slots = min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (32 * n).bit_length()))
    slot = _slot(F.col("digest"), slots)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest), {slots}) % 64 as int))")
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    every = keys.sparkSession.range(slots // 64).select(F.col("id").alias("w")).join(words, "w", "left")  # at most SLOTS_MOST / 64 rows
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("known")), slots


def _held(slots: int) -> Column:
    """Whether the bit of a digest's slot is set in `known`."""
    return F.expr(f"shiftright(get(known, cast(pmod(xxhash64(digest), {slots}) div 64 as int)), cast(pmod(xxhash64(digest), {slots}) % 64 as int)) & 1 = 1")


def unequal(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 64) -> DataFrame:
    """(digest) of the hits whose texts are not all, byte for byte, the text that the locator names.

    Texts of other digests mostly never leave the scan. A digest's texts are compared within CELLS cells by their extremes,
    of which each task sends one pair, and then the cells' extremes.
    """
    hits = materialize(groups.where("n > 1").select("digest", "n", "keep_at"), "hits")
    n, total = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known, slots = _sieve(hits, n)
    met = join_counted(_rows(docs, id_col, text_col, digits, "text").select("digest", "text", "at").crossJoin(F.broadcast(known)).where(_held(slots)).drop("known"), hits, "digest", total)
    located = F.when(F.col("at") == F.col("keep_at"), F.col("text"))
    cells = met.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(CELLS)).alias("cell")).agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.max(located).alias("content"))
    whole = cells.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("content").alias("content"))
    return whole.where("NOT (lo <=> content AND hi <=> content)").select("digest")


def exact_dedup(spark: SparkSession, path: str, schema: str | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", digits: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of the Parquet files at `path`: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (null counts as empty) the one with the largest id stays; of repeated ids the one in the last
    file, and there at the last place; a null id is the smallest. `folder` holds the state: given again after new files have
    come, only those are read by the stream. `digits`: hexadecimal digits of the digest (fewer only make collisions, which
    are told apart all the same). An empty table gives no rows; other columns are not looked at.
    """
    docs = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    source = spark.readStream.schema(docs.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern that only this path fits: a stream over a path without one must be a folder
    groups = observed(source.parquet(f"{path[:-1]}[{path[-1]}]"), folder or work_dir(spark), id_col, text_col, digits)
    total = docs.count()
    clash = materialize(unequal(docs, groups, id_col, text_col, digits), "clash")
    rows = _rows(docs, id_col, text_col, digits)
    met = join_counted(rows, groups.withColumn("group_size", F.col("n")), "digest", total)
    if clash.limit(1).count():
        met = met.join(clash, "digest", "left_anti")
        split = _rows(docs, id_col, text_col, digits, "text").join(clash, "digest", "left_semi")
        key = F.struct("digest", "text").alias("key")
        own = split.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("id").alias("keep_id"), F.col("at").alias("keep_at"))).alias("top")).select("key", "n", F.col("n").alias("group_size"), "top.*")
        met = met.select("id", "sha", "at", "keep_id", "keep_at", "group_size").unionByName(join_counted(split.select("id", "sha", "at", key), own, "key", total).select("id", "sha", "at", "keep_id", "keep_at", "group_size"))
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {
    "op12_exact_dedup": """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
}
