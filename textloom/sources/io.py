"""Readers and writers: JSON lines, exposition text, the content store and the savings ledger as tables on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def new_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir; where that is unset on one machine (tests), one is made
    and set, and on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of a batch of whole texts, where the session does not set them itself: with Spark's 4,096 rows read and 10,000
#: sent to Python, bodies of 200 kB come to 800 MB and 2 GB in each task at once.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 128, "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are read, and sent to Python, in batches that stay small however long the texts are."""
    own = spark.conf.getAll
    for key, size in BATCHES.items():
        if key not in own:
            spark.conf.set(key, str(size))


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: worked out once, however often it is read."""
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at a path whose write is complete; none where there is no such path."""
    fs, at = _file_system(spark, path)
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def read_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of a text file; ord follows a file's order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """request_id (the file's path), body: one request in each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("request_id"), F.decode("content", "UTF-8").alias("body"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """name, value of the unlabelled samples of an exposition text; comments and labelled samples are skipped."""
    p = r"^([A-Za-z_:][A-Za-z0-9_:]*) ([-+0-9.eE]+)$"
    return spark.read.text(path).where(F.regexp_like("value", F.lit(p))).select(F.regexp_extract("value", p, 1).alias("name"), F.regexp_extract("value", p, 2).cast("double").alias("value"))


class ContentStore:
    """Originals under their hashes: an append-only Parquet table laid out by the first two digits of the hash.

    Equal contents share a name; the latest put decides the expiry. Reads prune to the folders a hash can be in.
    """

    SCHEMA = "hash string, content string, stored_at timestamp, expires_at timestamp, shard string"

    def __init__(self, spark: SparkSession, path: str, ttl: str = "24 hours"):
        self.spark, self.path, self.ttl = spark, path, ttl

    def put(self, df: DataFrame, content: str = "content", at=None) -> DataFrame:
        """Store the contents of df; returns df with the marker of each."""
        now = F.current_timestamp() if at is None else at
        rows = df.select(T.content_hash(F.col(content)).alias("hash"), F.col(content).alias("content"), now.alias("stored_at")).where("content IS NOT NULL").dropDuplicates(["hash"])
        rows.withColumn("expires_at", F.col("stored_at") + F.expr(f"INTERVAL {self.ttl}")).withColumn("shard", F.substring("hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.path)
        return df.withColumn("marker", T.marker(F.col(content)))

    def read(self) -> DataFrame:
        t = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return t.groupBy("shard", "hash").agg(F.max_by("content", "stored_at").alias("content"), F.max("expires_at").alias("expires_at"))

    def get(self, names: DataFrame | list[str], now) -> DataFrame:
        """hash, content of the live ones among the names: a table with a column hash, or a few of them.

        Names join on shard and hash, so that a small table prunes the folders that are read and a large one is shuffled;
        repeated names give a row each, null ones none."""
        if isinstance(names, list):
            names = self.spark.createDataFrame([(n,) for n in names], "hash string").distinct()
        asked = names.where("hash IS NOT NULL").withColumn("shard", F.substring("hash", 1, 2))
        return asked.join(self.read().where(F.col("expires_at") > now).select("shard", "hash", "content"), ["shard", "hash"]).drop("shard")

    def purge(self, now, to: str) -> int:
        """Write the live entries as a new table; returns their number."""
        live = self.read().where(F.col("expires_at") > now).withColumn("stored_at", F.col("expires_at") - F.expr(f"INTERVAL {self.ttl}"))
        live.select("hash", "content", "stored_at", "expires_at", "shard").write.partitionBy("shard").parquet(to)
        return self.spark.read.schema(self.SCHEMA).parquet(to).count()


LEDGER = "hour timestamp, family string, content_type string, compressions long, passthroughs long, tokens_before long, tokens_after long"
RECOMMENDATIONS = "mode string, family string, content_type string, samples long, mean_ratio double, worth boolean"


def save_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").parquet(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A saved ledger; an empty one where there is nothing at the path that can be read."""
    return _load(spark, path, LEDGER, "parquet")


def _load(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.format(kind).load(path)
    except AnalysisException:  # no such path, or nothing whose columns can be told
        return empty
    return spark.read.schema(schema).format(kind).load(path) if set(empty.columns) <= set(found.columns) else empty


def merge_ledgers(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of two ledgers (or telemetry tables) by key; merging in any order gives the same table."""
    sums = [c for c in a.columns if c not in keys]
    return a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def save_recommendations(r: DataFrame, path: str) -> None:
    r.write.mode("overwrite").json(path)


def load_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """Saved recommendations; none where there is nothing at the path, or nothing of theirs."""
    return _load(spark, path, RECOMMENDATIONS, "json")
