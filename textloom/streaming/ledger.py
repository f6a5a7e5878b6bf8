"""Savings ledger, content expiry and limiter over a stream of events, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import folders, new_folder
from ..sources.tables import read
from .base import run_to_table


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_ledger(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, content_type, n, total of each hour; events later than `late` behind the newest are dropped in append mode."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("content_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value").cast("long")).alias("total")).select(F.col("window.start").alias("hour"), "content_type", "n", "total")


def new_contents(events: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The first put of each content within its time to live."""
    return events.select("ts", T.content_hash(F.col("props")).alias("hash")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hash"])


def calls_per_window(events: DataFrame, seconds: int = 60) -> DataFrame:
    """user_id, window start, calls: what a limiter compares with its limit."""
    return events.withWatermark("ts", "5 minutes").groupBy("user_id", F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("calls")).select("user_id", F.col("window.start").alias("start"), "calls")


COUNTS = "user_id long, slot long, n long, newest timestamp, batch long"


def limit_batch(events: DataFrame, counts: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, user_id, allowed of a batch of events, by time and id, behind what `counts` (user_id, slot, n) has seen."""
    e = events.select("event_id", "user_id", "ts", F.floor(F.unix_timestamp("ts") / seconds).alias("slot"))
    at = F.row_number().over(Window.partitionBy("user_id", "slot").orderBy("ts", "event_id"))
    seen = counts.groupBy(F.col("user_id").alias("u"), F.col("slot").alias("s")).agg(F.sum("n").alias("seen"))
    j = e.withColumn("at", at).join(seen, F.col("user_id").eqNullSafe(F.col("u")) & F.col("slot").eqNullSafe(F.col("s")), "left")
    return j.select("event_id", "user_id", (F.coalesce("seen", F.lit(0)) + F.col("at") <= limit).alias("allowed"))


def run_limited(events: DataFrame, limit: int, seconds: int = 60, late: str = "5 minutes", folder: str | None = None) -> DataFrame:
    """Process what is available of a stream; event_id, user_id, allowed of all so far: the first `limit` calls of a user in
    each fixed window, in the order they arrive (within a batch by time and id).

    Each batch writes what it allows and, for each user and window, how many calls it had; the next ones count on from there.
    Events `late` or more behind the newest of earlier batches are dropped, and counts of windows that have ended by then
    are not read. A batch that is run again overwrites its own. Given the same folder again, it goes on.
    """
    spark, at = events.sparkSession, folder or new_folder(events.sparkSession, "limited")

    def step(df: DataFrame, batch: int) -> None:
        before = [f"{at}/counts/{p}" for p in folders(spark, f"{at}/counts") if int(p.removeprefix("batch=")) < batch]
        counts = spark.read.schema(COUNTS).option("basePath", f"{at}/counts").parquet(*before) if before else spark.createDataFrame([], COUNTS)
        past = counts.agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("past")).first()["past"]
        if past is not None:
            df = df.where(~F.coalesce(F.col("ts") <= F.lit(past), F.lit(False)))
            counts = counts.where((F.col("slot") >= F.floor(F.unix_timestamp(F.lit(past)) / seconds)) | F.col("slot").isNull())
        limit_batch(df, counts, limit, seconds).write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
        own = df.groupBy("user_id", F.floor(F.unix_timestamp("ts") / seconds).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
        own.write.mode("overwrite").parquet(f"{at}/counts/batch={batch}")

    events.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, allowed boolean").parquet(f"{at}/out/*")


def q_stream_limited(spark: SparkSession, d: str) -> DataFrame:
    return run_limited(event_stream(spark, d), 2, 3600 * 24).select("event_id", "allowed")


def q_stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    return run_to_table(hourly_ledger(event_stream(spark, d)), "complete")


def q_stream_limiter(spark: SparkSession, d: str) -> DataFrame:
    return run_to_table(calls_per_window(event_stream(spark, d), 3600), "complete").where("calls > 1")


def q_stream_new_contents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents seen (which of several equal puts is first depends on arrival, the hash does not)."""
    return run_to_table(new_contents(event_stream(spark, d), "3650 days")).select("hash").distinct()


QUERIES = {"stream_hourly_ledger": q_stream_ledger, "stream_limiter": q_stream_limiter, "stream_new_contents": q_stream_new_contents, "stream_limited": q_stream_limited}
ORACLES = {
    "stream_hourly_ledger": "SELECT date_trunc('hour', ts) AS hour, event_type AS content_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2",
    "stream_limiter": "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "stream_limited": "SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 2 AS allowed FROM events",
    "stream_new_contents": "SELECT DISTINCT left(sha256(props), 32) AS hash FROM events",
}
