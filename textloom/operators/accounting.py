"""Savings, telemetry, recommendations, the content store and rate limits as joins and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read

# When a shape is worth condensing, and the limiter.
WORTH_RATIO, MIN_SAMPLES, LIMIT, LIMIT_SECONDS, TTL_HOURS = 0.10, 5, 600, 60, 24
MODELS = ("claude-opus-4-20250514", "gpt-4o-mini", "gemini-1.5-pro", "o3", "4all")
MODES = ("payg", "oauth", "subscription")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One condensation outcome for each event: ts, mode, family, content_type, shape, tokens before and after."""
    return outcomes_of(read(spark, d, "events"))


def outcomes_of(e: DataFrame) -> DataFrame:
    """The outcomes of a table or a batch of events."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % len(names) + 1).cast("int"))
    before = (F.floor("value") + 50).cast("long")
    return e.select(
        "event_id", "ts", "user_id", pick(MODES, F.col("user_id")).alias("mode"), T.model_family(pick(MODELS, F.col("event_id"))).alias("family"), F.col("event_type").alias("content_type"),
        before.alias("before"), F.when(F.col("event_id") % 11 == 0, before + 3).when(F.col("event_id") % 3 == 0, before).otherwise(F.floor(before / (1 + F.col("event_id") % 7)).cast("long")).alias("after"),
    )


def observe(o: DataFrame) -> DataFrame:
    """mode, family, content_type, samples, tokens_before, tokens_after, declines; partial sums merge by adding up."""
    return o.groupBy("mode", "family", "content_type").agg(F.count(F.lit(1)).alias("samples"), F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"), F.sum((F.col("after") >= F.col("before")).cast("long")).alias("declines"))


def recommend(obs: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Adds worth: the mean saving is over WORTH_RATIO and less than half of the samples were declined."""
    ratio = F.when(F.col("tokens_before") > 0, 1 - F.col("tokens_after") / F.col("tokens_before")).otherwise(0.0)
    kept = obs.where(F.col("samples") >= min_samples)
    return kept.select("mode", "family", "content_type", "samples", F.round(ratio, 9).alias("mean_ratio"), ((ratio > WORTH_RATIO) & (2 * F.col("declines") < F.col("samples"))).alias("worth"))


def hourly(o: DataFrame) -> DataFrame:
    """hour, family, content_type, compressions, passthroughs, tokens before and after of each hour."""
    made = F.col("after") < F.col("before")
    return o.groupBy(F.date_trunc("hour", "ts").alias("hour"), "family", "content_type").agg(F.sum(made.cast("long")).alias("compressions"), F.sum((~made).cast("long")).alias("passthroughs"), F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"))


def rate_limit(o: DataFrame, limit: int = LIMIT, seconds: int = LIMIT_SECONDS) -> DataFrame:
    """event_id, allowed: the first `limit` calls of a caller in each fixed window."""
    w = Window.partitionBy("user_id", F.floor(F.unix_timestamp("ts") / seconds)).orderBy("ts", "event_id")
    return o.select("event_id", (F.row_number().over(w) <= limit).alias("allowed"))


def store(puts: DataFrame) -> DataFrame:
    """hash, content, expires_at: the latest put of each hash (ties: the larger content)."""
    return puts.groupBy("hash").agg(F.max_by("content", F.struct("stored_at", "content")).alias("content"), (F.max("stored_at") + F.expr(f"INTERVAL {TTL_HOURS} HOURS")).alias("expires_at"))


def retrieve(asks: DataFrame, stored: DataFrame, now) -> DataFrame:
    """ask_id, status, content: found, expired, missing or malformed (a name that is not 32 lower-case hex digits)."""
    bare = F.regexp_replace(F.regexp_replace("name", "^<<ccr:", ""), ">>$", "")
    fine = F.regexp_like("hash", F.lit("^[0-9a-f]{32}$"))
    j = asks.withColumn("hash", bare).join(stored, "hash", "left")
    status = F.when(~fine, "malformed").when(F.col("expires_at").isNull(), "missing").when(F.col("expires_at") <= now, "expired").otherwise("found")
    return j.select("ask_id", status.alias("status"), F.when(status == "found", F.col("content")).alias("content"))


def _puts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts", "props")
    return e.select(T.content_hash(F.col("props")).alias("hash"), F.col("props").alias("content"), F.col("ts").alias("stored_at"))


def q_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return observe(outcomes(spark, d))


def q_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return recommend(observe(outcomes(spark, d)))


def q_hourly_savings(spark: SparkSession, d: str) -> DataFrame:
    return hourly(outcomes(spark, d))


def q_savings_totals(spark: SparkSession, d: str) -> DataFrame:
    o = hourly(outcomes(spark, d))
    last = o.agg(F.max("hour").alias("last"))
    t = o.where(F.col("hour") >= last.first()["last"] - F.expr("INTERVAL 7 DAYS")) if last.first()["last"] else o
    return t.groupBy("family").agg(F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.count_distinct("hour").alias("hours"))


def q_audit(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that were declined, most often declined first."""
    o = observe(outcomes(spark, d)).where((F.col("samples") >= MIN_SAMPLES) & (F.col("declines") > 0))
    return o.select(F.concat_ws("|", "mode", "family", "content_type").alias("key"), "samples", "declines").orderBy(F.desc("declines"), "key")


def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return rate_limit(outcomes(spark, d), limit=2, seconds=24 * 3600)


def q_content_store(spark: SparkSession, d: str) -> DataFrame:
    s = store(_puts(spark, d))
    return s.select("hash", "content", "expires_at")


def q_retrieve(spark: SparkSession, d: str) -> DataFrame:
    puts = _puts(spark, d)
    asks = read(spark, d, "events").select(F.col("event_id").alias("ask_id"), F.when(F.col("event_id") % 15 == 0, F.upper(T.content_hash(F.col("props")))).when(F.col("event_id") % 10 == 0, T.marker(F.col("event_type"))).otherwise(T.marker(F.col("props"))).alias("name"))
    now = puts.agg(F.max("stored_at").alias("m")).first()["m"]
    return retrieve(asks, store(puts), F.lit(now))


def q_routed_by_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """Events routed by their shape's recommendation; a shape without one is worth trying."""
    o = outcomes(spark, d)
    r = recommend(observe(o))
    j = o.join(r.select("mode", "family", "content_type", "worth"), ["mode", "family", "content_type"], "left")
    return j.groupBy("mode", F.when(F.coalesce("worth", F.lit(True)), "compress").otherwise("measured_useless").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_shape_stats(spark: SparkSession, d: str) -> DataFrame:
    o = observe(outcomes(spark, d))
    return o.agg(F.count(F.lit(1)).alias("shapes"), F.sum("samples").alias("samples"), F.sum("declines").alias("declines"), F.round(1 - F.sum("tokens_after") / F.sum("tokens_before"), 9).alias("mean_ratio"))


COUNTERS = ("compressed_total", "expanded_total", "passthrough_total", "tokens_before_total", "tokens_after_total")


def counters(o: DataFrame) -> DataFrame:
    """One row: rewrites that shrank, that grew, and that changed nothing, and the tokens before and after."""
    return o.agg(
        F.count_if(F.col("after") < F.col("before")).alias("compressed_total"), F.count_if(F.col("after") > F.col("before")).alias("expanded_total"),
        F.count_if(F.col("after") == F.col("before")).alias("passthrough_total"), F.coalesce(F.sum("before"), F.lit(0)).alias("tokens_before_total"), F.coalesce(F.sum("after"), F.lit(0)).alias("tokens_after_total"),
    )


def retrieve_batch(batches: DataFrame, stored: DataFrame, now) -> DataFrame:
    """batch_id, pos, status, content: one row for each name of a batch, numbered in the order it was asked in.

    batches: batch_id, names (an array)."""
    asks = batches.select(F.col("batch_id"), F.posexplode("names").alias("pos", "name")).select(F.struct("batch_id", "pos").alias("ask_id"), "name")
    return retrieve(asks, stored, now).select("ask_id.batch_id", "ask_id.pos", "status", "content")


def q_retrieve_batch(spark: SparkSession, d: str) -> DataFrame:
    """What each user asks for, a name for each of their events, in order."""
    puts = _puts(spark, d)
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, F.lit("bad")).otherwise(T.marker(F.col("props"))).alias("name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "name"))), lambda x: x["name"])
    now = puts.agg(F.min("stored_at").alias("m")).first()["m"]
    return retrieve_batch(e.groupBy(F.col("user_id").alias("batch_id")).agg(names.alias("names")), store(puts), F.lit(now))


def q_metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """Counters as exposition lines."""
    long = counters(outcomes(spark, d)).unpivot([], list(COUNTERS), "name", "value")
    return long.select(F.concat(F.lit("textloom_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line"))


_A = lambda names, c: "[" + ", ".join(f"'{n}'" for n in names) + f"][({c} % {len(names)} + 1)::INT]"
_FAM = "regexp_extract(model, '^([^-.:0-9][^-.:]*([-.:][^-.:0-9][^-.:]*)?)', 1)"
_O = f"""ev AS (SELECT event_id, ts, {_A(MODES, 'user_id')} AS mode, {_A(MODELS, 'event_id')} AS model, event_type AS content_type, floor(value)::BIGINT + 50 AS before FROM events),
 o AS (SELECT *, CASE WHEN coalesce({_FAM}, '') = '' THEN 'unknown' ELSE regexp_replace({_FAM}, '[.:]', '-', 'g') END AS family, CASE WHEN event_id % 11 = 0 THEN before + 3 WHEN event_id % 3 = 0 THEN before ELSE floor(before / (1 + event_id % 7))::BIGINT END AS after FROM ev),
 ob AS (SELECT mode, family, content_type, count(*) AS samples, sum(before)::BIGINT AS tokens_before, sum(after)::BIGINT AS tokens_after, sum((after >= before)::INT)::BIGINT AS declines FROM o GROUP BY 1, 2, 3),
 re AS (SELECT *, CASE WHEN tokens_before > 0 THEN 1 - tokens_after / tokens_before ELSE 0 END AS ratio FROM ob WHERE samples >= {MIN_SAMPLES}),
 ho AS (SELECT date_trunc('hour', ts) AS hour, family, content_type, sum((after < before)::INT)::BIGINT AS compressions, sum((after >= before)::INT)::BIGINT AS passthroughs, sum(before)::BIGINT AS tokens_before, sum(after)::BIGINT AS tokens_after FROM o GROUP BY 1, 2, 3)"""
_ST = f"st AS (SELECT left(sha256(props), 32) AS hash, max_by(props, (ts, props)) AS content, max(ts) + INTERVAL {TTL_HOURS} HOUR AS expires_at FROM events GROUP BY 1)"
QUERIES = {
    "telemetry": q_telemetry, "recommendations": q_recommendations, "hourly_savings": q_hourly_savings, "savings_totals": q_savings_totals, "audit": q_audit, "rate_limit": q_rate_limit, "content_store": q_content_store,
    "retrieve": q_retrieve, "retrieve_batch": q_retrieve_batch, "routed_by_recommendation": q_routed_by_recommendation, "shape_stats": q_shape_stats, "metrics_text": q_metrics_text,
}
ORACLES = {
    "telemetry": f"WITH {_O} SELECT * FROM ob",
    "recommendations": f"WITH {_O} SELECT mode, family, content_type, samples, round(ratio, 9) AS mean_ratio, ratio > {WORTH_RATIO} AND 2 * declines < samples AS worth FROM re",
    "hourly_savings": f"WITH {_O} SELECT * FROM ho",
    "savings_totals": f"WITH {_O} SELECT family, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after, count(DISTINCT hour) AS hours FROM ho WHERE hour >= (SELECT max(hour) FROM ho) - INTERVAL 7 DAY GROUP BY 1",
    "audit": f"WITH {_O} SELECT mode || '|' || family || '|' || content_type AS key, samples, declines FROM ob WHERE samples >= {MIN_SAMPLES} AND declines > 0 ORDER BY declines DESC, key",
    "rate_limit": f"WITH {_O} SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 2 AS allowed FROM events",
    "content_store": f"WITH {_ST} SELECT * FROM st",
    "retrieve": f"""WITH {_ST}, a AS (SELECT event_id AS ask_id, CASE WHEN event_id % 15 = 0 THEN upper(left(sha256(props), 32)) WHEN event_id % 10 = 0 THEN left(sha256(event_type), 32) ELSE left(sha256(props), 32) END AS hash FROM events),
 j AS (SELECT ask_id, content, CASE WHEN NOT regexp_matches(a.hash, '^[0-9a-f]{{32}}$') THEN 'malformed' WHEN expires_at IS NULL THEN 'missing' WHEN expires_at <= (SELECT max(ts) FROM events) THEN 'expired' ELSE 'found' END AS status FROM a LEFT JOIN st USING (hash))
 SELECT ask_id, status, CASE WHEN status = 'found' THEN content END AS content FROM j""",
    "routed_by_recommendation": f"WITH {_O} SELECT o.mode, CASE WHEN coalesce(ratio > {WORTH_RATIO} AND 2 * declines < samples, true) THEN 'compress' ELSE 'measured_useless' END AS reason, count(*) AS n FROM o LEFT JOIN re USING (mode, family, content_type) GROUP BY 1, 2",
    "shape_stats": f"WITH {_O} SELECT count(*) AS shapes, sum(samples)::BIGINT AS samples, sum(declines)::BIGINT AS declines, round(1 - sum(tokens_after) / sum(tokens_before), 9) AS mean_ratio FROM ob",
    "metrics_text": f"""WITH {_O}, c AS (SELECT count(*) FILTER (after < before) AS compressed_total, count(*) FILTER (after > before) AS expanded_total, count(*) FILTER (after = before) AS passthrough_total,
  sum(before)::BIGINT AS tokens_before_total, sum(after)::BIGINT AS tokens_after_total FROM o)
 SELECT 'textloom_' || name || ' ' || value AS line FROM (UNPIVOT c ON {", ".join(COUNTERS)} INTO NAME name VALUE value)""",
    "retrieve_batch": f"""WITH {_ST}, e AS (SELECT user_id AS batch_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_id, left(sha256(props), 32) AS hash FROM events)
 SELECT batch_id, pos, CASE WHEN event_id % 10 = 0 THEN 'malformed' ELSE 'found' END AS status, CASE WHEN event_id % 10 <> 0 THEN content END AS content FROM e LEFT JOIN st USING (hash)""",
}
