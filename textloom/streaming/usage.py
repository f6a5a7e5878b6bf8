"""What an observer reads off model streams of three vocabularies: kinds of events, usage, completion, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read

# Where each vocabulary keeps cache reads and writes.
USAGE = {
    "messages": ("$.message.usage.cache_read_input_tokens", "$.message.usage.cache_creation_input_tokens"),
    "chat": ("$.usage.prompt_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cache_write_tokens"),
    "responses": ("$.response.usage.input_tokens_details.cached_tokens", "$.response.usage.input_tokens_details.cache_write_tokens"),
}
ENDS = ("response.completed", "response.failed", "response.incomplete", "response.cancelled")


# Events and deltas of each vocabulary, and where a reply that is no stream keeps its usage.
MESSAGE_EVENTS = ("message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop", "ping", "error")
DELTAS = ("text_delta", "thinking_delta", "signature_delta", "input_json_delta", "citations_delta")
STEMS = {"output_text": "output_text", "reasoning_summary_text": "reasoning_summary", "reasoning_summary_part": "reasoning_summary", "reasoning_summary": "reasoning_summary", "function_call_arguments": "function_call_arguments", "output_item": "output_item"}
PATHS = (("/v1/responses", "responses"), ("/v1/chat/completions", "chat"))
BODY_USAGE = {
    "messages": ("$.usage.cache_read_input_tokens", "$.usage.cache_creation_input_tokens"),
    "chat": ("$.usage.prompt_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cache_write_tokens"),
    "responses": ("$.usage.input_tokens_details.cached_tokens", "$.usage.input_tokens_details.cache_write_tokens"),
}
#: Replies longer than this are not looked at.
MAX_BODY = 4 << 20


def dialect_of(path: Column) -> Column:
    """Vocabulary of a request path's reply."""
    return F.coalesce(*[F.when(F.startswith(path, F.lit(p)), F.lit(d)) for p, d in PATHS], F.lit("messages"))


def event_kind(dialect: Column, name: Column, data: Column) -> Column:
    """What an event is in its vocabulary, as `kind` or `kind/part`; `other` where it is none of the known ones.

    messages: the event, a delta with its type; chat: done, error, usage, chunk; responses: created, completed, terminated,
    error, or what is told about with its phase (added, delta, done, lifecycle). The name counts; without one, the type in
    the data.
    """
    told = F.coalesce(name, F.get_json_object(data, "$.type"))
    delta = F.get_json_object(data, "$.delta.type")
    of_delta = F.concat(F.lit("content_block_delta/"), F.when(delta.isin(*DELTAS), F.regexp_replace(delta, "_delta$", "")).otherwise("unknown"))
    messages = F.when(told == "content_block_delta", of_delta).when(told.isin(*MESSAGE_EVENTS), told)
    got = lambda p: F.get_json_object(data, p)
    chat = F.when(F.trim(data) == "[DONE]", "done").when(got("$.error").isNotNull(), "error").when(F.startswith(got("$.usage"), F.lit("{")), "usage").when(got("$.choices").isNotNull(), "chunk")
    suffix = F.when(F.contains(told, F.lit(".")), F.regexp_extract(told, r"\.([^.]*)$", 1)).otherwise("")
    stem = F.when(F.contains(told, F.lit(".")), F.regexp_extract(told, r"([^.]*)\.[^.]*$", 1)).otherwise(told)
    phase = F.when(suffix.isin("added", "delta"), suffix).when(suffix.isin("done", "completed"), "done").otherwise("lifecycle")
    about = F.coalesce(*[F.when(stem == k, F.lit(v)) for k, v in STEMS.items()])
    life = F.when(suffix == "created", "created").when(suffix == "completed", "completed").when(suffix.isin("failed", "incomplete", "cancelled"), "terminated").when(suffix == "error", "error")
    responses = F.coalesce(F.when(stem == "response", life), F.concat(about, F.lit("/"), phase), F.when(stem == "error", "error"))
    return F.coalesce(F.when(dialect == "messages", messages).when(dialect == "chat", chat).when(dialect == "responses", responses), F.lit("other"))


def body_usage(dialect: Column, body: Column) -> tuple[Column, Column]:
    """Cache reads and writes that a reply without a stream tells; null where it tells none or is longer than MAX_BODY."""
    fits = F.octet_length(body) <= MAX_BODY
    pick = lambda i: F.when(fits, F.coalesce(*[F.when(dialect == d, F.get_json_object(body, p[i]).cast("long")) for d, p in BODY_USAGE.items()]))
    return pick(0), pick(1)


def kind(dialect: Column, name: Column, data: Column) -> Column:
    """delta, usage, end, error or other."""
    got = lambda p: F.get_json_object(data, p).isNotNull()
    messages = F.when(name == "content_block_delta", "delta").when(name == "message_start", "usage").when(name == "message_stop", "end").when(name == "error", "error")
    chat = F.when(data == "[DONE]", "end").when(got("$.error"), "error").when(got("$.usage.prompt_tokens_details"), "usage").when(got("$.choices[0].delta"), "delta")
    responses = F.when(F.endswith(name, F.lit(".delta")), "delta").when(name.isin("response.failed", "error"), "error").when(name.isin(*ENDS), "usage")
    return F.coalesce(F.when(dialect == "messages", messages).when(dialect == "chat", chat).when(dialect == "responses", responses), F.lit("other"))


def cache_tokens(dialect: Column, data: Column) -> tuple[Column, Column]:
    pick = lambda i: F.coalesce(*[F.when(dialect == d, F.get_json_object(data, p[i]).cast("long")) for d, p in USAGE.items()])
    return pick(0), pick(1)


def observed(events: DataFrame) -> DataFrame:
    """stream_id, dialect, deltas, reads, writes (of the first usage event), output_tokens (the last told), completed, failed.

    events: stream_id, dialect, seq, name, data.
    """
    k = kind(F.col("dialect"), F.col("name"), F.col("data"))
    reads, writes = cache_tokens(F.col("dialect"), F.col("data"))
    e = events.withColumn("kind", k).withColumn("reads", reads).withColumn("writes", writes).withColumn("out", F.get_json_object("data", "$.usage.output_tokens").cast("long"))
    use = F.when((F.col("kind").isin("usage", "error")) & F.col("reads").isNotNull(), F.col("seq"))
    return e.groupBy("stream_id", "dialect").agg(
        F.count_if(F.col("kind") == "delta").alias("deltas"), F.min_by("reads", use).alias("reads"), F.min_by("writes", use).alias("writes"), F.max_by("out", F.when(F.col("out").isNotNull(), F.col("seq"))).alias("output_tokens"),
        F.max((F.col("kind") == "end") | F.coalesce(F.col("name") == "response.completed", F.lit(False))).alias("completed"), F.max(F.col("kind") == "error").alias("failed"),
    )


def cache_hit_rate(o: DataFrame) -> DataFrame:
    """dialect, rate: cache reads over reads and writes; null without data."""
    r, w = F.sum("reads"), F.sum("writes")
    return o.groupBy("dialect").agg(F.round(F.try_divide(r, r + w), 9).alias("rate"))


def model_streams(spark: SparkSession, d: str) -> DataFrame:
    """Invented streams of all three vocabularies from the events table."""
    e = read(spark, d, "events")
    n, m = (F.col("event_id") % 97).cast("string"), (F.col("event_id") % 31).cast("string")
    s = F.col("user_id")
    dialect = F.when(s % 3 == 0, "messages").when(s % 3 == 1, "chat").otherwise("responses")
    t = F.col("event_type")
    name = F.when(s % 3 == 0, F.when(t == "view", "content_block_delta").when(t == "signup", "message_start").when(t == "purchase", "message_delta").when(t == "error", "error").otherwise("message_stop")).when(s % 3 == 2, F.when(t == "view", "response.output_text.delta").when(t == "signup", "response.completed").when(t == "error", "response.failed").otherwise("response.created"))
    two = lambda a, b, c: F.concat(F.lit(a), n, F.lit(b), m, F.lit(c))
    data = (
        F.when((s % 3 == 0) & (t == "signup"), two('{"message":{"usage":{"cache_read_input_tokens":', ',"cache_creation_input_tokens":', "}}}")).when((s % 3 == 0) & (t == "purchase"), F.concat(F.lit('{"usage":{"output_tokens":'), n, F.lit("}}")))
        .when((s % 3 == 1) & (t == "signup"), two('{"usage":{"prompt_tokens_details":{"cached_tokens":', ',"cache_write_tokens":', "}}}")).when((s % 3 == 1) & (t == "view"), F.lit('{"choices":[{"delta":{"content":"x"}}]}'))
        .when((s % 3 == 1) & (t == "error"), F.lit('{"error":{"code":1}}')).when((s % 3 == 1) & (t == "click"), F.lit("[DONE]"))
        .when((s % 3 == 2) & t.isin("signup", "error"), two('{"response":{"usage":{"input_tokens_details":{"cached_tokens":', ',"cache_write_tokens":', "}}}}")).otherwise(F.lit("{}"))
    )
    seq = F.row_number().over(Window.partitionBy("stream_id").orderBy("event_id")) - 1
    return e.select((s * 100 + F.dayofmonth("ts")).alias("stream_id"), "event_id", dialect.alias("dialect"), name.alias("name"), data.alias("data")).select("stream_id", "dialect", seq.alias("seq"), "name", "data")


def observe_into(events: DataFrame, out: str, usage: str, every: str | None = None):
    """Start a query that passes a stream of events through to `out` and notes each batch's usage by stream under `usage`;
    both are written once for each batch, also when it is run again.

    every: how often (`60 seconds`); without it, what is there is processed and the query ends. Totals of a stream are the
    sums and last values over its batches (see `observed_totals`)."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        observed(batch).write.mode("overwrite").parquet(f"{usage}/batch={number}")

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{usage}-state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def observed_totals(usage: DataFrame) -> DataFrame:
    """stream_id, dialect and totals over all batches: deltas add up, the first usage and the last output count stand."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)
    last = F.max_by("output_tokens", F.when(F.col("output_tokens").isNotNull(), F.col("batch"))).alias("output_tokens")
    return usage.groupBy("stream_id", "dialect").agg(F.sum("deltas").alias("deltas"), first("reads"), first("writes"), last, F.max("completed").alias("completed"), F.max("failed").alias("failed"))


#: Invented events of each vocabulary, with what they are.
SAMPLES = {
    "messages": [("message_start", "{}", "message_start"), ("content_block_delta", '{"delta":{"type":"thinking_delta"}}', "content_block_delta/thinking"), (None, '{"type":"content_block_delta","delta":{"type":"new"}}', "content_block_delta/unknown"), ("ping", "x", "ping"), ("what", "{}", "other")],
    "chat": [(None, "[DONE]", "done"), (None, '{"error":{"code":1}}', "error"), (None, '{"choices":[],"usage":{"a":1}}', "usage"), (None, '{"choices":[{"delta":{}}],"usage":null}', "chunk"), (None, "no json", "other")],
    "responses": [("response.created", "{}", "created"), ("response.incomplete", "{}", "terminated"), ("response.output_text.delta", "{}", "output_text/delta"), ("response.function_call_arguments.done", "{}", "function_call_arguments/done"), ("error", "{}", "error"), (None, '{"type":"response.output_item.added"}', "output_item/added"), ("response.in_progress", "{}", "other")],
}


def q_event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of invented events, their vocabulary by the path of their request."""
    from ..operators.bodies import _pick

    e = read(spark, d, "events")
    path = _pick(("/v1/messages", "/v1/chat/completions", "/v1/responses/compact"), F.col("user_id"))
    e = e.select("event_id", dialect_of(path).alias("dialect"))
    sample = F.coalesce(*[F.when(F.col("dialect") == k, F.element_at(F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(x).alias("data")) for n, x, _ in v]), (F.col("event_id") % len(v) + 1).cast("int"))) for k, v in SAMPLES.items()])
    e = e.withColumn("s", sample)
    return e.select("event_id", "dialect", event_kind(F.col("dialect"), F.col("s.name"), F.col("s.data")).alias("kind"))


def q_body_usage(spark: SparkSession, d: str) -> DataFrame:
    """Cache tokens of replies that are no streams."""
    e = read(spark, d, "events")
    n, m = (F.col("event_id") % 97).cast("string"), (F.col("event_id") % 31).cast("string")
    dialect = F.when(F.col("user_id") % 3 == 0, "messages").when(F.col("user_id") % 3 == 1, "chat").otherwise("responses")
    two = lambda a, b, c: F.concat(F.lit(a), n, F.lit(b), m, F.lit(c))
    body = (
        F.when(dialect == "messages", two('{"usage":{"cache_read_input_tokens":', ',"cache_creation_input_tokens":', "}}"))
        .when(dialect == "chat", two('{"usage":{"prompt_tokens_details":{"cached_tokens":', ',"cache_write_tokens":', "}}}")).otherwise(F.concat(F.lit('{"usage":{"input_tokens_details":{"cached_tokens":'), n, F.lit("}}}")))
    )
    reads, writes = body_usage(F.col("dialect"), F.col("body"))
    return e.select("event_id", dialect.alias("dialect"), body.alias("body")).select("event_id", reads.alias("reads"), writes.alias("writes"))


def q_stream_observed(spark: SparkSession, d: str) -> DataFrame:
    """Usage of the invented streams, observed while they are passed on."""
    from ..sources.io import new_folder

    at = new_folder(spark, "observed")
    s = model_streams(spark, d)
    s.write.parquet(f"{at}/in")
    observe_into(spark.readStream.schema(s.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/usage").awaitTermination()
    passed = spark.read.parquet(f"{at}/out")
    assert passed.count() == s.count()
    return observed_totals(spark.read.parquet(f"{at}/usage"))


def q_stream_usage(spark: SparkSession, d: str) -> DataFrame:
    return observed(model_streams(spark, d))


def q_cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return cache_hit_rate(observed(model_streams(spark, d)))


_U = """e AS (SELECT user_id * 100 + day(ts) AS stream_id, ['messages', 'chat', 'responses'][user_id % 3 + 1] AS dialect, event_id, event_type AS t, event_id % 97 AS n, event_id % 31 AS m FROM events),
 o AS (SELECT stream_id, dialect, count(*) FILTER (t = 'view') AS deltas, arg_min(n, event_id) FILTER (t = 'signup' OR (t = 'error' AND dialect = 'responses')) AS reads, arg_min(m, event_id) FILTER (t = 'signup' OR (t = 'error' AND dialect = 'responses')) AS writes,
 arg_max(n, event_id) FILTER (t = 'purchase' AND dialect = 'messages') AS output_tokens, bool_or(CASE dialect WHEN 'responses' THEN t = 'signup' ELSE t = 'click' END) AS completed, bool_or(t = 'error') AS failed FROM e GROUP BY 1, 2)"""
_KINDS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x[2]) for x in v)}][event_id % {len(v)} + 1]" for k, v in SAMPLES.items())
QUERIES = {"stream_usage": q_stream_usage, "cache_hit_rate": q_cache_hit_rate, "event_kinds": q_event_kinds, "body_usage": q_body_usage, "stream_observed": q_stream_observed}
ORACLES = {
    "stream_usage": f"WITH {_U} SELECT * FROM o",
    "stream_observed": f"WITH {_U} SELECT * FROM o",
    "event_kinds": f"SELECT event_id, dialect, CASE dialect {_KINDS} END AS kind FROM (SELECT event_id, ['messages', 'chat', 'responses'][user_id % 3 + 1] AS dialect FROM events)",
    "body_usage": "SELECT event_id, event_id % 97 AS reads, CASE WHEN user_id % 3 < 2 THEN event_id % 31 END AS writes FROM events",
    "cache_hit_rate": f"WITH {_U} SELECT dialect, round(sum(reads) / (sum(reads) + sum(writes)), 9) AS rate FROM o GROUP BY 1",
}
