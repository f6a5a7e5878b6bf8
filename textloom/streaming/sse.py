"""Event streams: frames out of chunks, batch and streaming, and the totals observed in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.io import new_folder
from ..sources.tables import in_order, read
from . import base
from .base import run_keeping_state, run_to_table

#: An unfinished frame longer than this ends the parsing of its stream.
MAX_FRAME = 1 << 20


def fields(frame: Column) -> tuple[Column, Column]:
    """(name, data) of one frame: data lines joined by line feeds; comment lines skipped; null data without data lines."""
    rows = F.split(F.regexp_replace(frame, "\r\n", "\n"), "\n")
    value = lambda key: F.transform(F.filter(rows, lambda r: F.startswith(r, F.lit(f"{key}:"))), lambda r: F.regexp_replace(r, f"^{key}: ?", ""))
    data = value("data")
    return F.try_element_at(value("event"), F.lit(-1)), F.when(F.size(data) > 0, F.array_join(data, "\n"))


def render(name: Column, data: Column, event_id: Column | None = None) -> Column:
    """Wire text of an event: its name and id where there are any, a data line for each line of its data."""
    part = lambda key, c: F.coalesce(F.concat(F.lit(f"{key}: "), c, F.lit("\n")), F.lit(""))
    rows = F.transform(F.split(F.coalesce(data, F.lit("")), "\n"), lambda r: F.concat(F.lit("data: "), r, F.lit("\n")))
    return F.concat(part("event", name), F.lit("") if event_id is None else part("id", event_id), F.array_join(rows, ""), F.lit("\n"))


def frames(chunks: DataFrame, flush: bool = False) -> DataFrame:
    """stream_id, seq, name, data from chunks (stream_id, chunk_no, chunk) at rest.

    An unclosed last frame is left out, unless flush; a frame of more than MAX_FRAME bytes ends the parsing of its stream."""
    whole = chunks.groupBy("stream_id").agg(in_order(F.col("chunk"), F.col("chunk_no"), by="").alias("t"))
    cut = whole.select("stream_id", F.split(F.regexp_replace("t", "\r\n", "\n"), "\n\n").alias("a"))
    over = F.array_position(F.transform("a", lambda f: F.octet_length(f) > MAX_FRAME), True)
    told = F.size("a") - (0 if flush else 1)
    cut = cut.select("stream_id", F.posexplode(F.slice("a", F.lit(1), F.when(over > 0, F.least(told, over - 1)).otherwise(told).cast("int"))).alias("seq", "frame"))
    name, data = fields(F.col("frame"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), name.alias("name"), data.alias("data")).where("data IS NOT NULL OR name IS NOT NULL")


def frames_stream(chunks: DataFrame, idle: str | None = None) -> DataFrame:
    """The same over a stream of chunks: state is each stream's next number and unfinished text.

    idle: milliseconds of processing time without a chunk after which a stream counts as finished: its unfinished frame is
    given out and its state removed. Without it, streams stay open.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, rest = state.get if state.exists else (0, "")
        done: list[str] = []
        if state.hasTimedOut:
            done = [rest] if seq >= 0 and rest else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("chunk_no")
            if seq >= 0:
                parts = (rest + "".join(rows["chunk"])).replace("\r\n", "\n").split("\n\n")
                over = next((i for i, p in enumerate(parts) if len(p.encode("utf-8", "surrogatepass")) > MAX_FRAME), len(parts))
                done, rest = parts[: min(over, len(parts) - 1)], parts[-1]
                state.update((-1, "") if over < len(parts) else (seq + len(done), rest))
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({"stream_id": [key[0]] * len(done), "seq": range(seq, seq + len(done)), "frame": done})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    cut = chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, frame string", "seq long, rest string", "append", timeout)
    name, data = fields(F.col("frame"))
    return cut.select("stream_id", "seq", name.alias("name"), data.alias("data")).where("data IS NOT NULL OR name IS NOT NULL")


class Framing(StatefulProcessor):
    """Rows (chunk_no, chunk, at) of one stream, at in milliseconds of event time: chunks; a null chunk says nothing.

    Variables: the unfinished text with the number of the next chunk and of the next frame (a negative one: ended by a frame
    too long), the chunks that came before their turn, and when the stream counts as finished.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "rest string, chunk long, frame long")
        self.waiting = handle.getListState("waiting", "chunk_no long, chunk string")
        self.due = handle.getValueState("due", "at long")

    def _frames(self, key: tuple, number: int, done: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]] * len(done), "seq": range(number, number + len(done)), "frame": pd.Series(done, dtype=object)})

    def _taken(self, rest: str, frame: int, chunks: list[str]) -> tuple[list[str], str, int]:
        """(finished frames, unfinished text, number of the next frame)."""
        parts = (rest + "".join(chunks)).replace("\r\n", "\n").split("\n\n")
        long = next((i for i, p in enumerate(parts) if len(p.encode("utf-8", "surrogatepass")) > MAX_FRAME), len(parts))
        done = parts[: min(long, len(parts) - 1)]
        return (done, "", -1) if long < len(parts) else (done, parts[-1], frame + len(done))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, frame, done = pd.concat(list(rows)).dropna(subset=["chunk"]), 0, []
        if len(own):
            last, waits = int(own["at"].max()) + self.idle, self.due.exists()
            self.due.update((max(last, self.due.get()[0]) if waits else last,))
            if not waits:  # one timer a stream: when it comes too early it is set again
                self.handle.registerTimer(last)
            rest, due, frame = self.read.get() if self.read.exists() else ("", 0, 0)
            if frame >= 0:
                held = dict(self.waiting.get()) if self.waiting.exists() else {}
                held |= {n: c for n, c in zip(own["chunk_no"].tolist(), own["chunk"], strict=True) if n >= due}
                turn = []
                while due in held:
                    turn.append(held.pop(due))
                    due += 1
                done, rest, after = self._taken(rest, frame, turn)
                self.read.update((rest, due, after))
                if held and after >= 0:
                    self.waiting.put(sorted(held.items()))
                else:
                    self.waiting.clear()
        yield self._frames(key, frame, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame, done, due = 0, [], self.due.get()[0]
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            rest, _, frame = self.read.get()
            if frame >= 0:  # what waits for a chunk that never came follows without it
                done, rest, _ = self._taken(rest, frame, [c for _, c in sorted(self.waiting.get())] if self.waiting.exists() else [])
                done += [rest] if rest.strip("\n") else []
            for variable in (self.read, self.waiting, self.due):
                variable.clear()
        yield self._frames(key, frame, done)

    def close(self) -> None:
        pass


def frames_by_time(chunks: DataFrame, idle_seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """stream_id, seq, name, data from a stream of chunks (stream_id, chunk_no from 0, chunk, ts), whatever batches and order
    they come in: a chunk waits for those before it.

    A stream without a chunk for idle_seconds of event time is finished: its unfinished frame is given out and nothing of it
    stays in the state. A frame of more than MAX_FRAME bytes ends the parsing of its stream. Chunks later than `late` behind
    the newest are dropped.
    """
    c = chunks.withWatermark("ts", late).select("ts", "stream_id", "chunk_no", "chunk", F.unix_millis("ts").alias("at"))
    cut = c.groupBy("stream_id").transformWithStateInPandas(Framing(idle_seconds * 1000), "stream_id long, seq long, frame string", "append", "eventTime")
    name, data = fields(F.col("frame"))
    return cut.select("stream_id", "seq", name.alias("name"), data.alias("data")).where("data IS NOT NULL OR name IS NOT NULL")


def totals(events: DataFrame) -> DataFrame:
    """stream_id, deltas, bytes, last name: what an observer notes of each stream."""
    return events.groupBy("stream_id").agg(F.count_if(F.col("name") == "assistant").alias("deltas"), F.sum(F.octet_length("data")).alias("bytes"), F.max_by("name", "seq").alias("last_name"))


def conversation_chunks(spark: SparkSession, d: str, size: int = 16) -> DataFrame:
    """Each conversation as one event stream, cut into chunks of `size` characters."""
    c = read(spark, d, "conversations")
    frame = F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.regexp_replace(F.regexp_replace("text", r"\n{2,}", "\n"), "\n", "\ndata: "), F.lit("\n\n"))
    whole = c.groupBy("conv_id").agg(in_order(frame, F.col("turn"), by="").alias("t"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / size).cast("int"))).alias("chunk_no")
    return whole.select(F.col("conv_id").alias("stream_id"), "t", at).select("stream_id", "chunk_no", F.substring(F.col("t"), F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def q_sse_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames(conversation_chunks(spark, d))


def q_sse_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals(frames(conversation_chunks(spark, d)))


def q_sse_frames_streamed(spark: SparkSession, d: str) -> DataFrame:
    path = f"{base.new_folder(spark)}/chunks"
    conversation_chunks(spark, d).repartition("stream_id").sortWithinPartitions("stream_id", "chunk_no").write.parquet(path)
    source = spark.readStream.schema("stream_id long, chunk_no int, chunk string").parquet(path)
    return run_to_table(frames_stream(source))


def q_sse_frames_flushed(spark: SparkSession, d: str) -> DataFrame:
    """Streams that break off before the end of their last frame, a chunk a second, and a silent stream that goes on."""
    whole = conversation_chunks(spark, d).groupBy("stream_id").agg(in_order(F.col("chunk"), F.col("chunk_no"), by="").alias("t"))
    cut = whole.select("stream_id", F.regexp_replace("t", r"\n\n\z", "").alias("t"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 64).cast("int"))).alias("chunk_no")
    chunks = cut.select("stream_id", "t", at).select("stream_id", "chunk_no", F.substring(F.col("t"), F.col("chunk_no") * 64 + 1, F.lit(64)).alias("chunk"), F.timestamp_seconds(F.col("chunk_no") + 1_700_000_000).alias("ts"))
    last = chunks.agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")).select(F.lit(-1).cast("long").alias("stream_id"), F.lit(0).alias("chunk_no"), F.lit(None).cast("string").alias("chunk"), "ts")
    path = f"{new_folder(spark)}/chunks"
    chunks.unionByName(last).write.parquet(path)
    return run_keeping_state(frames_by_time(spark.readStream.schema("stream_id long, chunk_no int, chunk string, ts timestamp").parquet(path)))[0]


def q_sse_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Frames back as wire text."""
    f = frames(conversation_chunks(spark, d))
    return f.groupBy("stream_id").agg(F.sha2(in_order(render(F.col("name"), F.col("data"), F.col("seq").cast("string")), F.col("seq"), by=""), 256).alias("sha"))


_F = "fr AS (SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS name, regexp_replace(text, '\\n{2,}', chr(10), 'g') AS data FROM conversations)"
QUERIES = {"sse_frames": q_sse_frames, "sse_totals": q_sse_totals, "sse_frames_streamed": q_sse_frames_streamed, "sse_frames_flushed": q_sse_frames_flushed, "sse_rendered": q_sse_rendered}
ORACLES = {
    "sse_frames": f"WITH {_F} SELECT * FROM fr",
    "sse_totals": f"WITH {_F} SELECT stream_id, count(*) FILTER (name = 'assistant') AS deltas, sum(strlen(data))::BIGINT AS bytes, arg_max(name, seq) AS last_name FROM fr GROUP BY 1",
    "sse_rendered": f"WITH {_F} SELECT stream_id, sha256(string_agg('event: ' || name || chr(10) || 'id: ' || seq || chr(10) || 'data: ' || replace(data, chr(10), chr(10) || 'data: ') || chr(10) || chr(10), '' ORDER BY seq)) AS sha FROM fr GROUP BY 1",
    "sse_frames_streamed": f"WITH {_F} SELECT * FROM fr",
    "sse_frames_flushed": f"WITH {_F} SELECT * FROM fr",
}
