"""The content store on a stream: contents under their hashes, whose entries expire, and whose expiry a new put extends.

State is an entry a hash, held by buckets of hashes with a timeout of event time each. What is live is read from the state itself.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from .base import read_state, run_keeping_state
from .ledger import event_stream

LIFETIME = "hash string, content string, stored_at long, expires_at long, puts long"
#: Of each hash of a bucket: its content, its entry (nulls if it has none), and the times of puts that the watermark has not passed.
STATE = "hash array<string>, content array<string>, stored_at array<long>, expires_at array<long>, puts array<long>, waiting array<array<long>>"
#: Groups of hashes whose state comes and goes together; more hashes than some millions want more of them.
BUCKETS = 4096


def _lifetimes(ttl: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames of (hash, content, at) of one bucket, at in microseconds: puts, which wait until the watermark has passed them and
    then count in the order of their times. Gives out each lifetime once it has ended."""
    now = state.getCurrentWatermarkMs() * 1000
    held = {h: (c, s, e, n, list(w)) for h, c, s, e, n, w in zip(*state.get, strict=True)} if state.exists else {}
    for f in frames:
        for h, c, at in zip(f["hash"], f["content"], f["at"].tolist(), strict=True):
            held.setdefault(h, (c, None, None, 0, []))[4].append(at)
    ended, left, wake = [], [], []
    for h, (content, stored_at, expires_at, puts, waiting) in held.items():
        waiting.sort()
        due = bisect_right(waiting, now)
        for at in waiting[:due]:
            if stored_at is None or at >= expires_at:
                ended += [] if stored_at is None else [(h, content, stored_at, expires_at, puts)]
                stored_at, puts = at, 0
            expires_at, puts = at + ttl, puts + 1
        if stored_at is not None and expires_at <= now:
            ended.append((h, content, stored_at, expires_at, puts))
            stored_at, expires_at, puts = None, None, 0
        if after := waiting[due : due + 1] + ([] if stored_at is None else [expires_at]):
            left.append((h, content, stored_at, expires_at, puts, waiting[due:]))
            wake.append(min(after))
    if left:
        state.update(tuple(map(list, zip(*left, strict=True))))
        state.setTimeoutTimestamp(max(1, -(-min(wake) // 1000) - 1))  # comes once the watermark is over this, that is at `wake`
    elif state.exists:
        state.remove()
    if ended:
        yield pd.DataFrame(ended, columns=["hash", "content", "stored_at", "expires_at", "puts"])


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in ("stored_at", "expires_at")})


def keep(puts: DataFrame, ttl_seconds: int = 24 * 3600, late: str = "1 hour") -> DataFrame:
    """hash, content, stored_at, expires_at, puts of every entry that has expired, over a stream of puts (content, ts).

    An entry lives for ttl_seconds after its last put; a put at or after that begins a new one. Everything is as of the
    watermark, `late` behind the newest put, so that batches and their order make no difference; puts later than that are
    dropped. Null contents are not stored. Hashes are kept by the bucket, so that
    Python is called for a bucket and not for each hash.
    """
    p = puts.where("content IS NOT NULL").withWatermark("ts", late).select("ts", T.content_hash(F.col("content")).alias("hash"), "content", F.unix_micros("ts").alias("at"))
    out = p.withColumn("bucket", F.pmod(F.crc32("hash"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(partial(_lifetimes, ttl_seconds * 1_000_000), LIFETIME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _times(out)


def live(spark: SparkSession, folder: str) -> DataFrame:
    """hash, content, stored_at, expires_at, puts of the entries that a stream of `keep` in this folder holds, as of its
    watermark."""
    s = read_state(spark, folder)
    names = ("hash", "content", "stored_at", "expires_at", "puts")
    held = s.select(F.explode(F.arrays_zip(*[F.col(f"value.groupState.{n}").alias(n) for n in names])).alias("s")).select("s.*").toDF(*names)
    return _times(held.where("stored_at IS NOT NULL"))


def _puts(events: DataFrame) -> DataFrame:
    return events.select("ts", F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "type": "'), "event_type", F.lit('"}')).alias("content"))


def q_stream_contents(spark: SparkSession, d: str) -> DataFrame:
    """Every lifetime of what users put, ended or not."""
    ended, folder = run_keeping_state(keep(_puts(event_stream(spark, d))))
    status = lambda df, s: df.select("hash", "stored_at", "expires_at", "puts", F.lit(s).alias("status"))
    return status(ended, "expired").unionByName(status(live(spark, folder), "live"))


QUERIES = {"stream_contents": q_stream_contents}
ORACLES = {
    "stream_contents": """WITH wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM events), p AS (SELECT ts, left(sha256('{"user": ' || user_id || ', "type": "' || event_type || '"}'), 32) AS hash FROM events, wm WHERE ts <= wm),
 g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 24 HOUR, true) AS fresh FROM p WINDOW w AS (PARTITION BY hash ORDER BY ts)), n AS (SELECT hash, ts, sum(fresh::INT) OVER (PARTITION BY hash ORDER BY ts) AS life FROM g),
 l AS (SELECT hash, min(ts) AS stored_at, max(ts) + INTERVAL 24 HOUR AS expires_at, count(*) AS puts FROM n GROUP BY hash, life)
 SELECT *, CASE WHEN lead(hash) OVER (PARTITION BY hash ORDER BY stored_at) IS NOT NULL OR expires_at <= (SELECT wm FROM wm) THEN 'expired' ELSE 'live' END AS status FROM l"""
}
