"""Streams: frames cut at every place, late rows, state across batches."""

import os

from pyspark.sql import functions as F

from textloom.streaming import base, ledger, sse

BODY = "event: a\ndata: one\ndata: two\n\n: comment\n\ndata:x\n\nevent: end\r\ndata: y\r\n\r\nevent: open\ndata: z"
WANT = [("a", "one\ntwo"), (None, "x"), ("end", "y")]


def test_frames_cut_anywhere(spark):
    rows = [(k, i, part) for k in range(1, len(BODY)) for i, part in enumerate((BODY[:k], BODY[k:]))]
    df = spark.createDataFrame(rows, "stream_id long, chunk_no int, chunk string")
    got = {}
    for r in sse.frames(df).orderBy("stream_id", "seq").collect():
        got.setdefault(r["stream_id"], []).append((r["name"], r["data"]))
    assert len(got) == len(BODY) - 1 and all(v == WANT for v in got.values())


def test_frames_over_several_batches(spark, tmp_path):
    chunks = [(1, i, BODY[i * 5 : i * 5 + 5]) for i in range(len(BODY) // 5 + 1)]
    seen = set()
    for part in range(3):
        mine = [c for c in chunks if c[1] * 3 // len(chunks) == part]
        spark.createDataFrame(mine, "stream_id long, chunk_no int, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 60 * len(seen),) * 2)
            seen.add(f)
    src = spark.readStream.schema("stream_id long, chunk_no int, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = base.run_to_table(sse.frames_stream(src)).orderBy("seq").collect()
    assert [(r["name"], r["data"]) for r in out] == WANT


def test_late_rows_are_dropped(spark, tmp_path):
    seen = set()

    def add(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = set((tmp_path / "in").glob("*.parquet")) - seen
        for f in new:  # files are read in the order of their times
            os.utime(f, (1_700_000_000 + 60 * len(seen),) * 2)
        seen.update(new)

    row = lambda t: (1, t, 1, "view", 2.5, "{}")
    add([row("2026-01-01 00:10:00"), row("2026-01-01 00:20:00")])
    add([row("2026-01-01 06:00:00")])
    add([row("2026-01-01 06:10:00")])  # rows are compared with the watermark of the batch before
    add([row("2026-01-01 00:30:00"), row("2026-01-01 06:30:00")])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = base.run_to_table(ledger.hourly_ledger(src)).collect()
    assert [(str(r["hour"]), r["n"], r["total"]) for r in out] == [("2026-01-01 00:00:00", 2, 4)]
