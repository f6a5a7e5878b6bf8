"""Keyed state with timers, and the ledger of a stream: any cut into batches, runs that go on, batches run again."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators.accounting import outcomes_of
from textloom.sources.io import folders, new_folder
from textloom.streaming import base, contents, ledger, rollups, sse

START = datetime(2026, 1, 1)


def files(spark, path, batches, schema):
    """One file a batch, read in this order."""
    seen = set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in {os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")} - seen:
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
            seen.add(f)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


PUTS = "content string, ts timestamp"


def hours(*at):
    return [START + timedelta(hours=h) for h in at]


def test_a_put_extends_and_what_expires_goes(spark, tmp_path):
    a, b = hours(0, 20, 43, 68, 200), hours(1, 26)
    rows = [("a", t) for t in a] + [("b", t) for t in b] + [("c", START + timedelta(hours=201)), ("end", START + timedelta(hours=210)), (None, START)]
    want = {("a", a[0], a[2] + timedelta(hours=24), 3), ("a", a[3], a[3] + timedelta(hours=24), 1), ("b", b[0], b[0] + timedelta(hours=24), 1), ("b", b[1], b[1] + timedelta(hours=24), 1)}
    for n, cut in enumerate(([rows], [rows[:3], rows[3:]], [rows[5:7], rows[:3], rows[3:5] + rows[7:]])):
        path = str(tmp_path / f"in{n}")
        files(spark, path, cut, PUTS)
        ended, folder = base.run_keeping_state(contents.keep(source(spark, path, PUTS), late="60 hours"))
        got = {(r["content"], r["stored_at"], r["expires_at"], r["puts"]) for r in ended.collect()}
        assert got == want  # the watermark is at hour 150
        assert contents.live(spark, folder).count() == 0


def test_the_state_goes_on_and_holds_what_is_live(spark, tmp_path):
    path, folder = str(tmp_path / "in"), new_folder(spark, "contents")
    files(spark, path, [[("a", START), ("b", START + timedelta(hours=3))]], PUTS)
    base.run_keeping_state(contents.keep(source(spark, path, PUTS)), folder)
    assert {r["content"] for r in contents.live(spark, folder).collect()} == {"a"}  # b is not past the watermark yet
    spark.createDataFrame([("a", START + timedelta(hours=20)), ("c", START + timedelta(hours=30))], PUTS).coalesce(1).write.mode("append").parquet(path)
    ended, _ = base.run_keeping_state(contents.keep(source(spark, path, PUTS)), folder)
    live = {r["content"]: (r["puts"], r["expires_at"]) for r in contents.live(spark, folder).collect()}
    assert live == {"a": (2, START + timedelta(hours=44))} and [r["content"] for r in ended.collect()] == ["b"]


CHUNKS = "stream_id long, chunk_no int, chunk string, ts timestamp"
BODY = "event: a\ndata: one\ndata: two\n\n: comment\n\ndata:x\n\nevent: end\r\ndata: y\r\n\r\nevent: open\ndata: z"
WANT = [(0, "a", "one\ntwo"), (2, None, "x"), (3, "end", "y"), (4, "open", "z")]


@pytest.mark.parametrize("order", ["together", "in turn", "backwards"])
def test_frames_of_any_cut_with_the_tail(spark, tmp_path, order):
    size = 7
    rows = [(s, i, BODY[i * size : (i + 1) * size], START + timedelta(seconds=i)) for s in (1, 2) for i in range(-(-len(BODY) // size))]
    cut = {"together": [rows], "in turn": [rows[i::3] for i in range(3)], "backwards": [rows[8:][::-1], rows[:8]]}[order]
    path = str(tmp_path / "in")
    files(spark, path, [*cut, [(3, 0, None, START + timedelta(hours=1))]], CHUNKS)
    out, folder = base.run_keeping_state(sse.frames_by_time(source(spark, path, CHUNKS), late="5 minutes"))
    for s in (1, 2):
        assert [(r["seq"], r["name"], r["data"]) for r in out.where(F.col("stream_id") == s).orderBy("seq").collect()] == WANT
    assert all(base.read_state(spark, folder, v).count() == 0 for v in ("read", "due"))


def test_frames_too_long_and_chunks_that_never_come(spark, tmp_path, monkeypatch):
    long = "data: ok\n\ndata: " + "x" * (sse.MAX_FRAME + 1) + "\n\ndata: never\n\n"
    rows = [(1, 0, long, START), (1, 1, "data: nor this\n\n", START), (2, 0, "data: p\n\nda", START), (2, 2, "ta: q\n\nrest", START), (2, 3, ": r", START), (9, 0, None, START + timedelta(hours=1))]
    path = str(tmp_path / "in")
    files(spark, path, [rows], CHUNKS)
    out = base.run_keeping_state(sse.frames_by_time(source(spark, path, CHUNKS)))[0]
    got = sorted((r["stream_id"], r["seq"], r["data"]) for r in out.where("data IS NOT NULL").collect())
    assert got == [(1, 0, "ok"), (2, 0, "p"), (2, 1, "q")]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(ids):
    return [(i, START + timedelta(hours=i), i % 5, ["view", "error"][i % 2], float(i), "{}") for i in ids]


def test_a_batch_run_again_changes_nothing(spark):
    table = rollups.LedgerTable(spark, new_folder(spark, "ledger"))
    told = lambda: sorted(map(str, table.read().collect()))
    assert table.read().count() == 0 and table.compact() == 0
    parts = [spark.createDataFrame(events(range(i, 60, 3)), EVENTS) for i in range(3)]
    sums = [rollups.rolled_up(outcomes_of(p)) for p in parts]
    for i, s in enumerate(sums[:2]):
        table.add(s, i)
    before = told()
    table.add(sums[1], 1)
    assert told() == before
    assert table.compact() == 2 and told() == before and table.held() == 1
    table.add(sums[0], 0)  # in the base already
    table.add(sums[2], 2)
    whole = rollups.rolled_up(outcomes_of(spark.createDataFrame(events(range(60)), EVENTS)))
    assert told() == sorted(map(str, whole.select(*table.read().columns).collect()))
    assert table.compact() == 1 and folders(spark, f"{table.path}/base") == ["upto=2"] and folders(spark, f"{table.path}/delta") == []


def test_periodic_jobs(spark):
    clock, ran = iter([0, 100, 299, 300, 350, 601]), []
    job = rollups.Periodic(300, lambda: ran.append(1), lambda: next(clock))
    assert [job.ask() for _ in range(5)] == [False, False, True, False, True] and len(ran) == 2


CALLS = "event_id long, user_id long, ts timestamp"


def test_limits_over_batches_and_runs(spark, tmp_path):
    """Windows go on over batches and runs; what comes too late is dropped; a null user is one user; no Python at all."""
    at = lambda *minutes: [START + timedelta(minutes=m) for m in minutes]
    a, b, c, late, n1, n2, n3, far = at(1, 2, 3, 1, 4, 5, 6, 500)
    batches = [[(1, 7, a), (3, 7, c), (9, None, n1)], [(2, 7, b), (10, None, n2), (11, None, n3), (20, 8, far)], [(4, 7, late), (21, 8, far)]]
    path, folder = str(tmp_path / "in"), new_folder(spark, "limited")
    files(spark, path, batches[:2], CALLS)
    run = lambda: ledger.run_limited(source(spark, path, CALLS), 2, 3600, "10 minutes", folder)
    want = {1: True, 3: True, 2: False, 9: True, 10: True, 11: False, 20: True}
    assert {r["event_id"]: r["allowed"] for r in run().collect()} == want
    spark.createDataFrame(batches[2], CALLS).coalesce(1).write.mode("append").parquet(path)
    assert {r["event_id"]: r["allowed"] for r in run().collect()} == want | {21: True}
    e = spark.createDataFrame(batches[0], CALLS)
    assert "Python" not in ledger.limit_batch(e, spark.createDataFrame([], ledger.COUNTS), 2, 3600)._jdf.queryExecution().executedPlan().toString()


def test_hashes_are_held_by_the_bucket(spark, tmp_path, monkeypatch):
    """state comes and goes by the bucket; what the watermark (hour 24) just reaches counts, or has ended."""
    monkeypatch.setattr(contents, "BUCKETS", 2)
    path = str(tmp_path / "in")
    rows = [(f"c{i}", START + timedelta(hours=2)) for i in range(50)] + [("a", START), ("b", START + timedelta(hours=24)), ("end", START + timedelta(hours=25))]
    files(spark, path, [rows], PUTS)
    ended, folder = base.run_keeping_state(contents.keep(source(spark, path, PUTS)))
    assert [(r["content"], r["puts"]) for r in ended.collect()] == [("a", 1)]
    assert {r["content"] for r in contents.live(spark, folder).collect()} == {f"c{i}" for i in range(50)} | {"b"}
    assert spark.read.format("statestore").load(f"{folder}/state").count() <= 2
