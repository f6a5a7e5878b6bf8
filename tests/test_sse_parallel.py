"""The chunks of a stream query are written by many tasks, and its frames still match."""

from glob import glob

from tests.compare import same
from textloom import plans
from textloom.streaming import base


def test_chunks_in_many_files(spark, duck, sf_dir, monkeypatch):
    made, new = [], base.new_folder
    monkeypatch.setattr(base, "new_folder", lambda *a: made.append(new(*a)) or made[-1])
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plans.queries()["sse_frames_streamed"](spark, sf_dir)
        same(got, duck.execute(plans.oracle_sql()["sse_frames_streamed"]).fetchdf())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(glob(f"{made[0].removeprefix('file://')}/chunks/*.parquet")) > 1
