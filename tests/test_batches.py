"""Written tables of long texts are read, and sent to Python, a few megabytes at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.sources.io import settle


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])


def test_batches_of_long_texts_stay_small(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    texts = settle(own.range(0, 600, 1, 1).select("id", F.repeat(F.lit("a line of a long text\n"), F.lit(2500)).alias("content")))
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "128"
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 600 and max(r["bytes"] for r in got) < 8 << 20


def test_batches_set_in_the_session_stay(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    settle(own.range(3))
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"
