"""Running a bounded stream to its end and reading what it wrote, or what its state holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import new_folder

#: A keyed state with timers and several variables lies in RocksDB: bounded memory, and no disk taken before it is needed.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    for k, v in STATE_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available and return it as a table. mode complete: the last full result."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_keeping_state(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Process what is available; (all it has written, the folder of its state). Given the same folder again, it goes on."""
    spark = stream.sparkSession
    at = folder or new_folder(spark, "stream")
    with state_on_disk(spark):
        stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").option("path", f"{at}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out"), at


def read_state(spark: SparkSession, folder: str, variable: str | None = None) -> DataFrame:
    """The rows (key, value, …) of one state variable, or of a state without variables, as the last batch left them."""
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(f"{folder}/state")
