"""A savings ledger that a stream adds to: sums by key at several levels, each batch counted once.

Every batch is a file of sums of its own, written again as a whole if the batch is run again; reading adds them up. From time
to time they are compacted into a base that names the last batch it holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.accounting import _O, outcomes_of
from ..sources.io import folders, new_folder, remove_folder
from ..sources.tables import read

KEYS = ("level", "hour", "family", "content_type")
SUMS = ("compressions", "passthroughs", "tokens_before", "tokens_after")
SCHEMA = "level string, hour timestamp, family string, content_type string, compressions long, passthroughs long, tokens_before long, tokens_after long"
#: Levels of the ledger and the columns each keeps: every hour's shapes, families by day, families, and all.
LEVELS = {"hour": ("h", "family", "content_type"), "day": ("d", "family"), "family": ("family",), "all": ()}
#: Seconds between two flushes, and between two purges.
FLUSH_SECONDS, PURGE_SECONDS = 60, 300


def rolled_up(o: DataFrame) -> DataFrame:
    """The ledger's rows of some outcomes, all levels in one pass; `hour` is the start of the hour or day, else null."""
    made = F.col("after") < F.col("before")
    t = o.select("family", "content_type", "before", "after", made.alias("made"), F.date_trunc("hour", "ts").alias("h"), F.date_trunc("day", "ts").alias("d"))
    every = ("h", "d", "family", "content_type")
    sums = [F.count_if("made").alias("compressions"), F.count_if(~F.col("made")).alias("passthroughs"), F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after")]
    g = t.groupingSets([[F.col(c) for c in cols] for cols in LEVELS.values()], *every).agg(F.grouping_id(*every).alias("set"), *sums)
    # a column that a set leaves out has its bit, the first column the highest
    number = {level: sum(1 << 3 - i for i, c in enumerate(every) if c not in cols) for level, cols in LEVELS.items()}
    level = F.coalesce(*[F.when(F.col("set") == n, F.lit(k)) for k, n in number.items()])
    return g.select(level.alias("level"), F.coalesce("h", "d").alias("hour"), "family", "content_type", *SUMS)


class LedgerTable:
    """Sums by KEYS in a folder: `delta/batch=N` for each batch, `base/upto=N` for all up to N. A folder counts once its
    write is complete; of bases the last one does, and batches that it holds are not read or written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in folders(self.spark, f"{self.path}/{kind}"))

    def held(self) -> int:
        """Last batch of the base; -1 where there is none."""
        return max(self._numbers("base"), default=-1)

    def _parts(self) -> tuple[list[str], list[int]]:
        base = self.held()
        later = [n for n in self._numbers("delta") if n > base]
        return ([f"{self.path}/base/upto={base}"] if base >= 0 else []) + [f"{self.path}/delta/batch={n}" for n in later], later

    def add(self, rows: DataFrame, batch: int) -> None:
        """Count a batch; again if it was counted before, with the same result."""
        if batch > self.held():
            rows.select(*KEYS, *SUMS).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def read(self) -> DataFrame:
        paths = self._parts()[0]
        t = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return t.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def compact(self) -> int:
        """Put what is there into a new base, then remove what it holds; returns the number of batches that went into it."""
        later = self._parts()[1]
        if later:
            old = self.held()
            self.read().coalesce(1 + len(later) // 1000).write.mode("overwrite").parquet(f"{self.path}/base/upto={later[-1]}")
            for n in [n for n in self._numbers("delta") if n <= later[-1]]:
                remove_folder(self.spark, f"{self.path}/delta/batch={n}")
            if old >= 0:
                remove_folder(self.spark, f"{self.path}/base/upto={old}")
        return len(later)


class Periodic:
    """A job that runs when it is asked at least `seconds` after it last ran; clock: seconds that only grow."""

    def __init__(self, seconds: float, job: Callable[[], object], clock: Callable[[], float] = time.monotonic):
        self.seconds, self.job, self.clock, self.last = seconds, job, clock, clock()

    def ask(self) -> bool:
        now = self.clock()
        due = now - self.last >= self.seconds
        if due:
            self.last = now
            self.job()
        return due


def keep_ledger(events: DataFrame, table: LedgerTable, folder: str, available: bool = False, jobs: tuple[Periodic, ...] | None = None):
    """Start a query that adds the outcomes of a stream of events to the ledger every FLUSH_SECONDS, and asks the jobs after
    each batch (by default: compaction every PURGE_SECONDS). available: what is there now, and then end."""
    own = (Periodic(PURGE_SECONDS, table.compact),) if jobs is None else jobs

    def step(batch: DataFrame, number: int) -> None:
        table.add(rolled_up(outcomes_of(batch)), number)
        for job in own:
            job.ask()

    trigger = {"availableNow": True} if available else {"processingTime": f"{FLUSH_SECONDS} seconds"}
    return events.writeStream.option("checkpointLocation", folder).trigger(**trigger).foreachBatch(step).start()


def q_stream_savings_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after four batches, compacted after the second."""
    at, clock = new_folder(spark, "ledger"), iter(range(0, 1000, 200))
    e = read(spark, d, "events")
    e.repartition(4, "event_id").write.parquet(f"{at}/events")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/events")
    table = LedgerTable(spark, f"{at}/ledger")
    keep_ledger(source, table, f"{at}/state", True, (Periodic(300, table.compact, lambda: next(clock)),)).awaitTermination()
    return table.read()


_LEVEL_SQL = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {hour} AS hour, {family} AS family, {kind} AS content_type, {', '.join(f'sum({c})::BIGINT AS {c}' for c in SUMS)} FROM ho GROUP BY ALL"
    for level, hour, family, kind in (("hour", "hour", "family", "content_type"), ("day", "date_trunc('day', hour)::TIMESTAMP", "family", "NULL"), ("family", "NULL::TIMESTAMP", "family", "NULL"), ("all", "NULL::TIMESTAMP", "NULL", "NULL"))
)
QUERIES = {"stream_savings_rollup": q_stream_savings_rollup}
ORACLES = {"stream_savings_rollup": f"WITH {_O} {_LEVEL_SQL}"}
