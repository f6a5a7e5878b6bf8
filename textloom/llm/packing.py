"""Packing by shortest-pack-first over the length histogram.

Documents are tokenized once and cut into full pieces and one rest; the pieces (ids only as a checksum) are a written
table. Only the histogram of lengths (at most `max_len` rows) reaches the driver, which makes packing patterns. Patterns
join back to pieces by rank within a length. Hot lengths are ranked in many cells, so no length is ever in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import freed, materialize, small_batches, table
from .tokens import encode

MAX_LEN = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows of the interval table up to which it is broadcast; it has at most a few rows for each pair of length and pattern.
BROADCAST_INTERVALS = 200_000


def pieces(docs: DataFrame, max_len: int = MAX_LEN, vocab: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of at most max_len ids; every id, with the closing one, lies in exactly one piece.

    Null and empty texts are their closing id alone; null ids stay null; repeated rows are cut each; other columns are not
    looked at; an empty table gives no rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids = encode(text, vocab)
                n = len(ids)
                rows += [(doc_id, s, min(max_len, n - s), zlib.crc32(ids[s : s + max_len]), n) for s in range(0, n, max_len)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    cut_up = small_batches(docs).select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(freed(cut), PIECES.replace("doc_id long", "doc_id string"))
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths of a pattern)]: lengths are placed longest first, each into the emptiest open pattern it fits."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    closed: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in open_ if s >= length), default=0)
            if not space:
                put, pattern, space = left, (), max_len
            else:
                n, pattern = open_[space].pop()
                put = min(n, left)
                if n > put:
                    open_[space].append((n - put, pattern))
                elif not open_[space]:
                    del open_[space]
            left -= put
            rest = space - length
            (open_[rest] if rest else closed).append((put, (*pattern, length)))
    return closed + [p for s in sorted(open_) for p in open_[s]]


def intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, slots, first sequence, first offset): ranks lo..hi-1 of a length fill one pattern's slots."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            slots = pattern.count(length)
            out.append((length, used[length], used[length] + count * slots, slots, first, offset))
            used[length] += count * slots
            offset += slots * length
        first += count
    return out


def pack(piece_rows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    Ties of equal lengths go by doc_id, start and checksum; pieces alike in all of them are interchangeable. An empty
    table gives no rows.
    """
    spark = piece_rows.sparkSession
    histogram = {r["length"]: r["n"] for r in piece_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = intervals(shortest_pack_first(histogram, max_len))
    # cells: parts of one length, several for each task, so that ranking never gathers a frequent length in one task
    per_cell = max(64, min(50_000, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cells = spark.createDataFrame([(k, -(-n // per_cell)) for k, n in histogram.items()], "length long, cells long")
    ranges = spark.createDataFrame(rows, "length long, lo long, hi long, slots long, first long, at long")
    if len(rows) <= BROADCAST_INTERVALS:
        ranges = F.broadcast(ranges)
    celled = piece_rows.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("cells")))
    sizes = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = celled.withColumn("rn", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    placed = ranked.join(ranges, "length").where("rank >= lo AND rank < hi")
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("slots"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("slots")) * F.col("length")).cast("long").alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(pieces(table(spark, sf_dir, "documents")), "pieces"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
