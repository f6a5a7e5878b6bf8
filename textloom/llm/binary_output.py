"""Token-id matrices: best-fit-decreasing packing with a segment tree over the room left.

Documents are tokenized, packed and serialized where they are read: no shuffle. Each block of about `block_tokens` ids is
packed by itself, which bounds memory and costs at most a few part-filled sequences a block. Documents longer than a
sequence are split without loss. Ids are little-endian unsigned: 16 bits where the vocabulary allows, else 32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freed, small_batches, table
from .tokens import encode

SEQ_LEN = 2048
BLOCK_TOKENS = 4_000_000
ROWS = "shard int, block int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>, ids_crc32 long"


class Rooms:
    """Segment tree over room sizes 0..cap: counts of open bins, answering `smallest room >= need` in log(cap) steps."""

    def __init__(self, cap: int):
        self.size = 1 << cap.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(cap + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest open bin that still fits `need`; it leaves the tree."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right sibling holds a bin
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, cap: int) -> list[list[int]]:
    """Bins of item positions; items longest first (ties in order), each into the fullest bin that has room."""
    rooms, bins = Rooms(cap), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = rooms.take(n)
        if found is None:
            bins.append([k])
            room, at = cap, len(bins) - 1
        else:
            room, at = found
            bins[at].append(k)
        if room > n:
            rooms.put(room - n, at)
    return bins


def packed_matrices(docs: DataFrame, seq_len: int = SEQ_LEN, vocab: str = "byte_bpe_50k", vocab_size: int = 50_257, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence: ids padded to seq_len with 0, cu_seqlens (0, then cumulative segment ends),
    position_resets (where positions start again from the segment's place in its document: 0 for a document's first
    piece), and for each segment its document and the id it begins at.

    Null texts are empty documents (their closing id alone); null ids stay null in doc_ids; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def emit(shard: int, block: int, held: list) -> pd.DataFrame:
        parts = [(d, s, ids[s : s + seq_len]) for d, ids in held for s in range(0, len(ids), seq_len)]
        rows = []
        for r, bin_ in enumerate(best_fit_decreasing(np.array([len(p[2]) for p in parts]), seq_len)):
            own = [parts[k] for k in bin_]
            line = np.zeros(seq_len, dtype)
            ends = np.cumsum([len(p[2]) for p in own])
            line[: ends[-1]] = np.concatenate([p[2] for p in own])
            raw = line.tobytes()
            rows.append((shard, block, r, int(ends[-1]), raw, [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[0] for p in own], [p[1] for p in own], zlib.crc32(raw)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, held, total = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids = encode(text, vocab).astype(dtype)
                held.append((None if doc_id is None else int(doc_id), ids))
                total += len(ids)
                if total >= block_tokens:
                    yield emit(shard, block, held)
                    block, held, total = block + 1, [], 0
        if held:
            yield emit(shard, block, held)

    # ids travel as text: pandas would turn whole numbers beside a null into doubles
    return small_batches(docs).select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(freed(run), ROWS)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Sink: one folder a shard; each file is a matrix of fixed-width id rows beside its segment arrays."""
    packed.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def unpack(packed: DataFrame, vocab_size: int = 50_257) -> DataFrame:
    """(doc_id, start, ids) of every segment: the inverse of packed_matrices, for round trips and readers."""
    width = 2 if vocab_size <= 1 << 16 else 4
    seg = packed.select("input_ids", F.arrays_zip("doc_ids", "doc_starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b")).alias("s")).select("input_ids", F.inline("s"))
    return seg.select(F.col("doc_ids").alias("doc_id"), F.col("doc_starts").alias("start"), F.expr(f"substring(input_ids, a * {width} + 1, (b - a) * {width})").alias("ids"))


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(table(spark, sf_dir, "documents"))


QUERIES = {"op8_binary_output": op8_binary_output}
ORACLES: dict[str, str] = {}
