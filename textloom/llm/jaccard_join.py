"""N-gram Jaccard join by signature trees, as linked components.

1. Every document becomes a set of hashed word shingles; equal sets are one node (a 64-bit key of the whole set).
2. A filter deals the sets to the trees: the first shingles of each set, by hash, go to buckets, packed. A bucket counts in
   how many sets each lies and tells each set which of its own are shared. A set that shares too few of them links with
   nothing. The rest are grouped by their rarest shingles (any two sets over the threshold share one of these).
3. Within a group the whole sets are compared by signature trees: nodes hold OR-combined bitmaps and size ranges, and a dual
   traversal drops node pairs whose greatest possible overlap is too small. Sets already linked are not compared again.
   The top of the tree of a large group lies in Spark: bands of size, of which only neighbouring ones can hold a link, cut
   into blocks. Blocks are compared within themselves, then a few sets of each linked part with each other, and at last the
   sets outside a group's largest part with all blocks of neighbouring bands.
4. Links become components by iterated grouped minima. All pairs of copies are never listed; no group meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SLICE, as_sent, components, cuts, freed, freed_group, in_sift, join_counted, materialize, mix, sent_type, sift_of, slices, small_batches, table, text_bytes, word_hashes

SHINGLE, PERCENT = 5, 80
#: Text bytes for each bucket of shingles and for each group of sets, shingles that a task gathers before it deals them.
BUCKET_BYTES, GROUP_BYTES, DEAL_SHINGLES = 6_000_000, 6_000_000, 400_000
#: Sets in one block of a large group, sets of a linked part that stand for it in the second round, bytes of sets in a task.
BLOCK_SETS, PIVOTS, CELL_BYTES = 1_024, 16, 8_000_000
FAN = 8
#: Distinct tokens of a tree up to which each has a bit of its own; beyond, tokens share bits and leaves are verified.
OWN_BITS = 1 << 15


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of a batch, by text and hash; then each text's set size and key.

    Texts with fewer than k words have their whole sequence as one shingle; without words the set is empty and its key 0.
    """
    h, doc = word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc = (acc + h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        full = doc[: len(h) - k + 1] == doc[k - 1 :]
        acc, at = mix(acc[full]), doc[: len(h) - k + 1][full]
    else:
        acc, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        on = n_words[short] > j
        whole[on] = (whole[on] + h[first[short[on]] + j]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j)
    at, acc = np.concatenate([at, short]), np.concatenate([acc, mix(whole + n_words[short].astype(np.uint64))])
    order = np.lexsort((acc, at))
    at, acc = at[order], acc[order]
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != at[:-1]) | (acc[1:] != acc[:-1])
    at, acc = at[keep], acc[keep]
    size = np.bincount(at, minlength=len(texts))
    total = np.concatenate([[np.uint64(0)], np.cumsum(acc * (acc | np.uint64(1)))])
    ends_ = np.cumsum(size)
    key = mix(total[ends_] - total[ends_ - size] + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    key[size == 0] = 0
    return at, acc, size, key


def document_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, key and text (hash) of every document; key null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                _, _, size, key = shingle_sets(texts[lo:hi], k)
                out = pd.DataFrame({"n_shingles": size.astype(np.int64), "key": pd.array(key.view(np.int64), "Int64")})
                out.loc[size == 0, "key"] = pd.NA
                out.insert(0, "id", b["id"].iloc[lo:hi].array)
                out["name"] = b["name"].iloc[lo:hi].array
                yield out

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    named = as_sent(src).withColumn("name", row_name(F.col("id"), F.col("text")))
    return named.mapInPandas(freed(run), f"id {sent_type(src, 'id')}, n_shingles long, key long, name string").withColumn("id", F.col("id").cast(kind))


def row_name(id_: Column, text: Column) -> Column:
    """128 bits that tell rows of another id or text apart."""
    id_, text = id_.cast("string"), text.cast("string")
    return F.concat_ws(":", F.hex(F.xxhash64(id_, text)), F.hex(F.xxhash64(text, F.lit(7), id_)))


def _pack(key: np.ndarray, size: np.ndarray, count: np.ndarray, h: np.ndarray) -> bytes:
    parts = (np.uint32(len(key)), key, size.astype("<u4"), count.astype("<u4"), (h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype(np.uint8))
    return b"".join(p.tobytes() for p in parts)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set sizes, shingles dealt of each, their 40-bit hashes)."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    key, size, count = np.frombuffer(raw, "<u8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n), np.frombuffer(raw, "<u4", n, 4 + 12 * n)
    m, at = int(count.sum()), 4 + 16 * n
    return key, size, count, np.frombuffer(raw, "<u4", m, at).astype(np.uint64) | np.frombuffer(raw, np.uint8, m, at + 4 * m).astype(np.uint64) << np.uint64(32)


def least_overlap(n, percent: int):
    """Fewest elements that a set of n shares with any partner over the threshold."""
    return -(-percent * n // 100)


def prefix(n, percent: int):
    """Of n elements in any global order, how many must be looked at to meet every partner once; twice that is dealt, and
    what goes beyond (`spare`) raises by as much how many of them a partner shares."""
    one = n - least_overlap(n, percent) + 1
    dealt = np.minimum(n, 2 * one)
    least = least_overlap(n, percent)
    other = np.minimum(least, 2 * (least - least_overlap(least, percent) + 1)) - (least - least_overlap(least, percent) + 1)
    return dealt, np.maximum(0, np.minimum(dealt - one, other))  # the smallest partner has the fewest spare


def candidates(docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """key, n, cells: the sets that may have a partner over the threshold, and the shingles one of which it shares.

    Each set deals its first shingles by hash. Bucket by bucket these are counted; a set that shares too few of them with
    anyone has no partner. The cells are the rarest of the rest.
    """
    total = text_bytes(docs, text_col)
    buckets = max(1, -(-total // BUCKET_BYTES))
    groups = max(1, -(-total // GROUP_BYTES))

    def dealt(key: np.ndarray, size: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        """Packed rows of (set, its size, shingle), one for each bucket that occurs; copies of a set are dealt once."""
        bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h, key, bucket))
        key, size, h, bucket = key[order], size[order], h[order], bucket[order]
        new = np.ones(len(h), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, size, h, bucket = key[new], size[new], mix(h[new]) >> np.uint64(24), bucket[new]
        rows = []
        for i, s, e in cuts(bucket):
            at = np.flatnonzero(np.append(True, key[s + 1 : e] != key[s : e - 1])) + s
            rows.append((i, _pack(key[at], size[at], np.diff(np.append(at, e)), h[s:e])))
        return pd.DataFrame(rows, columns=["bucket", "packed"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                at, h, size, key = shingle_sets(texts[lo:hi], k)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                first = nth < prefix(size, percent)[0][at]
                held.append((key[at[first]], size[at[first]].astype(np.uint32), h[first]))
                if sum(len(x[0]) for x in held) >= DEAL_SHINGLES:
                    yield dealt(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        """In one bucket: sets by shingle; the shared ones go back, packed by group of sets."""
        bucket = int(rows["bucket"].iat[0])
        parts = [_unpack(r) for r in rows["packed"]]
        key = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        n = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        h = np.concatenate([p[3] for p in parts])
        order = np.lexsort((key, h))
        key, n, h = key[order], n[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])  # copies of a set count once
        key, n, h = key[new], n[new], h[new]
        start = np.ones(len(h), bool)
        start[1:] = h[1:] != h[:-1]
        run = np.cumsum(start) - 1
        df = np.bincount(run)[run]
        shared = df > 1
        key, n, h, df = key[shared], n[shared], h[shared], df[shared]
        group = (key % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((h, key, group))
        key, n, h, df, group = key[order], n[order], h[order], df[order], group[order]
        code = np.minimum(255, np.ceil(8 * np.log2(df))).astype(np.uint8)
        ids = (h << np.uint64(20)) | np.uint64(bucket & 0xFFFFF)
        out = []
        for g, s, e in cuts(group):
            own, first, size = np.unique(key[s:e], return_index=True, return_counts=True)
            out.append((g, own.tobytes(), n[s:e][first].astype("<u4").tobytes(), size.astype("<u4").tobytes(), ids[s:e].tobytes(), code[s:e].tobytes()))
        return pd.DataFrame(out, columns=["grp", "keys", "sizes", "shared", "ids", "codes"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        """For one group of sets: those that share enough of what they dealt, and their cells."""
        get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rows[c]])
        key, size, shared = get("keys", "<u8"), get("sizes", "<u4").astype(np.int64), get("shared", "<u4").astype(np.int64)
        ids, code = get("ids", "<u8"), get("codes", np.uint8)
        own, first, inv = np.unique(key, return_index=True, return_inverse=True)
        n, s = size[first], np.bincount(inv, shared, len(own)).astype(np.int64)
        dealt, spare = prefix(n, percent)
        may = s > spare
        of = np.repeat(inv, shared)
        order = np.lexsort((ids, code, of))
        of, ids = of[order], ids[order]
        cut = np.searchsorted(of, np.arange(len(own) + 1))
        reach = s - spare  # rarest first, those alone in a set come before the shared ones
        out = [(int(key_signed(own[i])), int(n[i]), ids[cut[i] : cut[i] + reach[i]].view(np.int64).tolist()) for i in np.flatnonzero(may)]
        return pd.DataFrame(out, columns=["key", "n", "cells"])

    src = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    packed = src.mapInPandas(freed(deal), "bucket int, packed binary")
    counted = packed.groupBy("bucket").applyInPandas(freed_group(count), "grp int, keys binary, sizes binary, shared binary, ids binary, codes binary")
    return counted.groupBy("grp").applyInPandas(freed_group(gather), "key long, n long, cells array<long>")


def candidate_sets(docs: DataFrame, cand: DataFrame, k: int, text_col: str) -> DataFrame:
    """key, ids (all shingles, 8 bytes each) of the candidates, from their texts; a fixed-size filter spares the others."""
    sift = sift_of(cand)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                at, h, size, key = shingle_sets(texts[lo:hi], k)
                cut = np.append(0, np.cumsum(size))
                pick = np.flatnonzero(in_sift(sift, key) & (size > 0))
                pick = pick[np.unique(key[pick], return_index=True)[1]]
                yield pd.DataFrame({"key": key[pick].view(np.int64), "ids": [h[cut[i] : cut[i + 1]].tobytes() for i in pick]})

    src = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return src.mapInPandas(freed(run), "key long, ids binary").dropDuplicates(["key"])


def key_signed(u: np.uint64) -> np.int64:
    return np.uint64(u).view(np.int64)


class Linked:
    """Union-find with whole-array roots, so that pairs already linked can be dropped many at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def tree_links(sets: list[np.ndarray], n: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of `100 * |x & y| >= percent * |x | y|` among non-empty sets (n: whole sizes).

    side: only sets on different sides are compared. Level by level from the root, pairs of nodes survive if their size
    ranges allow the threshold and popcount(or & or) plus the tokens that share bits leaves enough overlap.
    """
    order = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in sets]), n))
    length = np.array([len(sets[i]) for i in order])
    token = np.concatenate([sets[i] for i in order])
    names, place = np.unique(token, return_inverse=True)
    exact = len(names) <= OWN_BITS  # then each token has a bit of its own, and leaves need no second look
    width = -(-max(1, len(names)) // 64) * 64 if exact else 1 << max(9, min(17, int(4 * length.max() - 1).bit_length()))
    if not exact:
        place = (mix(token.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
    bits = np.zeros((len(sets), width // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), length)
    np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    size = np.asarray(n)[order]
    extra = length - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = [(bits, size, size, extra)]
    while len(levels[-1][0]) > 1:
        b, lo, hi, ex = levels[-1]
        at = np.arange(0, len(b), FAN)
        levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
    linked, out = Linked(len(sets)), []
    sides = None if side is None else side[order]

    def overlap(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bit, ex = levels[level][0], levels[level][3]
        top = np.zeros(len(a), np.int64)
        step = max(64, (1 << 19) // bit.shape[1])
        for s in range(0, len(a), step):
            top[s : s + step] = np.bitwise_count(bit[a[s : s + step]] & bit[b[s : s + step]]).sum(1)
        return top + np.minimum(ex[a], ex[b])

    def possible(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, lo, hi, _ = levels[level]
        ok = (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
        ok[ok] = overlap(level, a[ok], b[ok]) >= -(-percent * (lo[a[ok]] + lo[b[ok]]) // (100 + percent))
        return ok

    def leaves(a: np.ndarray, b: np.ndarray) -> None:
        """Links among pairs of sets; pairs whose sets are linked already are not looked at."""
        root = linked.roots()
        open_ = root[a] != root[b]
        if sides is not None:
            open_ &= sides[a] != sides[b]
        a, b = a[open_], b[open_]
        ok = possible(0, a, b)
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if linked.find(i) == linked.find(j):
                continue
            p, q = int(order[i]), int(order[j])
            if not exact:
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both < percent * (n[p] + n[q] - both):
                    continue
            linked.join(i, j)
            out.append((p, q))

    stack = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 20_000 and level:  # bounded frontier: the rest waits
            stack.append((level, a[20_000:], b[20_000:]))
            a, b = a[:20_000], b[:20_000]
        if not level:
            for at in range(0, len(a), 20_000):
                leaves(a[at : at + 20_000], b[at : at + 20_000])
            continue
        ok = possible(level, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        below = len(levels[level - 1][0])
        ka = (a[:, None] * FAN + np.arange(FAN))[:, :, None].repeat(FAN, 2).reshape(len(a), -1)
        kb = (b[:, None] * FAN + np.arange(FAN))[:, None, :].repeat(FAN, 1).reshape(len(a), -1)
        fine = (ka < below) & (kb < below) & ((ka < kb) if level == 1 else (ka <= kb))
        fine |= (ka < below) & (kb < below) & (a != b)[:, None]
        stack.append((level - 1, ka[fine], kb[fine]))
    return out


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links in each group of one cell; rows of side 0 and side 1 (visitors) are only compared with each other."""
        out = []
        for _, own in rows.groupby(["component", "band", "block"], sort=False):
            sets = [np.sort(np.frombuffer(x, "<u8")) for x in own["ids"]]
            keys, side = own["key"].to_numpy(), own["side"].to_numpy()
            out += [(keys[p], keys[q]) for p, q in tree_links(sets, own["n"].to_numpy(), percent, side if side.any() else None)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def links(cand: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) keys of true links that span the components of the candidates; sets: their key and ids."""
    cell = cand.select("key", F.explode("cells").alias("cell"))
    low = cell.groupBy("cell").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = join_counted(cell, low, "cell", cand.agg(F.sum(F.size("cells"))).first()[0] or 0).where("key <> low")
    part = components(star.select(F.col("key").alias("a"), F.col("low").alias("b")))  # every true pair lies within one
    part = part.unionByName(part.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "key")
    # two sets over the threshold lie in the same band of size or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    part = materialize(sets.join(cand.drop("cells").join(part, "key"), "key").withColumn("band", band), "parts")
    groups = part.groupBy("component", "band").agg(F.count(F.lit(1)).alias("members"))
    whole = groups.groupBy("component").agg(F.sum("members").alias("all"))
    blocks = groups.join(whole.where(F.col("all") > BLOCK_SETS), "component").select("component", "band", F.ceil(F.col("members") / BLOCK_SETS).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")  # a row for each band of a large group
    tasks = max(int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions")), (part.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // CELL_BYTES)

    def found(rows: DataFrame, cell: Column) -> DataFrame:
        own = rows.withColumn("cell", cell).select("key", "n", "ids", "component", "band", "block", "side", "cell")
        return materialize(own.groupBy("cell").applyInPandas(freed_group(_compare(percent)), "a long, b long"), "links")

    home = part.join(F.broadcast(blocks), ["component", "band"], "left") if blocks.count() <= 100_000 else part.join(blocks, ["component", "band"], "left")
    home = home.withColumn("side", F.lit(0)).withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(0).cast("int"))
    small = home.where("blocks IS NULL").withColumn("band", F.lit(0))
    large = home.where("blocks IS NOT NULL")
    cell = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "band", "block"))
    links_ = found(small.unionByName(large), cell)
    if not blocks.count():
        return links_

    def parts_of(links_: DataFrame) -> DataFrame:
        """(key, component, n, linked): the linked part of each set of a large group."""
        known = components(links_)
        known = known.unionByName(known.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("key"), F.col("component").alias("linked"))
        return large.select("key", "component").join(known, "key", "left").withColumn("linked", F.coalesce("linked", "key"))

    # a few sets of each linked part, blocks of all of a group's
    nth = F.row_number().over(Window.partitionBy("component", "linked", "salt").orderBy("key"))
    pivot = parts_of(links_).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(PIVOTS))).withColumn("nth", nth).where("nth = 1").select("key", "component", "linked")
    many = pivot.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    pivot = pivot.join(many, "component").select("key", F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("m") / BLOCK_SETS)).cast("int").alias("block"))
    second = large.drop("block").join(pivot, "key").withColumn("band", F.lit(0))
    links_ = materialize(links_.unionByName(found(second, F.xxhash64("component", "block"))), "links")

    # the sets outside the largest part of their group visit all blocks of their own band and its neighbours
    now = materialize(parts_of(links_), "linked")
    sizes = now.groupBy("component", "linked").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("component").agg(F.max_by("linked", F.struct("m", "linked")).alias("main"))
    minor = large.drop("blocks", "block").join(now.join(main, "component").where("linked <> main").select("key"), "key")
    there = blocks.select("component", F.col("band").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    visit = minor.withColumn("to", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(there, ["component", "to"])
    visit = visit.select("key", "n", "ids", "component", F.col("to").alias("band"), "block", F.lit(1).alias("side"))
    visited = large.select("key", "n", "ids", "component", "band", "block", "side").join(visit.select("component", "band", "block").distinct(), ["component", "band", "block"])
    return links_.unionByName(found(visited.unionByName(visit), F.xxhash64("component", "band", "block")))


def near_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id among the documents linked to it, over links).

    Null, empty and wordless texts have n_shingles 0 and are their own component. Repeated rows each give a row. Null ids:
    such documents link like others, and have a null component_id only if no linked document has an id. Other columns are
    not looked at. Long texts are read whole.
    """
    out = _linked(docs, k, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, key, name, component (null for empty sets) and component_id of every document."""
    small_batches(docs)
    sets = materialize(document_sets(docs, k, id_col, text_col), "sets")
    cand = materialize(candidates(docs, k, percent, text_col), "candidates")
    joined = components(links(cand, candidate_sets(docs, cand, k, text_col), percent))
    keys = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    keys = keys.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lows = keys.groupBy("component").agg(F.min("low").alias("component_id"))
    named = keys.join(lows, "component").select("key", "component", "component_id", "n")
    empty = sets.where("key IS NULL").select("id", "n_shingles", "key", "name", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    full = join_counted(sets.where("key IS NOT NULL"), named, "key", sets.count())
    return full.select(*empty.columns).unionByName(empty)


#: Names of rows to drop up to which they are broadcast (some 40 bytes each); beyond, a shuffle join.
BROADCAST_NAMES = 500_000


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each linked group: the row of the smallest doc_id (a
    null counts as the largest), of several by a hash of the text.

    A repeated row (the same doc_id and text) stays once. Null, empty and wordless texts are linked with nothing and stay,
    repeated ones once. Other columns are not looked at; an empty table gives no rows.
    """
    rows = materialize(_linked(docs, k, percent, "doc_id", "text").select("id", "name", "component"), "named")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "name")).alias("x"))
    kept = first.select("x.name").unionByName(rows.where("component IS NULL").select("name"))
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # one table of the names that go (false) or stay once (true); all others stay as they are
    marked = materialize(counts.join(kept.distinct().withColumn("stays", F.lit(True)), "name", "left").select("name", F.coalesce("stays", F.lit(False)).alias("stays"), "n").where("n > 1 OR NOT stays").drop("n"), "marked")
    if marked.count() <= BROADCAST_NAMES:
        marked = F.broadcast(marked)
    seen = docs.withColumn("__name", row_name(F.col("doc_id"), F.col("text"))).join(marked.withColumnsRenamed({"name": "__name", "stays": "__stays"}), "__name", "left")
    once = seen.where("__stays").dropDuplicates(["__name"])
    return seen.where("__stays IS NULL").unionByName(once).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES: dict[str, str] = {}
