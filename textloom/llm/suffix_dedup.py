"""Repeated-substring removal by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. So the suffixes that start equal strings
must meet, in order, in one block; a block must fit in a task.

1. Every start has an anchor: of the places up to length - NAME bytes further on, the one whose next 8 bytes hash lowest.
   Equal strings have their anchors at the same offset, followed by the same NAME bytes. Runs of starts share an anchor
   (some 67 starts on ordinary text). Hashes of these NAME bytes are dealt to buckets, packed; only anchors whose NAME bytes
   may occur elsewhere too are followed up. This is a filter: it loses nothing and proves nothing.
2. The run of starts of each remaining anchor goes, with the bytes its strings span, to the block of its anchor's name.
   Windows with the same bytes become one; a window whose name no other has is alone.
3. In a block the suffixes of the remaining windows are sorted: the ranks of the suffixes at a difference cover are made
   first, by doubling; then all starts are sorted by their leading COVER_MOD bytes, and longer ties by the ranks at the
   common cover offset of each two. Neighbours in this order that agree in all `length` bytes are the repeated ones. Every
   removal rests on a comparison of bytes; a block too large is sorted a part (of whole names) at a time.
4. Runs of repeated starts go back to their documents; what they cover is cut out.

Texts that occur more than once go whole, and stand as one text for all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT_ROWS, SLICE, as_sent, cuts, freed, freed_group, in_sift, join_counted, materialize, mix, sent_type, sift_of, slices, small_batches, span_hashes, table

LENGTH, NAME = 200, 68
#: A perfect difference set, every residue modulo 31 is a difference of two members.
COVER_MOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Text bytes for each bucket of names, for each block of windows and for each group of texts; names, and bytes of windows,
#: that a task gathers before it deals them; bytes of windows sorted at a time.
BUCKET_BYTES, BLOCK_BYTES, GROUP_BYTES, DEAL_NAMES, DEAL_BYTES, SORT_BYTES = 32_000_000, 8_000_000, 8_000_000, 300_000, 6_000_000, 2_000_000


def raw_of(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def text_key(raw: bytes) -> int:
    """64-bit key of a whole text."""
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")


# --- anchors ----------------------------------------------------------------------------------------------------------


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, in the order of bytes; what lies beyond the end counts as 0."""
    x = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] << np.uint64(8 * k) | x[k:]
    return x[: len(buf)]


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each place i, the place of the lowest of h[i : i + width] (the first of several); len(h) - width + 1 of them."""
    n = len(h)
    x = (h >> np.uint64(28)) << np.uint64(28) | np.arange(n, dtype=np.uint64)
    x = np.concatenate([x, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(x, axis=1).ravel()
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & np.uint64((1 << 28) - 1)).astype(np.int64)


def pieces(raws: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Batches of (text index, first byte, bytes): texts of at least `length` bytes, long ones in pieces that overlap so
    that every start has its string in one piece."""
    cut = [(i, s, r[s : s + SLICE + length - 1]) for i, r in enumerate(raws) for s in range(0, len(r) - length + 1, SLICE)]
    for lo, hi in slices([len(c[2]) for c in cut], SLICE):
        yield tuple(map(list, zip(*cut[lo:hi], strict=True)))


def anchored(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, piece, first start, last start, anchor) of each run of starts with one anchor; places in the joined bytes."""
    size = np.array([len(p) for p in parts])
    off = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.arange(int((size - length + 1).sum()))
    piece = np.repeat(np.arange(len(parts)), size - length + 1)
    starts += np.repeat(off - np.concatenate([[0], np.cumsum(size - length + 1)[:-1]]), size - length + 1)
    anchor = least_places(mix(words8(buf)), length - NAME + 1)[starts]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    return buf, piece[first], starts[first], starts[last], anchor[first]


# --- packed rows ------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers of equal count, by planes of their bytes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays), 1)


def unpack(raws, count: int) -> list[np.ndarray]:
    """The arrays of all packed rows, joined."""
    out: list[list[np.ndarray]] = [[] for _ in range(count)]
    for raw in raws:
        x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(count, 8, -1)
        for k in range(count):
            out[k].append(np.ascontiguousarray(x[k].T).view("<i8").ravel())
    return [np.concatenate(o) for o in out]


def by_group(group: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of (group, packed arrays), each group's sorted by the first two arrays; keys as differences."""
    order = np.lexsort((arrays[1], arrays[0], group))
    group, arrays = group[order], [a[order] for a in arrays]
    return [(g, pack(*(a[s:e] for a in arrays))) for g, s, e in cuts(group)]


def signed(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint64).view(np.int64)


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(groups)).astype(np.int64)


#: Rows dealt to buckets; answers that need no bucket have the bucket -1 - group and go through untouched. Answers are runs
#: (key, from, to) of places.
DEALT, ANSWER = "bucket long, packed binary", "grp long, packed binary"


def merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted and joined where one of a key begins within or at the end of those before it."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    first = np.append(True, key[1:] != key[:-1])
    # a running maximum for each key: keys are lifted above one another
    lift = (np.cumsum(first) - 1) * (int(hi.max()) + 1)
    top = np.maximum.accumulate(hi + lift) - lift
    at = np.flatnonzero(first | np.append(True, lo[1:] > top[:-1]))
    return key[at], lo[at], top[np.append(at[1:], len(key)) - 1]


def answer(groups: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, bytes]]:
    key, lo, hi = merged(key, lo, hi)
    return by_group(group_of(key, groups), key, lo, hi)


def gathered(more: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each text of a group, its runs of places, each made `more` places longer."""
        key, lo, hi = unpack(rows["packed"], 3)
        key, lo, hi = merged(key, lo, hi + more)
        runs = cuts(key)
        return pd.DataFrame({"key": [k for k, _, _ in runs], "lo": [lo[s:e].tolist() for _, s, e in runs], "hi": [hi[s:e].tolist() for _, s, e in runs]})

    return run


RUNS = "key long, lo array<long>, hi array<long>"


# --- which names may occur twice --------------------------------------------------------------------------------------


def deal_names(key: np.ndarray, place: np.ndarray, name: np.ndarray, buckets: int, groups: int) -> pd.DataFrame:
    """Names seen at several places here are answered at once; one of them goes on, as all others do."""
    order = np.lexsort((place, key, name))
    key, place, name = key[order], place[order], name[order]
    new = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (name[1:] != name[:-1]))
    key, place, name = key[new], place[new], name[new]
    first = np.append(True, name[1:] != name[:-1])
    several = np.diff(np.append(np.flatnonzero(first), len(name))) > 1
    again = np.repeat(several, np.diff(np.append(np.flatnonzero(first), len(name))))
    rows = [(-1 - g, p) for g, p in answer(groups, key[again], place[again], place[again] + 1)]
    key, place, name = key[first], place[first], name[first]
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    rows += by_group(bucket, signed(name // np.uint64(buckets)) & ((1 << 48) - 1), key, place, several.astype(np.int64))
    return pd.DataFrame(rows, columns=["bucket", "packed"])


def repeated_names(groups: int):
    """One bucket: the places whose name occurs at another place too, by group of texts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if (b := int(rows["bucket"].iat[0])) < 0:
            return pd.DataFrame({"grp": -1 - b, "packed": rows["packed"]})
        name, key, place, several = unpack(rows["packed"], 4)
        order = np.lexsort((several, place, key, name))
        name, key, place, several = name[order], key[order], place[order], several[order]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        count = np.diff(np.append(at, len(name)))
        known = np.logical_or.reduceat(several > 0, at)
        one = np.logical_and.reduceat(np.append(True, (key[1:] == key[:-1]) & (place[1:] == place[:-1]) | np.isin(np.arange(1, len(name)), at)), at)
        keep = np.repeat(known | ~one, count)
        return pd.DataFrame(answer(groups, key[keep], place[keep], place[keep] + 1), columns=["grp", "packed"])

    return run


# --- sorting suffixes -------------------------------------------------------------------------------------------------


@cache
def shifts() -> np.ndarray:
    """For each two residues, the smallest shift that takes both into the cover."""
    out = np.full((COVER_MOD, COVER_MOD), COVER_MOD)
    for a in range(COVER_MOD):
        for b in range(COVER_MOD):
            out[a, b] = min(d for d in range(COVER_MOD) if (a + d) % COVER_MOD in COVER and (b + d) % COVER_MOD in COVER)
    return out


def leading(word: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first COVER_MOD bytes from each place on, as sort keys, the last first."""
    return [word[at + k] for k in (COVER_MOD - 8, 16, 8, 0)]


def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each by the keys, the last first; equal ones share a rank, from 1)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return order, rank


def cover_ranks(word: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover places, by at least `depth` bytes, in the order of the places (0: beyond the end).

    A cover place shifted by a multiple of COVER_MOD is one too, so each doubling reads only ranks."""
    blocks = -(-n // COVER_MOD)
    at = (np.arange(blocks)[:, None] * COVER_MOD + np.array(COVER)).ravel()
    _, rank = dense(*leading(word, at))
    span, deep = 1, COVER_MOD
    while deep < depth:
        ahead = np.zeros_like(rank)
        ahead[: -span * len(COVER) or None] = rank[span * len(COVER) :] if span < blocks else 0
        _, rank = dense(ahead, rank)
        span, deep = 2 * span, 2 * deep
    return rank


def sorted_starts(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of their first `depth` bytes or more, the numbers words8 gives for all places)."""
    n = len(buf)
    word = words8(np.concatenate([buf, np.zeros(depth + 3 * COVER_MOD, np.uint8)]))
    rank = np.append(cover_ranks(word, n, depth), np.zeros(4 * len(COVER), np.int64))
    nth = np.full(COVER_MOD, -1)
    nth[list(COVER)] = np.arange(len(COVER))
    order, group = dense(*leading(word, starts))
    order, group = starts[order], group[order]
    slot = np.arange(len(order))
    while len(slot):
        # groups of one are settled; in each other one, all members are held against its middle one
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(at, len(group)))
        many = np.repeat(count > 1, count)
        slot, group = slot[many], group[many]
        if not len(slot):
            break
        own = order[slot]
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(at, len(group)))
        pivot = np.repeat(own[at + count // 2], count)
        shift = shifts()[own % COVER_MOD, pivot % COVER_MOD]
        mine, theirs = (rank[x // COVER_MOD * len(COVER) + nth[x % COVER_MOD]] for x in (own + shift, pivot + shift))
        side = np.sign(mine - theirs)
        move = np.lexsort((side, group))
        order[slot] = own[move]
        side, group = side[move], 3 * group[move] + side[move] + 1
        slot, group = slot[side != 0], group[side != 0]  # those equal to the pivot stand next to it
    return order, word


def repeated_starts(texts: list[bytes], counts: list[int], depth: int) -> list[np.ndarray]:
    """For each window (its first `counts` places are starts): which of its starts share their `depth` bytes with another."""
    size, n = np.array([len(t) for t in texts]), np.array(counts)
    off = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts), np.uint8)
    before = np.cumsum(n) - n
    starts = np.arange(n.sum()) + np.repeat(off - before, n)
    order, word = sorted_starts(buf, starts, depth)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, depth - 7, 8), depth - 8):
        at = np.flatnonzero(same)
        same[at] = word[order[at] + k] == word[order[at + 1] + k]
    again = np.zeros(len(buf), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return [again[o : o + c] for o, c in zip(off.tolist(), counts, strict=True)]


# --- blocks of windows ------------------------------------------------------------------------------------------------


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(from, to) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def deal_windows(windows: list[tuple[int, int, int, int, bytes]], blocks: int, groups: int) -> pd.DataFrame:
    """windows: (key, first start, number of starts, name, bytes). Windows with the same bytes are answered at once, and one
    of them goes on."""
    first: dict[bytes, int] = {}
    several = np.zeros(len(windows), np.int64)
    done, seen = [], set()
    for i, (key, lo, n, _, text) in enumerate(windows):
        if (key, lo, n) in seen:
            continue
        seen.add((key, lo, n))
        j = first.setdefault(text, i)
        if j != i:
            if not several[j]:
                done.append(windows[j][:3])
            several[j] = 1
            done.append((key, lo, n))
    rows = []
    if done:
        key, lo, n = np.array(done, np.int64).T
        rows = [(-1 - g, p) for g, p in answer(groups, key, lo, lo + n)]
    own = np.fromiter(first.values(), np.int64)
    key, lo, n, name = (np.array([windows[i][c] for i in own], np.int64) for c in range(4))
    size = np.array([len(windows[i][4]) for i in own])
    block = (mix(name.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    for b, s, e in cuts(block[order]):
        at = order[s:e]
        head = pack(name[at], key[at], lo[at], n[at], several[own[at]], size[at])
        body = zstandard.compress(b"".join(windows[own[i]][4] for i in at), 1)
        rows.append((b, len(head).to_bytes(4, "little") + head + body))
    return pd.DataFrame(rows, columns=["bucket", "packed"])


def sorted_block(groups: int, length: int):
    """One block: the runs (key, from, to) of repeated starts, by group of texts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if (b := int(rows["bucket"].iat[0])) < 0:
            return pd.DataFrame({"grp": -1 - b, "packed": rows["packed"]})
        heads, texts = [], []
        for raw in rows["packed"]:
            cut = 4 + int.from_bytes(raw[:4], "little")
            heads.append(raw[4:cut])
            body, at = zstandard.decompress(raw[cut:]), 0
            for m in unpack(heads[-1:], 6)[5].tolist():
                texts.append(body[at : at + m])
                at += m
        name, key, lo, n, several, _ = unpack(heads, 6)
        places: dict[bytes, set] = {}
        for i, t in enumerate(texts):
            places.setdefault(t, set()).add((int(key[i]), int(lo[i])))
        again = np.array([several[i] > 0 or len(places[t]) > 1 for i, t in enumerate(texts)])
        settled = {t for t, a in zip(texts, again.tolist(), strict=True) if a}
        # distinct windows by name; a name with one window needs no look
        first = {t: i for i, t in reversed(list(enumerate(texts)))}
        own = np.fromiter(first.values(), np.int64)
        own = own[np.argsort(name[own], kind="stable")]
        flags: dict[bytes, np.ndarray] = {}
        part: list[int] = []

        def look() -> None:
            if part:
                found = repeated_starts([texts[i] for i in part], [int(n[i]) for i in part], length)
                flags.update((texts[i], f) for i, f in zip(part, found, strict=True) if texts[i] not in settled)

        for _, s, e in cuts(name[own]):
            if e - s > 1 and not all(texts[i] in settled for i in own[s:e]):
                part += own[s:e].tolist()
                if sum(len(texts[i]) for i in part) >= SORT_BYTES:
                    look()
                    part = []
        look()
        out = []
        for i, t in enumerate(texts):
            if t in settled:
                out.append((key[i], lo[i], lo[i] + n[i]))
            elif t in flags:
                out += [(key[i], lo[i] + s, lo[i] + e) for s, e in runs_of(flags[t]).tolist()]
        if not out:
            return pd.DataFrame({"grp": np.array([], np.int64), "packed": []})
        key, lo, hi = np.array(out, np.int64).T
        return pd.DataFrame(answer(groups, key, lo, hi), columns=["grp", "packed"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of (start, end) bytes).

    Null texts are empty. Texts shorter than `length` keep everything. Whole texts that occur twice go whole. Repeated rows
    each give a row; ids may be null or repeated; other columns are not looked at; an empty table gives no rows. Very long
    texts are read in pieces. Texts are told apart by 64 bits of their SHA-256. `length` must be at least NAME + 8.
    """
    if length < NAME + 8:
        raise ValueError("length is too short for its anchors")
    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, sent = dict(src.dtypes)["id"], sent_type(src, "id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = [raw_of(t) for t in b["text"].tolist()]
            yield pd.DataFrame({"id": b["id"].array, "key": signed(np.array([text_key(r) for r in raws], np.uint64)), "n_bytes": [len(r) for r in raws], "sha": [hashlib.sha256(r).hexdigest() for r in raws]})

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            raws = list(dict.fromkeys(raw_of(t) for t in b["text"].tolist()))
            keys = np.array([text_key(r) if len(r) >= length else 0 for r in raws], np.uint64)
            for text, base, parts in pieces(raws, length):
                buf, piece, _, _, anchor = anchored(parts, length)
                off = np.cumsum([0, *map(len, parts[:-1])])
                held.append((signed(keys[np.array(text)[piece]]), anchor - off[piece] + np.array(base)[piece], span_hashes(buf, anchor, anchor + NAME)))
                if sum(len(h[0]) for h in held) >= DEAL_NAMES:
                    yield deal_names(*map(np.concatenate, zip(*held, strict=True)), buckets, groups)
                    held = []
        if held:
            yield deal_names(*map(np.concatenate, zip(*held, strict=True)), buckets, groups)

    about = materialize(as_sent(src).mapInPandas(freed(describe), f"id {sent}, key long, n_bytes long, sha string"), "texts")
    total = about.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, blocks, groups = (max(1, -(-total // n)) for n in (BUCKET_BYTES, BLOCK_BYTES, GROUP_BYTES))
    marked = src.select("text").where(F.octet_length("text") >= length).mapInPandas(freed(names), DEALT).groupBy("bucket").applyInPandas(freed_group(repeated_names(groups)), ANSWER)
    marks = materialize(marked.groupBy("grp").applyInPandas(freed_group(gathered(0)), RUNS), "marks")
    sift = sift_of(marks)

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = list(dict.fromkeys(raw_of(t) for t in b["text"].tolist()))
            keys = np.array([text_key(r) for r in raws], np.uint64)
            keep = in_sift(sift, keys)
            yield pd.DataFrame({"key": signed(keys[keep]), "raw": [r for r, k in zip(raws, keep, strict=True) if k]})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for b in batches:
            raws, keys, marks_lo, marks_hi = (b[c].tolist() for c in ("raw", "key", "lo", "hi"))
            for text, base, parts in pieces(raws, length):
                buf, piece, lo, hi, anchor = anchored(parts, length)
                off = np.cumsum([0, *map(len, parts[:-1])])
                name = signed(span_hashes(buf, anchor, anchor + NAME))
                whole = buf.tobytes()
                for p, s, e in cuts(piece):
                    here = base[p] - off[p]
                    run = np.searchsorted(marks_lo[text[p]], anchor[s:e] + here, side="right") - 1
                    for r in (np.flatnonzero((run >= 0) & (anchor[s:e] + here < marks_hi[text[p]][run])) + s).tolist():
                        held.append((keys[text[p]], int(lo[r] + here), int(hi[r] - lo[r]) + 1, int(name[r]), whole[lo[r] : hi[r] + length]))
                        waiting += len(held[-1][4])
                        if waiting >= DEAL_BYTES:
                            yield deal_windows(held, blocks, groups)
                            held, waiting = [], 0
        if held:
            yield deal_windows(held, blocks, groups)

    texts = src.select("text").where(F.octet_length("text") >= length).mapInPandas(freed(needed), "key long, raw binary").dropDuplicates(["key"]).join(marks, "key")
    runs = texts.mapInPandas(freed(windows), DEALT).groupBy("bucket").applyInPandas(freed_group(sorted_block(groups, length)), ANSWER)
    cut = runs.groupBy("grp").applyInPandas(freed_group(gathered(length - 1)), RUNS)
    # texts that occur more than once go whole: no look at their bytes
    short, long_ = about.where(F.col("n_bytes") < length), about.where(F.col("n_bytes") >= length)
    n_long = long_.count()
    counts = long_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cut_up = materialize(cut.join(counts.where("n = 1").select("key"), "key"), "cut")
    hot = {r["key"] for r in counts.where(F.col("n") > max(HOT_ROWS, n_long // 100_000)).collect()}  # at most 100,000
    told = join_counted(long_, counts.withColumn("twice", F.col("n") > 1), "key", n_long)
    gone = told.where("twice").select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("removed"))
    rest = told.where("NOT twice").drop("twice").join(cut_up.select("key"), "key", "left_anti").unionByName(short)
    untouched = rest.select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    touched_sift = sift_of(cut_up)

    def touched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = [raw_of(t) for t in b["text"].tolist()]
            keys = np.array([text_key(r) for r in raws], np.uint64)
            keep = np.array([i for i in np.flatnonzero(in_sift(touched_sift, keys)).tolist() if int(keys[i].view(np.int64)) not in hot], np.int64)
            yield pd.DataFrame({"id": b["id"].iloc[keep].array, "key": signed(keys[keep]), "raw": [raws[i] for i in keep]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                h, pos = hashlib.sha256(), 0
                for s, e in zip(r.lo, r.hi, strict=True):
                    h.update(r.raw[pos:s])
                    pos = e
                h.update(r.raw[pos:])
                out.append((len(r.raw), int(sum(r.hi) - sum(r.lo)), len(r.lo), h.hexdigest(), [{"start": s, "end": e} for s, e in zip(r.lo, r.hi, strict=True)]))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
            frame.insert(0, "id", b["id"].array)
            yield frame

    schema = f"id {sent}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    whole = as_sent(src.where(F.octet_length("text") >= length)).mapInPandas(freed(touched), f"id {sent}, key long, raw binary")
    out = whole.join(cut_up, "key").mapInPandas(freed(finish), schema).unionByName(untouched).unionByName(gone)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
