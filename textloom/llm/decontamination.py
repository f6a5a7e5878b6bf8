"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A seed is a fixed mask over consecutive words: the words at its selected places are hashed, the others are ignored, so a
substituted word in an ignored place does not hide a hit. Benchmark seeds and document seeds join on (mask, hash); around
each hit the words are compared place by place, and a window of `window` words with at least `similarity` equal confirms.

Every mask selects its first two words. Document places are therefore first sifted by their word pair against a fixed-size
bit table of benchmark pairs (false positives only cost time), so that most places never leave the scan. Items of 10 words or less are also cut into
contiguous pieces, of which a tolerated number of substitutions leaves one whole.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

MASKS = ((0, 1, 3, 4, 6), (0, 1, 2, 5, 7), (0, 1, 4, 6, 8), (0, 1, 3, 5, 8))
WINDOW, SIMILARITY = 13, 0.8
#: Shortest benchmark item (in words) that is looked for; items shorter than a mask use a contiguous one of their length.
SHORTEST = 3
#: Items of up to so many words are seeded by pieces: the spaced masks alone miss some with a tolerated substitution.
PIECED = 10
#: Slots of the pair table, one byte each: 32 for each word pair of the benchmark, in a power of two between these bounds.
SLOTS_LEAST, SLOTS_MOST = 1 << 16, 1 << 20
#: Benchmark seeds up to which they are broadcast (each with its words around it: about 300 bytes); beyond, a shuffle join.
BROADCAST_SEEDS = 200_000
#: Keys of contaminated documents (8 bytes each) up to which they are broadcast; beyond, a shuffle join.
BROADCAST_KEYS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once for a row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(w: Column, i: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(slots)).cast("int")


def _masks() -> tuple[tuple[int, ...], ...]:
    """The spaced masks, then a contiguous mask for each length of item too short for one of them."""
    longest = max(m[-1] for m in MASKS) + 1
    return MASKS + tuple(tuple(range(n)) for n in range(SHORTEST, longest))


def _every() -> tuple[tuple[int, ...], ...]:
    """All masks: those above, then the contiguous mask of two words, which only pieces of short items use."""
    return (*_masks(), (0, 1))


def _due(n: int, window: int, similarity: float) -> list[tuple[int, int | None]]:
    """(mask, place, or None for every place) of the seeds of an item of n words.

    An item the spaced masks don't cover is cut into one piece more than the words it may differ by, so that one piece is
    untouched (pieces hold two words or more: as many as that allows).
    """
    every = _every()
    spaced = [(k, None) for k in range(len(MASKS))] if n > max(m[-1] for m in MASKS) else []
    if n > PIECED:
        return spaced
    span = min(window, n)
    free = span - math.ceil(span * similarity - 1e-9)
    parts = max(1, min(free + 1, n // 2))
    cuts = [n * j // parts for j in range(parts + 1)]
    if any(tuple(range(v - u)) not in every for u, v in pairwise(cuts)):
        return spaced
    return spaced + [(every.index(tuple(range(v - u))), u) for u, v in pairwise(cuts)]


def _item_seeds(w: Column, i: Column, n_item: Column, window: int, similarity: float) -> Column:
    """Array of (mask, hash) at place i of an item: only the masks due to its length."""
    due: dict[int, Column] = {}
    for n in range(SHORTEST, PIECED + 2):  # the last stands for all longer items
        for k, at in _due(n, window, similarity):
            here = (n_item == n if n <= PIECED else n_item > PIECED) & (F.lit(True) if at is None else i == at)
            due[k] = due[k] | here if k in due else here
    return _hashes(w, i, due)


def _hashes(w: Column, i: Column, due: dict[int, Column]) -> Column:
    every = _every()
    return F.filter(F.array(*[F.when((i + every[k][-1] < F.size(w)) & c, F.struct(F.lit(k).alias("mask"), F.xxhash64(*[F.get(w, i + m) for m in every[k]]).alias("hash"))) for k, c in due.items()]), lambda s: s.isNotNull())


def _around(w: Column, i: Column, window: int) -> Column:
    """Words at places i - window + 1 .. i + window - 1; null outside the text."""
    return F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda k: F.when(i + k >= 0, F.get(w, F.greatest(i + k, F.lit(0)))))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, contaminated boolean, n_items long, item_ids array (sorted benchmark ids found).

    An item is found where min(window, its length) consecutive places, one of them a seed hit, hold equal words for at
    least `similarity` of them. Null and empty texts are clean; items under SHORTEST words or null are not looked for;
    null item ids count but are not listed; repeated rows are judged alike; other columns are not looked at.
    """
    found = _found(docs, benchmark, window, similarity, id_col, text_col, item_col, item_text)
    kind = dict(benchmark.dtypes)[item_col]
    return docs.select(F.col(id_col), _key(id_col, text_col).alias("key")).join(found, "key", "left").select(
        F.col(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", F.array().cast(f"array<{kind}>")).alias("item_ids")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item.

    Null and empty texts stay; repeated rows are judged alike; null ids are judged by their texts; an empty table or
    benchmark drops nothing.
    """
    found = materialize(_found(docs, benchmark, window, similarity, "doc_id", "text", "item_id", "text").select("key"), "found")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    name = "__key"
    return docs.withColumn(name, _key("doc_id", "text")).join(found.withColumnRenamed("key", name), name, "left_anti").drop(name)


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(key, n_items, item_ids) of the documents in which an item is found."""
    item = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") >= SHORTEST).distinct()
    n_pairs = item.agg(F.sum(F.size("w") - 1)).first()[0] or 0
    size = min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (32 * n_pairs).bit_length()))
    pairs = item.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: _pair(F.col("w"), i, size))).alias("slot")).distinct()
    slots = bytearray(size)
    for r in pairs.toLocalIterator():  # at most `size` numbers
        slots[r["slot"]] = 1
    known = F.lit(bytes(slots))

    seed = item.select("item", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i"))
    seed = seed.select("item", "n", _around(F.col("w"), F.col("i"), window).alias("theirs"), F.explode(_item_seeds(F.col("w"), F.col("i"), F.col("n"), window, similarity)).alias("s")).select("item", "n", "theirs", "s.mask", "s.hash")
    used = {r["mask"]: r["n"] for r in seed.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a mask
    if sum(used.values()) <= BROADCAST_SEEDS:
        seed = F.broadcast(seed)

    key = _key(id_col, text_col).alias("key")

    def spots(w: Column) -> Column:
        sifted = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.substring(known, _pair(w, i, size) + 1, F.lit(1)) == F.lit(b"\x01"))
        return F.transform(sifted, lambda i: F.struct(_hashes(w, i, {k: F.lit(True) for k in sorted(used) or [0]}).alias("seeds"), _around(w, i, window).alias("ours")))

    # one expression from text to spots, so that a text is split once and only sifted places become rows
    spot = docs.select(key, F.explode(_let(words(F.col(text_col)), spots)).alias("x"))
    hit = spot.select("key", F.col("x.ours").alias("ours"), F.explode("x.seeds").alias("s")).select("key", "ours", "s.mask", "s.hash").join(seed, ["mask", "hash"])

    equal = F.zip_with("ours", "theirs", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    span = F.least(F.lit(window), F.col("n"))
    need = F.ceil(span * F.lit(similarity) - F.lit(1e-9))
    fits = F.exists(F.sequence(F.lit(window) - span + 1, F.lit(window)), lambda s: F.aggregate(F.slice("equal", s, F.col("span")), F.lit(0), lambda a, b: a + b) >= F.col("need"))
    found = hit.select("key", "item", equal.alias("equal"), span.alias("span"), need.alias("need")).where(fits)
    return found.select("key", "item").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("item_ids"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    longest = max(m[-1] for m in MASKS)
    at = lambda m: "concat_ws(chr(31), " + ", ".join(f"w[i + {k + 1}]" for k in m) + ")"
    own, all_ = [], []
    for k, m in enumerate(_masks()):
        due = f"n > {longest}" if k < len(MASKS) else f"n <= {longest} AND n = {len(m)}"
        own.append(f"SELECT item_id, w, n, i, {k} AS mask, {at(m)} AS s FROM ip WHERE i + {m[-1]} < n AND {due}")
        all_.append(f"SELECT k, w, n, i, {k} AS mask, {at(m)} AS s FROM dp WHERE i + {m[-1]} < n")
    same = f"list_transform(range({1 - WINDOW}, {WINDOW}), lambda d: CASE WHEN di + d >= 0 AND di + d < dn AND bi + d >= 0 AND bi + d < bn AND dw[di + d + 1] = bw[bi + d + 1] THEN 1 ELSE 0 END)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents), b AS (SELECT DISTINCT item_id, {split} AS w FROM benchmark),
    ip AS (SELECT item_id, w, len(w) AS n, unnest(range(0, len(w) - {SHORTEST} + 1)) AS i FROM b WHERE len(w) >= {SHORTEST}),
    dp AS (SELECT k, w, len(w) AS n, unnest(range(0, len(w) - {SHORTEST} + 1)) AS i FROM d WHERE len(w) >= {SHORTEST}),
    bs AS ({" UNION ALL ".join(own)}), ds AS ({" UNION ALL ".join(f"({x} AND {at(_masks()[j])} IN (SELECT s FROM bs WHERE mask = {j}))" for j, x in enumerate(all_))}),
    hit AS (SELECT DISTINCT ds.k, bs.item_id, ds.w AS dw, ds.n AS dn, ds.i AS di, bs.w AS bw, bs.n AS bn, bs.i AS bi FROM ds JOIN bs USING (mask, s)),
    eq AS (SELECT k, item_id, least({WINDOW}, bn) AS span, {same} AS e FROM hit),
    ok AS (SELECT DISTINCT k, item_id FROM eq WHERE len(list_filter(range({WINDOW} - span + 1, {WINDOW} + 1), lambda s: list_sum(e[s:s + span - 1]) >= ceil(span * {SIMILARITY} - 1e-9))) > 0),
    g AS (SELECT k, count(*) AS n_items, list_sort(list(item_id)) AS item_ids FROM ok GROUP BY k)
    SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, []) AS item_ids FROM d LEFT JOIN g USING (k)"""


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": _sql()}
