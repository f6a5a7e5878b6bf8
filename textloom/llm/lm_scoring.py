"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

Training documents are split: a main part gives the counts from which the mixture weights' estimates are made, a held-out
part gives the counts on which expectation-maximisation fits the weights, one set for each bucket of context frequency.
Scores then use the counts of all training documents.

Documents are grouped in batches by hash. A batch asks for the counts of its distinct words and bigrams, packed by bucket
of hash; each bucket sums what all batches bring and answers each batch in its own order. No count table is ever joined to
tokens row by row, broadcast, or sent to the driver; the driver sees only the totals and a binned table of fixed size for
the weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FOLDS, SLICE, cuts, fold, freed, freed_group, materialize, mix, slices, small_batches, table, text_bytes, word_hashes

#: Text bytes of a batch; there are as many buckets as batches.
BATCH_BYTES = 5_000_000
#: Characters of text that a task gathers before it deals them to their batches.
GATHERED = 12_000_000
#: Every DELETED-th training document (by hash) is held out for the weights.
DELETED = 10
#: Context-frequency buckets: floor(log2(count)), 0 for unseen, up to CONTEXT_BUCKETS - 1.
CONTEXT_BUCKETS = 24
#: Bins of log10 probabilities in the table that EM reads: BINS for each decade, DECADES decades. A cell of the table stands
#: for the mean of its own estimates, so that EM sees more than the bins.
BINS, DECADES = 20, 12
EM_ROUNDS = 60
#: A batch's part: main training, held-out training, not for training.
MAIN, HELD, OUT = 0, 1, 2
CELLS = ["b", "f2", "f1", "n", "s2", "s1"]
_END = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token (words, then one end for each text), of the bigram that ends there, and the text's index.

    The token before a text's first is its end token.
    """
    h, doc = word_hashes(texts)
    h[h == _END] ^= np.uint64(1)
    last = np.searchsorted(doc, np.arange(len(texts)), side="right")
    tok = np.insert(h, last, _END)
    doc = np.insert(doc, last, np.arange(len(texts)))
    before = np.empty_like(tok)
    before[:1] = _END
    before[1:] = tok[:-1]  # after a text's end token comes the next text's first: its context is an end
    return tok, mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + tok), doc


def _wanted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a batch (words and bigrams, bigrams marked by their top bit) with local counts."""
    parts = []
    for s, e in slices([len(t or "") for t in texts], SLICE):
        tok, pair, _ = grams(texts[s:e])
        parts.append(np.unique(np.concatenate([tok & _WORD, pair | _PAIR]), return_counts=True))
    h = np.concatenate([p[0] for p in parts])
    own, inv = np.unique(h, return_inverse=True)
    return own, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)


#: Names within a bucket are 47 bits and a mark for bigrams; with the bucket's own bits that is about 54 for this input.
_PAIR = np.uint64(1 << 63)
_WORD = np.uint64((1 << 63) - 1)
_NAME = np.uint64((1 << 47) - 1)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h & _WORD) % np.uint64(buckets)).astype(np.int64)


def _names(h: np.ndarray) -> np.ndarray:
    """48-bit names, ascending order of words before bigrams kept by sorting."""
    return (h & _NAME) | ((h & _PAIR) >> np.uint64(16))


def _pack_names(sorted_names: np.ndarray) -> bytes:
    """Ascending names as differences: 32 low bits, then the 16 high ones, which are small and compress."""
    d = np.diff(sorted_names, prepend=np.uint64(0))
    return (d & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (d >> np.uint64(32)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack_names(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    high = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n, 4 * n).reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))


def _varint(x: np.ndarray) -> bytes:
    """Counts as byte planes: mostly small, so that the high planes compress away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unvarint(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def batched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """docs as packed rows of batch, part and blob (ids and texts, compressed); a batch has one part."""
    n = max(1, -(-text_bytes(small_batches(docs), text_col) // BATCH_BYTES))
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    u = F.xxhash64("id", "text", F.lit(3))
    held_out = fold("id") == 1
    part = F.when(held_out, OUT).when(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(DELETED)) == 0, HELD).otherwise(MAIN)
    share = F.when(F.col("part") == OUT, max(1, n // FOLDS)).when(F.col("part") == HELD, max(1, n // DELETED)).otherwise(n)
    src = src.withColumn("part", part)
    src = src.withColumn("batch", (F.pmod(u, share) * 3 + F.col("part")).cast("long"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blobs(held: pd.DataFrame) -> pd.DataFrame:
            rows = [(k, p, zstandard.compress(pickle.dumps((own["id"].tolist(), own["text"].tolist())), 3)) for (k, p), own in held.groupby(["batch", "part"])]
            return pd.DataFrame(rows, columns=["batch", "part", "blob"])

        held, waiting = [], 0
        for b in batches:
            held.append(b)
            waiting += int(b["text"].str.len().sum())
            if waiting >= GATHERED:
                yield blobs(pd.concat(held))
                held, waiting = [], 0
        if held:
            yield blobs(pd.concat(held))

    return src.mapInPandas(freed(pack), "batch long, part int, blob binary"), n


def unpacked(rows: pd.DataFrame) -> tuple[list, list[str]]:
    """(ids, texts) of a batch's packed rows."""
    ids, texts = [], []
    for blob in rows["blob"]:
        i, t = pickle.loads(zstandard.decompress(blob))
        ids += i
        texts += t
    return ids, texts


def answers(src: DataFrame, buckets: int) -> DataFrame:
    """For each batch and bucket: main and held-out counts of the batch's distinct hashes of that bucket, in order."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        own, count = _wanted(unpacked(rows)[1])
        bucket = _bucket_of(own, buckets)
        order = np.lexsort((_names(own), bucket))
        batch, part = int(rows["batch"].iat[0]), int(rows["part"].iat[0])
        out = [(i, batch, part, _pack_names(_names(own[o])), _varint(count[o])) for i, lo, hi in cuts(bucket[order]) for o in [order[lo:hi]]]
        return pd.DataFrame(out, columns=["bucket", "batch", "part", "hashes", "counts"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack_names(x) for x in rows["hashes"]]
        kind = np.repeat(rows["part"].to_numpy(), [len(p) for p in parts])
        count = np.concatenate([_unvarint(x) for x in rows["counts"]])
        own, inv = np.unique(np.concatenate(parts), return_inverse=True)
        main, held = (np.bincount(inv, np.where(kind == k, count, 0), len(own)).astype(np.int64) for k in (MAIN, HELD))
        word = own <= _NAME
        sums = [int((main + held)[word].sum()), int(((main + held)[word] > 0).sum()), int(main[word].sum())]
        at = np.cumsum([0, *map(len, parts)])
        out = [(b, int(rows["bucket"].iat[0]), _varint(main[i]), _varint(held[i]), sums if k == 0 else [0, 0, 0]) for k, b in enumerate(rows["batch"]) for i in [inv[at[k] : at[k + 1]]]]
        return pd.DataFrame(out, columns=["batch", "bucket", "main", "held", "sums"])

    asked = src.groupBy("batch").applyInPandas(freed_group(ask), "bucket int, batch long, part int, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(freed_group(answer), "batch long, bucket int, main binary, held binary, sums array<long>")


class Counts:
    """A batch's counts by hash."""

    def __init__(self, texts: list[str], answer: pd.DataFrame, buckets: int):
        own, self.local = _wanted(texts)
        order = np.lexsort((_names(own), _bucket_of(own, buckets)))
        answer = answer.sort_values("bucket")
        self.own = own
        self.main, self.held = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        for out, col in ((self.main, "main"), (self.held, "held")):
            out[order] = np.concatenate([_unvarint(x) for x in answer[col]])

    def at(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.own, h)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXT_BUCKETS - 1, np.floor(np.log2(np.maximum(c, 0.5)) + 1).astype(np.int64))


def expectation_maximisation(cells: np.ndarray, log_uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(CONTEXT_BUCKETS, 3) weights of the bigram, unigram and uniform estimates.

    cells: rows (context bucket, bigram estimate, unigram estimate, held-out count).
    A bucket without held-out counts keeps equal weights, and none for the bigram where the context is unseen.
    """
    w = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    w[0] = (0.0, 0.5, 0.5)
    if not len(cells):
        return w
    b = cells[:, 0].astype(int)
    p = np.column_stack([cells[:, 1], cells[:, 2], np.full(len(cells), 10.0**log_uniform)])
    for _ in range(rounds):
        post = w[b] * p
        post *= (cells[:, 3] / np.maximum(post.sum(1), 1e-300))[:, None]
        new = np.zeros_like(w)
        np.add.at(new, b, post)
        seen = new.sum(1) > 0
        w[seen] = new[seen] / new[seen].sum(1, keepdims=True)
    w = 0.999 * w + 0.001 * np.array([0.0, 0.5, 0.5])  # no estimate that could be zero stands alone
    return w / w.sum(1, keepdims=True)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id) mod 5 is not 1. Null texts are empty (their end token alone); without
    training tokens the estimates are uniform. Repeated rows each give a row and each count; null ids count as the empty
    text in the fold; other columns are not looked at.
    """
    src, n = batched(docs, id_col, text_col)
    buckets = max(1, n)
    kind = dict(docs.dtypes)[id_col]
    told = materialize(answers(src, buckets), "answers")
    sums = told.agg(*[F.sum(F.col("sums")[i]) for i in range(3)]).first()
    total, vocab, main_total = (int(x or 0) for x in sums)
    log_uniform = -np.log10(vocab + 1)

    def cells(key, rows: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        """Held-out occurrences by context bucket and bins of the main part's estimates, with sums of these estimates'
        negative log10 in millionths (whole numbers: the sums don't depend on their order). Bin -1: estimate 0."""
        texts = unpacked(rows)[1]
        c = Counts(texts, answer, buckets)
        out = []
        for s, e in slices([len(t) for t in texts], SLICE):
            tok, pair, _ = grams(texts[s:e])
            one, two = c.main[c.at(tok & _WORD)], c.main[c.at(pair | _PAIR)]
            context = np.append(c.main[c.at(np.array([_END & _WORD]))], one[:-1])
            with np.errstate(divide="ignore"):
                fine = [np.where(k > 0, np.rint(-1e6 * np.log10(k / np.maximum(of, 1))), -1e6).astype(np.int64) for k, of in ((two, context), (one, main_total))]
            cell = np.column_stack([context_bucket(context), *[np.minimum(np.where(f < 0, -1, f * BINS // 10**6), BINS * DECADES) for f in fine]])
            own, inv, k = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
            out.append(np.column_stack([own, k, *[np.bincount(inv.ravel(), f, len(own)).astype(np.int64) for f in fine]]))
        return pd.DataFrame(np.concatenate(out), columns=CELLS)

    held = src.where(F.col("part") == HELD)
    batches = told.where(F.col("batch") % 3 == HELD)
    binned = held.groupBy("batch").cogroup(batches.groupBy("batch")).applyInPandas(lambda key, a, b: cells(key, a, b) if len(a) else pd.DataFrame(columns=CELLS), ", ".join(f"{c} long" for c in CELLS))
    summed = binned.groupBy(*CELLS[:3]).agg(*[F.sum(c).alias(c) for c in CELLS[3:]]).collect()  # at most CONTEXT_BUCKETS * (BINS * DECADES + 2)^2 rows
    mean = lambda bin_, total_, n: 0.0 if bin_ < 0 else 10.0 ** (-1e-6 * total_ / n)
    table_ = [(r["b"], mean(r["f2"], r["s2"], r["n"]), mean(r["f1"], r["s1"], r["n"]), r["n"]) for r in sorted(summed)]
    weights = expectation_maximisation(np.array(table_, float).reshape(-1, 4), log_uniform)

    def score(key, rows: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        ids, texts = unpacked(rows)
        if not texts:
            return pd.DataFrame(columns=["id", "n_tokens", "n_known", "base_score", "score"])
        c = Counts(texts, answer, buckets)
        both = c.main + c.held
        out = []
        for s, e in slices([len(t) for t in texts], SLICE):
            tok, pair, doc = grams(texts[s:e])
            one, two = both[c.at(tok & _WORD)], both[c.at(pair | _PAIR)]
            context = np.append(both[c.at(np.array([_END & _WORD]))], one[:-1])
            w = weights[context_bucket(context)]
            p = w[:, 0] * (two / np.maximum(context, 1)) + w[:, 1] * (one / max(total, 1)) + w[:, 2] * 10.0**log_uniform
            p = np.where((context == 0) & (w[:, 0] > 0), p / np.maximum(1 - w[:, 0], 1e-12), p)
            base = np.log10((one + 0.5) / (total + 0.5 * (vocab + 1)))
            m = e - s
            out.append(pd.DataFrame({"n_tokens": np.bincount(doc, minlength=m), "n_known": np.bincount(doc, one > 0, m).astype(np.int64), "base_score": np.bincount(doc, base, m), "score": np.bincount(doc, np.log10(p), m)}))
        frame = pd.concat(out, ignore_index=True)
        frame.insert(0, "id", ids)
        return frame

    scored = src.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(score, "id string, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").cast(kind).alias(id_col), (fold("id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
