"""Language ID: a bidirectional gated recurrent network over bytes.

Every byte position of a text gets a probability for each language, from a forward and a backward state; a document's
probabilities are the mean over its positions. The network is trained here, in numpy, by backpropagation through time on
windows of a bounded, stratified sample of labelled documents. Gates are piecewise linear and the candidate is softsign,
which keeps a step to a few vector operations.

Long texts are read whole, as windows that each label `CORE` positions and warm their two states on `CONTEXT` bytes of the
neighbouring text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import as_sent, fold, freed, materialize, sent_type, slices, small_batches, table

HIDDEN = 8
CORE, CONTEXT = 448, 24
#: Windows labelled at a time: as many as keep their probabilities at BATCH_CELLS numbers a byte position.
BATCH_CELLS = 2048
PAD = 256
#: Bound of the training sample: documents of each language, windows of a document, characters of a window, documents of all
#: languages together (with more than DOCS / DOCS_PER_LANG languages each has fewer, but at least one).
DOCS_PER_LANG, WINDOWS_PER_DOC, WINDOW_CHARS, DOCS = 300, 3, 64, 60_000
#: Languages up to which their shares of the sample are broadcast; beyond, they join by shuffle.
BROADCAST_LANGS = 100_000
STEPS, BATCH, RATE = 220, 128, 0.02
UNDETERMINED = "und"


@dataclass
class Model:
    """langs; t: (2, 257, 3H) input rows of both directions; u: (2, H, 3H) recurrent; wo: (2, H, K), bo: (K,) output."""

    langs: list[str]
    t: np.ndarray
    u: np.ndarray
    wo: np.ndarray
    bo: np.ndarray


def train(windows: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit on (language, bytes) windows; each position's cross-entropy counts alike."""
    langs = sorted({lang for lang, _ in windows})
    k, h3 = max(1, len(langs)), 3 * hidden
    rng = np.random.default_rng(seed)
    p = {
        "t": rng.normal(0, 0.4, (2, 257, h3)), "u": rng.normal(0, 0.4 / hidden**0.5, (2, hidden, h3)),
        "wo": rng.normal(0, 0.5 / hidden**0.5, (2, hidden, k)), "bo": np.zeros(k),
    }
    if langs:
        length = max(len(b) for _, b in windows)
        x = np.full((len(windows), length), PAD, np.intp)
        for i, (_, b) in enumerate(windows):
            x[i, : len(b)] = np.frombuffer(b, np.uint8)
        y = np.searchsorted(langs, [lang for lang, _ in windows])
        first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            grad = _gradients(p, x[pick], y[pick], hidden)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, g in grad.items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                p[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    p["t"][:, PAD] = 0
    p["t"][:, PAD, :hidden] = 1e4  # the update gate is then 1: padding leaves the state as it is
    return Model(langs, *(np.ascontiguousarray(p[n], np.float32) for n in ("t", "u", "wo", "bo")))


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, hidden: int) -> dict:
    """Backpropagation through time over both directions at once; axis 0 is the direction."""
    b, length = x.shape
    order = np.stack([x.T, x.T[::-1]], 1)  # (length, 2, b)
    both = np.arange(2)[:, None]
    h = np.zeros((2, b, hidden))
    kept = []
    for s in range(length):
        u = h @ p["u"]
        a = p["t"][both, order[s]]
        z, r = np.split(np.clip(0.25 * (a + u)[..., : 2 * hidden] + 0.5, 0, 1), 2, -1)
        c = a[..., 2 * hidden :] + r * u[..., 2 * hidden :]
        n = c / (1 + np.abs(c))
        kept.append((h, u[..., 2 * hidden :], z, r, c, n))
        live = (order[s] != PAD)[..., None]
        h = np.where(live, n + z * (h - n), h)
        kept[-1] += (live, h)
    hs = np.stack([k[-1] for k in kept])  # (length, 2, b, hidden)
    hs_at = np.stack([hs[:, 0], hs[::-1, 1]], 1)  # by position
    logits = np.einsum("ldbh,dhk->lbk", hs_at, p["wo"]) + p["bo"]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    d = e / e.sum(-1, keepdims=True)
    d[:, np.arange(b), y] -= 1
    d *= (x.T != PAD)[..., None] / max(1, (x != PAD).sum())
    grad = {"wo": np.einsum("ldbh,lbk->dhk", hs_at, d), "bo": d.sum((0, 1)), "u": np.zeros_like(p["u"])}
    dh_at = np.einsum("lbk,dhk->ldbh", d, p["wo"])
    dh_in = np.stack([dh_at[:, 0], dh_at[::-1, 1]], 1)
    dh = np.zeros((2, b, hidden))
    rows = np.zeros((length, 2, b, 3 * hidden))
    for s in range(length - 1, -1, -1):
        before, uc, z, r, c, n, live, _ = kept[s]
        dh = dh + dh_in[s]
        dn, dz = dh * (1 - z), dh * (before - n)
        dc = dn / (1 + np.abs(c)) ** 2
        dzr = np.concatenate([dz * ((z > 0) & (z < 1)), dc * uc * ((r > 0) & (r < 1))], -1) * 0.25
        du = np.concatenate([dzr, dc * r], -1) * live
        rows[s] = np.concatenate([dzr, dc], -1) * live
        grad["u"] += np.swapaxes(before, 1, 2) @ du
        dh = np.where(live, dh * z + du @ np.swapaxes(p["u"], 1, 2), dh)
    grad["t"] = np.zeros_like(p["t"])
    for k in range(2):
        where, what = order[:, k].ravel(), rows[:, k].reshape(-1, 3 * hidden)
        for j in range(3 * hidden):
            grad["t"][k, :, j] = np.bincount(where, what[:, j], 257)
    return grad


def _probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """(K, length, windows) probabilities of every position; x: (length, windows) bytes or PAD.

    The three gates lie in arrays of their own, so that every step works on contiguous memory.
    """
    length, b = x.shape
    hidden, k = m.u.shape[1], m.wo.shape[2]
    logits = np.zeros((length, b, k), np.float32)
    z, r, n, rec = (np.empty((b, hidden), np.float32) for _ in range(4))
    out = np.empty((b, k), np.float32)
    for d in range(2):
        t, u = (np.split(w, 3, -1) for w in (m.t[d], m.u[d]))
        tz, tr, tn = (np.ascontiguousarray(w) for w in (t[0] * 0.25 + 0.5, t[1] * 0.25 + 0.5, t[2]))
        uz, ur, un = (np.ascontiguousarray(w) for w in (u[0] * 0.25, u[1] * 0.25, u[2]))
        h = np.zeros((b, hidden), np.float32)
        for s in range(length) if d == 0 else range(length - 1, -1, -1):
            for gate, rows, weights in ((z, tz, uz), (r, tr, ur)):
                np.take(rows, x[s], axis=0, out=gate, mode="clip")
                np.matmul(h, weights, out=rec)
                gate += rec
                np.maximum(gate, 0, out=gate)
                np.minimum(gate, 1, out=gate)
            np.take(tn, x[s], axis=0, out=n, mode="clip")
            np.matmul(h, un, out=rec)
            rec *= r
            n += rec
            np.abs(n, out=rec)
            rec += 1
            n /= rec
            h -= n
            h *= z
            h += n
            np.matmul(h, m.wo[d], out=out)
            logits[s] += out
    prob = np.ascontiguousarray(np.moveaxis(logits, -1, 0))
    del logits
    prob += m.bo[:, None, None]
    prob -= prob.max(0)
    np.exp(prob, out=prob)
    prob /= prob.sum(0)
    return prob


def pooled(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: mean probabilities over all its positions (K), and how many positions each label wins (K)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sums, wins = np.zeros((len(raw), len(m.langs))), np.zeros((len(raw), len(m.langs)), np.int64)
    cuts = [(i, s, max(0, s - CONTEXT), min(len(r), s + CORE + CONTEXT)) for i, r in enumerate(raw) for s in range(0, len(r), CORE)]
    cuts.sort(key=lambda c: c[3] - c[2])
    batch = max(16, min(1024, BATCH_CELLS // max(1, len(m.langs))))
    for at in range(0, len(cuts), batch):
        own = cuts[at : at + batch]
        length = max(b - a for _, _, a, b in own)
        x = np.full((len(own), length), PAD, np.intp)
        lab = np.zeros((len(own), length), bool)
        for j, (i, s, a, b) in enumerate(own):
            x[j, : b - a] = np.frombuffer(raw[i], np.uint8, b - a, a)
            lab[j, s - a : min(s + CORE, len(raw[i])) - a] = True
        prob = _probabilities(m, np.ascontiguousarray(x.T))
        best = np.where(lab.T, prob.argmax(0), -1)
        prob *= lab.T
        doc = [c[0] for c in own]
        np.add.at(sums, doc, prob.sum(1, dtype=np.float64).T)
        np.add.at(wins, doc, np.stack([(best == k).sum(0) for k in range(len(m.langs))], -1))
    return sums / np.maximum(1, [[len(r)] for r in raw]), wins


def training_windows(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> list[tuple[str, bytes]]:
    """A bounded sample: at most docs_per_lang documents of each language by hash order (fewer where languages are very many,
    see DOCS), WINDOWS_PER_DOC windows of each."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    langs = sizes.count()
    docs_per_lang = max(1, min(docs_per_lang, DOCS // max(1, langs)))
    share = sizes.select("lang", (F.lit(2.0 * docs_per_lang) / F.col("n")).alias("share"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)).alias("u")
    near = known.select("doc_id", "lang", "text", u).join(F.broadcast(share) if langs <= BROADCAST_LANGS else share, "lang").where("u < share")
    parts = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {i}), greatest(1, length(text) - {WINDOW_CHARS})) as int), {WINDOW_CHARS})") for i in range(WINDOWS_PER_DOC)]
    near = near.select("doc_id", "lang", "u", F.xxhash64("text").alias("t"), F.array_distinct(F.array(*parts)).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "t"))
    rows = near.withColumn("r", rank).where(F.col("r") <= docs_per_lang).orderBy("lang", "r").collect()
    return [(r["lang"], w.encode()) for r in rows for w in r["parts"] if w]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (mean probability of that label, 0 to 1), positions, agree (share of
    positions whose own label is lang_pred).

    `und` with score 0 if the text is null, has no letter, or the model knows no language. Ties go to the language that
    sorts first. Repeated rows each give a row; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
                own = texts[lo:hi]
                prob, wins = pooled(model, own) if model.langs else (None, np.zeros((len(own), 1), np.int64))
                rows = []
                for i, t in enumerate(own):
                    n = int(wins[i].sum())
                    if not model.langs or not t or not b["letters"].iat[lo + i]:
                        rows.append((UNDETERMINED, 0.0, n, 0.0))
                    else:
                        k = int(prob[i].argmax())
                        rows.append((model.langs[k], float(min(1.0, prob[i, k])), n, float(wins[i, k]) / n))
                out = pd.DataFrame(rows, columns=["lang_pred", "score", "positions", "agree"])
                out.insert(0, "id", b["id"].iloc[lo:hi].array)
                yield out

    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("letters", F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    out = as_sent(src).mapInPandas(freed(run), f"id {sent_type(src, 'id')}, lang_pred string, score double, positions long, agree double")
    return out.withColumn("id", F.col("id").cast(dict(src.dtypes)["id"])).withColumnRenamed("id", id_col)


#: Label of text in no language, which a model with `noise` learns from made-up windows (see `noise_windows`).
NOISE = ""
#: Made-up texts beside the documents that `noise_bound` reads and their length, the quantiles of both, how far from the
#: documents' towards the noise's the bound lies, and the fractions of 1 in which margins are counted.
MADE_UP, MADE_UP_CHARS, HIGH_QUANTILE, LOW_QUANTILE, TOWARDS, FRACTIONS = 200, 1_000, 0.995, 0.05, 0.7, 10_000
#: Column of `with_margins`.
MARGIN = "__margin"


def random_letters(letters: str, length: int, rng: np.random.Generator, few: bool = False) -> str:
    """Letters drawn at random, of all or of only a few, with spaces at a rate of up to 30 %."""
    own = rng.choice(list(letters), rng.integers(3, 12)) if few else np.array(list(letters))
    return "".join(np.where(rng.random(length) < rng.uniform(0, 0.3), " ", rng.choice(own, length)))


def _letters(texts: list[str]) -> str:
    """The letters that occur, and those and the digits of ASCII."""
    return "".join(sorted({c for t in texts for c in t if c.isalpha()} | set(string.ascii_letters + string.digits)))


def noise_windows(windows: list[tuple[str, bytes]], seed: int = 5) -> list[tuple[str, bytes]]:
    """Windows in no language, one for each so many as a language has on average: in turn a window with its characters
    shuffled, random letters of those that occur, and random ones of a few of them."""
    rng, out = np.random.default_rng(seed), []
    letters = _letters([b.decode("utf-8", "replace") for _, b in windows])
    for i, (_, b) in enumerate(windows[:: max(1, len({lang for lang, _ in windows}) // 2 + 1)]):
        text = "".join(rng.permutation(list(b.decode("utf-8", "replace")))) if i % 3 == 0 else random_letters(letters, WINDOW_CHARS, rng, i % 3 == 2)
        out.append((NOISE, text.encode()))
    return out


def noise_margins(model: Model, texts: list[str]) -> np.ndarray:
    """How much likelier each text is to be noise than of its best language, from -1 to 1."""
    noise = np.array([lang == NOISE for lang in model.langs])
    if not noise.any() or noise.all():
        return np.full(len(texts), -1.0)
    prob = pooled(model, texts)[0]
    return prob[:, noise].sum(1) - prob[:, ~noise].max(1)


def with_margins(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text has a letter, with their noise margin (see `noise_margins`) in a column MARGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            margins = [noise_margins(model, texts[lo:hi]) for lo, hi in slices([len(t) for t in texts], 1_000_000)]
            if margins:
                yield b.append_column(MARGIN, pa.array(np.concatenate(margins)))

    lettered = small_batches(docs).where(F.regexp_like("text", F.lit(r"\p{L}")))
    return lettered.mapInArrow(freed(run), StructType([*docs.schema.fields, StructField(MARGIN, DoubleType())]))


def _occurring(docs: DataFrame) -> str:
    """The letters that occur in any text of docs, and those and the digits of ASCII."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"letter": sorted({c for t in b.column("text").to_pylist() for c in set(t) if c.isalpha()})}, pa.schema([("letter", pa.string())]))

    return _letters([r["letter"] for r in docs.select("text").mapInArrow(freed(run), "letter string").distinct().collect()])  # letters there are


def _bound(judged: DataFrame, model: Model) -> float:
    """noise_bound of documents that have their margins."""
    held = judged.where(fold() == 0).where("lang IS NOT NULL")
    # at most 2 * FRACTIONS + 1 rows; every document is counted
    counts = held.groupBy(F.ceil(F.col(MARGIN) * FRACTIONS).alias("margin")).agg(F.count(F.lit(1)).alias("n")).orderBy("margin").collect()
    if not counts:
        return TOWARDS
    upto = np.cumsum([r["n"] for r in counts])
    low = counts[int(np.searchsorted(upto, HIGH_QUANTILE * upto[-1]))]["margin"] / FRACTIONS
    rng, letters = np.random.default_rng(9), _occurring(held)
    made_up = [random_letters(letters, MADE_UP_CHARS, rng, i % 2 == 1) for i in range(MADE_UP)]
    high = float(np.quantile(noise_margins(model, made_up), LOW_QUANTILE))
    return max(0.0, low + TOWARDS * (high - low), low)


def noise_bound(docs: DataFrame, model: Model) -> float:
    """Margin from which a text counts as in no language: between the margins of all labelled documents that the model has not
    learned from (HIGH_QUANTILE, in steps of 1 / FRACTIONS) and those of made-up texts (LOW_QUANTILE), TOWARDS of the way; never
    below 0, so that a text whose best language beats noise stays. Without such documents it is TOWARDS."""
    return _bound(with_margins(docs.where(fold() == 0).where("lang IS NOT NULL"), model).select("doc_id", "lang", "text", MARGIN), model)


def keep_identified(docs: DataFrame, model: Model, bound: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns untouched, whose text has a letter and is not more like noise than like its
    best language by more than `bound` (by default `noise_bound`). model: one with `noise`; with another, all texts with a
    letter stay.

    Null and empty texts go. Repeated rows are judged alike; null ids stay null; an empty table gives no rows.
    """
    judged = with_margins(docs, model)
    if bound is None:  # every text is judged once, for the bound and by it
        judged = materialize(judged, "margins")
        bound = _bound(judged, model)
    return judged.where(F.col(MARGIN) <= bound).select(*docs.columns)


def fit(docs: DataFrame, noise: bool = False) -> Model:
    """Learns from the labelled documents whose crc32(doc_id) mod 5 is not 0; noise: also what no language looks like."""
    windows = training_windows(docs.where(fold() != 0))
    return train(windows + noise_windows(windows) if noise else windows)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "positions", "agree")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
