"""PII spans: exact patterns, and a skip-chain conditional random field that carries their labels through a document.

Nodes are the tokens that hold a digit or `@` (every other token can only be outside). Neighbouring nodes share a
transition potential; distant nodes with equal or similar content share a skip potential, so that a token the patterns
miss takes the label its repetition elsewhere in the document has. Marginals come from loopy sum-product messages. The
weights are learned piecewise from the pattern labels of a bounded sample of documents: unaries by multinomial logistic
regression, transitions and skip agreement from smoothed counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_sent, fold, freed, hash_sample, slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("out", *KINDS)
#: Bound of the training sample: documents that hold a candidate token, whole, of so many characters at most.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
ROUNDS, ACCEPT = 6, 0.8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match starts a run of digits: each is scanned once
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"[^\s]*")
_LEAD = re.compile(r"[^A-Za-z0-9+(@]++")
_INNER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, leftmost and non-overlapping for each kind, in code points."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:  # an address holds exactly one @: look only around each, which finds the leftmost matches
        if (dom := _DOMAIN.match(text, at)) and (local := _LOCAL.search(text[_local_start(text, floor, at) : at])):
            out.append((at - len(local[0]), 0, dom.end()))
            floor = dom.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _byte(digits: str) -> bool:
    """At most 255, for any number of digits."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _local_start(text: str, floor: int, at: int) -> int:
    while at > floor and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the white-space tokens that hold a digit or @, without punctuation at their ends."""
    out, pos = [], 0
    while m := _MARK.search(text, pos):
        s = m.start()
        while s > pos and not text[s - 1].isspace():
            s -= 1
        e = _TOKEN_END.match(text, m.start()).end()
        pos = e
        lead = _LEAD.match(text, s, e)
        a, b = lead.end() if lead and lead.end() < e else s, e
        while b > s and text[b - 1] not in _INNER:
            b -= 1
        b = b if b > s else e
        if a < b:
            out.append((a, b))
    return out


N_FEATURES = 26


def features(tok: str, gap_before: bool, gap_after: bool) -> list[int]:
    """Indices of the shape features that hold for a token (0 is the bias)."""
    d = _digits(tok)
    n, dots = len(d), tok.count(".")
    f = [0, 1 + min(7, n // 2 if n < 14 else 7), 9 + min(4, dots)]
    f += [k for k, on in (
        (14, "@" in tok), (15, tok.startswith("+")), (16, "(" in tok), (17, "-" in tok), (18, n == len(tok)), (19, any(c.isalpha() for c in tok)),
        (20, n + dots == len(tok) and dots == 3), (21, 14 <= n <= 19 and luhn(d)), (22, gap_before), (23, gap_after), (24, bool(_DOMAIN.search(tok))), (25, 13 <= n <= 19),
    ) if on]
    return f


@dataclass
class Field:
    """unary: (features, labels) weights; chain: (labels, labels) log potentials; skip: log potential of agreement."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float


@dataclass
class Graph:
    nodes: list[tuple[int, int, int]]  # document, start, end
    feats: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(texts: list[str]) -> Graph:
    """Nodes and edges of a batch of documents. Skip edges join each repetition to the one before it: linear, not all pairs."""
    nodes, feats, chain, skip = [], [], [], []
    for doc, text in enumerate(texts):
        if not text or not _MARK.search(text):
            continue
        own = tokens(text)
        last: dict[str, int] = {}
        for i, (s, e) in enumerate(own):
            tok = text[s:e]
            near_b = i > 0 and s - own[i - 1][1] <= 2
            near_a = i + 1 < len(own) and own[i + 1][0] - e <= 2
            v = len(nodes)
            nodes.append((doc, s, e))
            feats.append(features(tok, near_b, near_a))
            if near_b:
                chain.append((v - 1, v))
            d = _digits(tok)
            keys = {"t" + tok.lower()}
            if len(d) >= 7:  # similar: the same digits in another layout, or the same last seven
                keys |= {"d" + d, "s" + d[-7:]}
            for k in keys:
                if k in last:
                    skip.append((last[k], v))
                last[k] = v
    return Graph(nodes, feats, chain, sorted(set(skip)))


def unary_scores(feats: list[list[int]], weights: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    out = np.zeros((len(feats), weights.shape[1]))
    np.add.at(out, rows, weights[np.concatenate([np.array(f) for f in feats])])
    return out


def marginals(field: Field, g: Graph, fixed: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over chain and skip edges; fixed: label a pattern has set, or -1."""
    k = field.chain.shape[0]
    phi = unary_scores(g.feats, field.unary)
    phi -= phi.max(1, keepdims=True)
    known = fixed >= 0
    phi[known] = -30.0
    phi[known, fixed[known]] = 0.0
    edges = np.array(g.chain + g.skip, int).reshape(-1, 2)
    agree = np.eye(k) * field.skip
    pot = np.concatenate([np.repeat(field.chain[None], len(g.chain), 0), np.repeat(agree[None], len(g.skip), 0)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), k))
    belief = phi.copy()
    for _ in range(rounds if len(src) else 0):
        out = belief[src] - msg[back]
        out -= out.max(1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out), pot) + 1e-300)
        msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
        belief = phi.copy()
        np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def pattern_labels(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each node: that of the first of its document's base spans (sorted) that it overlaps; -1 where none.

    Nodes of a document are disjoint and ascending, so one pass over its spans is enough.
    """
    out = np.full(len(g.nodes), -1)
    doc, at, live = -1, 0, []
    for v, (d, s, e) in enumerate(g.nodes):
        if d != doc:
            doc, at, live = d, 0, []
        while at < len(spans[d]) and spans[d][at][0] < e:
            live.append(spans[d][at])
            at += 1
        live = [x for x in live if x[2] > s]
        if live:
            out[v] = live[0][1] + 1
    return out


def train(texts: list[str], steps: int = 150) -> Field:
    """Piecewise: unaries by logistic regression on pattern labels, edges by smoothed counts. No candidates: neutral."""
    k = len(LABELS)
    g = graph(texts)
    w = np.zeros((N_FEATURES, k))
    w[0, 0] = 2.0
    if not g.nodes:
        return Field(w, np.zeros((k, k)), 2.0)
    labels = np.maximum(0, pattern_labels(g, [base_spans(t) for t in texts]))
    y = labels
    x = np.zeros((len(y), N_FEATURES))
    for i, f in enumerate(g.feats):
        x[i, f] = 1
    rows, counts = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y, weight = rows[:, :-1], rows[:, -1].astype(int), counts / counts.sum()
    seen = np.zeros_like(w)
    for _ in range(steps):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad = x.T @ (p * weight[:, None]) + 1e-4 * w
        seen += grad**2
        w -= 0.5 * grad / (np.sqrt(seen) + 1e-9)
    joint, single = np.ones((k, k)), np.ones(k)
    np.add.at(single, labels, 1)
    for a, b in g.chain:
        joint[labels[a], labels[b]] += 1
    single /= single.sum()
    chain = np.log(joint / joint.sum() / np.outer(single, single))
    same = sum(labels[a] == labels[b] for a, b in g.skip)
    skip = np.log((same + 1) / (len(g.skip) - same + 1)) + np.log(k - 1)
    return Field(w, np.clip(chain, -2, 2), float(np.clip(skip, 1.0, 5.0)))


def _plausible(kind: int, tok: str) -> bool:
    n = len(_digits(tok))
    if kind == 0:
        return "@" in tok
    if kind == 1:
        return tok.count(".") == 3 and n <= 12
    if any(c.isalpha() for c in tok):
        return False
    return 13 <= n <= 19 if kind == 2 else 7 <= n <= 15


def added_spans(texts: list[str], field: Field, base: list[list[tuple[int, int, int]]], accept: float = ACCEPT) -> list[list[tuple[int, int, int]]]:
    """What the field adds: nodes that overlap no base span, linked by skip edges to a labelled node, whose marginal for
    that kind is at least `accept` and whose shape allows it."""
    g = graph(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.nodes or not g.skip:
        return out
    fixed = pattern_labels(g, base)
    linked = sorted({v for edge in g.skip for v in edge})
    if not (fixed[linked] < 0).any():
        return out
    # evidence for a kind: a pattern's label somewhere along the skip edges
    root = list(range(len(g.nodes)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in g.skip:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    known = {(find(v), int(fixed[v])) for v in linked if fixed[v] > 0}
    prob = marginals(field, g, fixed)
    for v in linked:
        kind = int(prob[v].argmax())
        d, s, e = g.nodes[v]
        if fixed[v] < 0 and kind and prob[v, kind] >= accept and (find(v), kind) in known and _plausible(kind - 1, texts[d][s:e]):
            out[d].append((s, kind - 1, e))
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sample_texts(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[str]:
    """At most `most` whole texts of at most SAMPLE_CHARS characters that hold a candidate, by hash of their ids."""
    marked = docs.where((F.length("text") <= SAMPLE_CHARS) & F.regexp_like("text", F.lit("[0-9]{4}|@")))
    return [r["text"] for r in hash_sample(marked.select("doc_id", "text"), most, "doc_id", "text").collect()]


def fit(docs: DataFrame) -> Field:
    return train(sample_texts(docs.where(fold() != 0)))


RESULT = "spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns named in keep, and spans (kind, start, end in code points, base: found by
    a pattern) by start, then kind.

    Null and empty texts have none; whole texts are read; repeated rows each give a row; columns not named are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["__text"].tolist()]
            rest = b.drop(columns="__text")
            for lo, hi in slices([len(t) for t in texts], 4_000_000):
                own = texts[lo:hi]
                base = [base_spans(t) for t in own]
                more = added_spans(own, field, base)
                out = rest.iloc[lo:hi].copy()
                out["spans"] = [[{"kind": KINDS[k], "start": s, "end": e, "base": is_base} for s, k, e, is_base in sorted([(*x, True) for x in p] + [(*x, False) for x in q])] for p, q in zip(base, more, strict=True)]
                yield out

    src = small_batches(docs).select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    kinds = dict(src.dtypes)
    for c in (id_col, *keep):
        src = as_sent(src, c)
    found = src.mapInPandas(freed(run), ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != "__text") + f", {RESULT}")
    return found.select(*[F.col(c).cast(kinds[c]) for c in (id_col, *keep)], "spans")


def redact(text: str, spans) -> str:
    """Text with each span (overlaps merged into the first) replaced by its kind in brackets."""
    out, pos = [], 0
    for s in spans:
        if s["start"] >= pos:
            out += [text[pos : s["start"]], f"[{s['kind'].upper()}]"]
        pos = max(pos, s["end"])
    return "".join([*out, text[pos:]])


def redact_texts(docs: DataFrame, field: Field) -> DataFrame:
    """The columns of docs, with personal data in text replaced; n_chars, where there is one, follows the new text.

    Null texts stay null, with their n_chars; all other columns and repeated rows stay as they are; an empty table gives no
    rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(at).to_pylist()
            texts = [t or "" for t in held]
            new: list[str] = []
            for lo, hi in slices([len(t) for t in texts], 4_000_000):
                own = texts[lo:hi]
                base = [base_spans(t) for t in own]
                more = added_spans(own, field, base)
                new += [redact(t, [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(p + q)]) if p or q else t for t, p, q in zip(own, base, more, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array([None if t is None else n for n, t in zip(new, held, strict=True)], b.schema.field(at).type))

    out = small_batches(docs).mapInArrow(freed(run), docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
