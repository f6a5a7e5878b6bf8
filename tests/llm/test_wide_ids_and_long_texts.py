"""Ids that a double cannot hold, beside nulls; texts that are long in awkward ways."""

import numpy as np
import pytest
from textloom.llm import binary_output, jaccard_join, language_id, lm_scoring, packing, pii, suffix_dedup
from textloom.llm import shared as S
from textloom.llm import tokens as T

BIG = 2**53 + 1
SPAN = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(BIG, SPAN + " me@x.org", "en", "a", BIG), (None, SPAN, "en", "a", None), (BIG + 2, "le été " * 40, "fr", "a", 3), (5, None, None, None, BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=lambda x: (x is None, x))


def test_ids_stay_whole(wide):
    every = [5, BIG, BIG + 2, None]
    model = language_id.fit(wide)
    field = pii.fit(wide)
    assert ids(language_id.identify(wide, model)) == every
    assert {(r["doc_id"], r["n_chars"]) for r in language_id.keep_identified(wide, model, 0.0).collect()} == {(BIG, BIG), (None, None), (BIG + 2, 3)}
    assert ids(pii.find_pii(wide, field)) == every
    assert {r["doc_id"]: r["n_chars"] for r in pii.redact_texts(wide, field).collect()} == {BIG: len(SPAN + " [EMAIL]"), None: len(SPAN), BIG + 2: 7 * 40, 5: BIG}
    assert ids(lm_scoring.score_documents(wide)) == every
    assert set(ids(packing.pieces(wide))) == set(every)
    assert {i for r in binary_output.packed_matrices(wide).collect() for i in r["doc_ids"]} == set(every)
    linked = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_components(wide).collect()}
    assert linked == {BIG: BIG, None: BIG, BIG + 2: BIG + 2, 5: 5}
    assert ids(suffix_dedup.repeated_spans(wide)) == every
    assert ids(jaccard_join.keep_one(wide)) == [5, BIG, BIG + 2]


def test_one_row_of_a_group_stays(spark):
    """Also where the kept row's id has another text."""
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(1, SPAN), (1, other), (2, other + " more"), (3, SPAN + " x"), (1, SPAN), (4, None), (4, None), (6, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, SPAN), (1, other), (4, None), (6, "")], key=str)


def test_long_white_space_has_the_ids_of_the_merges_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 6_000
    texts = [" " * n, "a" + " " * n, " " * n + "b", "a" + "\n" * n + " b", "x" + " \t" * n + " " * n + "<|endoftext|>" + " " * n + "y", "a" + "\x1c" * n]
    for t, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False), strict=True):
        assert T.encode(t).tolist() == [*e.ids, T.END_ID]
    assert len(T.encode(" " * 2_000_000 + "x")) > 1  # the pattern alone would give up


def test_personal_data_in_long_runs():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 1, 5007)]
    for t in ("1234567890" * 100_000, "." * 1_000_000 + "1", " " * 1_000_000 + "1", "1.1." * 250_000, "@" * 1_000_000, "a@" * 300_000):
        base = pii.base_spans(t)
        pii.added_spans([t], pii.train(["a@b.co 1.2.3.4"]), [base])
    assert not pii.base_spans("1" * 4301 + ".1.1.1") and pii.base_spans("000.0.0.0255") == [(0, 1, 12)]


def test_words_of_a_long_text_do_not_depend_on_its_parts(monkeypatch):
    texts = ["aB cd " * 400, None, "one", "x" * 3000 + "\ty z", ""]
    whole = S.word_hashes(texts)
    monkeypatch.setattr(S, "SLICE", 50)
    parts = S.word_hashes(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_span_hashes_over_blocks(monkeypatch):
    buf = np.random.default_rng(0).integers(0, 256, 2 * S._BLOCK + 77).astype(np.uint8)
    at = np.sort(np.random.default_rng(1).integers(0, len(buf) - 300, 200))
    h = S.span_hashes(buf, at, at + 300)
    assert all(S.span_hashes(buf[a : a + 300].copy(), np.array([0]), np.array([300]))[0] == x for a, x in zip(at.tolist(), h, strict=True))


def test_a_long_text_through_the_operators(spark):
    text = "alpha beta 12 " * 300_000  # 4 MB
    docs = spark.createDataFrame([(1, text, "en"), (2, "alpha beta", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["n_shingles"] for r in jaccard_join.near_components(docs, 4, 85).collect()} == {1: 3, 2: 1}
    scored = {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score_documents(docs).collect()}
    assert scored == {1: 900_001, 2: 3}
    assert packing.pieces(docs).selectExpr("sum(length) AS n").first()["n"] == len(T.encode(text)) + len(T.encode("alpha beta"))
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert cut == {1: (len(text), len(text)), 2: (10, 0)}
