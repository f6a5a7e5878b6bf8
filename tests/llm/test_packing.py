import random
import zlib

import numpy as np
from textloom.llm import binary_output as B
from textloom.llm import packing as K
from textloom.llm import tokens as T


def test_ids_equal_the_merges_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|> x<|endoftext|>", "été 日本 🎉 don't 12345", "\u00a0\u2003x"] + ["".join(rng.choice("abcdef ABé\n\t .,'12<|>") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False), strict=True):
        assert T.encode(t).tolist() == [*e.ids, T.END_ID], t


def test_patterns_place_every_length():
    rng = random.Random(2)
    for _ in range(20):
        hist = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(30)}
        pats = K.shortest_pack_first(hist, 64)
        seen = {}
        for c, p in pats:
            assert sum(p) <= 64 and c > 0
            for n in p:
                seen[n] = seen.get(n, 0) + c
        assert seen == hist


def check_pieces(rows, docs):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= K.MAX_LEN
    for i, text in docs.items():
        ids, at = T.encode(text), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].astype("<u4"))
            at += r["length"]
        assert at == len(ids)
    return len(by_seq)


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()}
    rows = K.op5_packing(spark, sf_dir).collect()
    n = check_pieces(rows, docs)
    assert sum(r["length"] for r in rows) > 0.97 * K.MAX_LEN * (n - 1)


def test_edges(spark, edge_docs, no_docs, edge_rows):
    from textloom.llm.shared import materialize

    rows = K.pack(materialize(K.pieces(edge_docs))).collect()
    assert sum(r["length"] for r in rows) == sum(len(T.encode(t)) for _, t, *_ in edge_rows)
    assert K.pack(materialize(K.pieces(no_docs))).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 33, rng.integers(1, 80))
        left, want = [], []
        for k in np.argsort(-n, kind="stable"):
            fits = [(r, i) for i, r in enumerate(left) if r >= n[k]]
            if fits:
                best = min(r for r, _ in fits)
                i = [i for r, i in fits if r == best][-1]
                left[i] -= n[k]
            else:
                left.append(32 - n[k])
            want.append(sorted(left))
        got = B.best_fit_decreasing(n, 32)
        assert sorted(k for b in got for k in b) == list(range(len(n)))
        assert sorted(32 - sum(n[k] for k in b) for b in got) == want[-1]


def test_matrices_round_trip(spark, edge_docs, no_docs, edge_rows, tmp_path):
    packed = B.packed_matrices(edge_docs, seq_len=64)
    B.write_matrices(packed, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert all(len(r["input_ids"]) == 128 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] for r in back.collect())
    seg = {}
    for r in B.unpack(back).collect():
        seg.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u2")))
    for i, t, *_ in edge_rows:
        if i not in (None, 7):
            assert np.concatenate([x for _, x in sorted(seg[i], key=lambda p: p[0])]).tolist() == T.encode(t).tolist()
    assert B.packed_matrices(no_docs).count() == 0


def test_matrix_query(spark, sf_dir):
    """Every document comes back whole; segments, resets and checksums fit the ids."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()}
    found = {}
    for r in B.op8_binary_output(spark, sf_dir).collect():
        ids = np.frombuffer(r["input_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == B.SEQ_LEN and cu[0] == 0 and cu == sorted(cu) and cu[-1] == r["n_tokens"] <= B.SEQ_LEN
        assert r["position_resets"] == cu[:-1] and len(r["doc_ids"]) == len(r["doc_starts"]) == len(cu) - 1
        assert not ids[r["n_tokens"] :].any() and r["ids_crc32"] == zlib.crc32(bytes(r["input_ids"]))
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:]):
            found.setdefault(d, {})[s] = ids[a:b]
    assert set(found) == set(docs)
    for d, parts in found.items():
        at = 0
        for s in sorted(parts):
            assert s == at
            at += len(parts[s])
        assert np.concatenate([parts[s] for s in sorted(parts)]).tolist() == T.encode(docs[d]).tolist()
