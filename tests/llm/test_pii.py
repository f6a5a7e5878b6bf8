import random
import re

from textloom.llm import pii as P


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_match_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a1@.+- 5(9)%_é\n4242") for _ in range(rng.randrange(60)))
        assert P.base_spans(t) == brute(t), t


def test_skip_edges_carry_labels():
    field = P.train([f"call +1 (743) 555-38{i} now. id {i}12 v{i} 10.0.0.{i} a{i}@b.com 4242424242424242 {i}" for i in range(10, 40)])
    text = "call +1 (743) 555-3824 soon, again 743-555-3824 please; lot 99123 of 2024"
    base = P.base_spans(text)
    more = P.added_spans([text], field, [base])[0]
    assert [text[s:e] for s, _, e in more] == ["743-555-3824"] and more[0][1] == 3
    alone = "again 743-555-3824 please"
    assert P.added_spans([alone], field, [P.base_spans(alone)]) == [[]]


def test_marginals_are_exact_on_a_chain():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = P.Field(rng.normal(size=(P.N_FEATURES, 5)), rng.normal(size=(5, 5)), 1.5)
    g = P.Graph([(0, i, i + 1) for i in range(3)], [[0, i + 1] for i in range(3)], [(0, 1), (1, 2)], [])
    got = P.marginals(field, g, np.full(3, -1), 60)
    phi = P.unary_scores(g.feats, field.unary)
    want = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        w = np.exp(sum(phi[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_edges(spark, edge_docs, no_docs):
    field = P.fit(edge_docs)
    assert P.find_pii(edge_docs, field).count() == edge_docs.count()
    assert P.find_pii(no_docs, P.fit(no_docs)).count() == 0
    red = P.redact_texts(edge_docs, field)
    assert red.columns == edge_docs.columns and red.where("text IS NULL").count() == 1


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in P.op2_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(sf_dir + "/documents.parquet").collect()
    assert len(rows) == len(docs)
    import hashlib

    for d in docs:
        spans = brute(d["text"] or "")
        assert rows[d["doc_id"]]["base_sha256"] == hashlib.sha256(P.show(spans).encode()).hexdigest()
        assert [rows[d["doc_id"]][f"n_{k}"] for k in P.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
