import corpus_pipeline as C

from tests.llm.test_jaccard_join import brute
from tests.llm.test_packing import check_pieces
from textloom.llm import decontamination, pii


def test_stages_take_effect(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    kept = C.materialize(C.identify_language(spark, docs, sf_dir))
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.where("text IS NOT NULL").count()
    one = C.materialize(C.drop_near_duplicates(spark, kept, sf_dir))
    want = {c for i, _, c in brute([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80) if i == c}
    assert {r["doc_id"] for r in one.collect()} == want
    clean = C.materialize(C.decontaminate(spark, one, sf_dir))
    flags = decontamination.contaminated(one, C.table(spark, sf_dir, "benchmark"))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in flags.where("NOT contaminated").collect()}
    safe = C.materialize(C.redact(spark, clean, sf_dir))
    assert safe.columns == docs.columns and not any(pii.base_spans(r["text"]) for r in safe.collect())
    check_pieces(C.pack(spark, safe, sf_dir).collect(), {r["doc_id"]: r["text"] for r in safe.collect()})


def test_run_matches_plain_python(spark, sf_dir):
    """All five stages over dictionaries, one document after the other."""
    import math
    import re
    import zlib

    import numpy as np

    from textloom.llm import language_id
    from textloom.llm import tokens as T

    table = C.table(spark, sf_dir, "documents")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    model = language_id.fit(table, noise=True)
    bound = language_id.noise_bound(table, model)
    lettered = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    margins = language_id.noise_margins(model, list(lettered.values()))
    kept = {i: t for (i, t), m in zip(lettered.items(), margins, strict=True) if m <= bound}
    one = {i: kept[i] for i, _, c in brute(list(kept.items()), 5, 80) if i == c}

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [words(r["text"]) for r in C.table(spark, sf_dir, "benchmark").collect()]

    def holds(text):
        own = np.array(words(text))
        for item in items:
            span = min(13, len(item))
            need = math.ceil(span * 0.8 - 1e-9)
            for j in range(len(item) - span + 1):
                if len(own) >= span:
                    hits = sum((own[k : len(own) - span + 1 + k] == w).astype(int) for k, w in enumerate(item[j : j + span]))
                    if hits.max() >= need:
                        return True
        return False

    clean = {i: t for i, t in one.items() if not holds(t)}
    stage = table.where(table.doc_id.isin(list(clean)))
    field = pii.fit(stage)
    base = [pii.base_spans(t) for t in clean.values()]
    more = pii.added_spans(list(clean.values()), field, base)
    safe = {i: pii.redact(t, [{"kind": pii.KINDS[k], "start": s, "end": e} for s, k, e in sorted(p + q)]) for (i, t), p, q in zip(clean.items(), base, more, strict=True)}
    want = set()
    for i, t in safe.items():
        ids = T.encode(t)
        want |= {(i, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024])) for s in range(0, len(ids), 1024)}
    rows = C.run(spark, sf_dir).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_pieces(rows, safe)


def test_stages_on_edges(spark, sf_dir, edge_docs, no_docs):
    """Nulls, repeated rows, clashing names and empty tables in every stage."""
    for name, stage in C.STAGES:
        assert C.materialize(stage(spark, no_docs, sf_dir)).count() == 0, name
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    kept = C.materialize(C.identify_language(spark, edge_docs, sf_dir))
    assert kept.columns == edge_docs.columns and set(ids(kept)) <= set(ids(edge_docs)) - {"4", "5", "6", "10"}
    one = C.materialize(C.drop_near_duplicates(spark, edge_docs, sf_dir))
    assert one.columns == edge_docs.columns and "2" not in ids(one) and {"1", "None", "4", "9"} <= set(ids(one)) and ids(one).count("7") == 1
    clean = C.materialize(C.decontaminate(spark, edge_docs, sf_dir))
    assert clean.columns == edge_docs.columns and ids(clean) == ids(edge_docs)
    safe = C.materialize(C.redact(spark, edge_docs, sf_dir))
    assert safe.columns == edge_docs.columns and ids(safe) == ids(edge_docs)
    packed = C.pack(spark, edge_docs, sf_dir)
    assert packed.where("start = 0").count() == edge_docs.count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert len(C.STAGES) == 5
