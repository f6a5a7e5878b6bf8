from textloom.llm import decontamination as D

from tests.compare import same
from tests.llm.conftest import sentence


def found(spark, docs, items, **kw):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r["item_ids"] for r in D.contaminated(docs, b, **kw).collect()}


def test_substitutions_and_clean_texts(spark):
    item = sentence(30, at=4)
    w = item.split()
    some = [x if i % 7 else "changed" for i, x in enumerate(w)]  # every seventh word replaced
    many = [x if i % 3 else "changed" for i, x in enumerate(w)]
    texts = [item, "before " + item + " after", " ".join(some), " ".join(many), sentence(200, at=2), " ".join(w[:10]), " ".join(w[3:16]), item.upper().replace(" ", ", ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(spark, docs, [(1, item), (2, "tiny one here"), (3, None), (4, "ab"), (1, item)])
    assert got == {0: [1], 1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [1], 7: [1]}


def test_short_items(spark):
    docs = spark.createDataFrame([(0, "x tiny one here y"), (1, "tiny two here"), (2, "one here")], "doc_id long, text string")
    assert found(spark, docs, [(2, "tiny one here")]) == {0: [2], 1: [], 2: []}


def test_edges(spark, edge_docs, no_docs):
    items = [(1, sentence(50, at=17))]
    out = found(spark, edge_docs, items)
    assert out[11] == [1] and out[12] == [1] and out[4] == [] and len(out) == len({r["doc_id"] for r in edge_docs.collect()})
    assert found(spark, no_docs, items) == {}
    assert not any(found(spark, edge_docs, []).values())
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = D.drop_contaminated(edge_docs, b)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 2


def test_query(spark, duck, sf_dir):
    same(D.op6_decontamination(spark, sf_dir), duck.execute(D.ORACLES["op6_decontamination"]).fetchdf())


def test_tolerated_substitutions_in_short_items(spark):
    from itertools import combinations
    from math import ceil

    want, docs, items = {}, [], []
    for n in range(3, 14):
        w = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        free = n - ceil(0.8 * n - 1e-9)
        for k in range(free + 2):
            for gone in combinations(range(n), k):
                docs.append((len(docs), " ".join(["before", *("changed" if i in gone else x for i, x in enumerate(w)), "after"])))
                want[len(docs) - 1] = [n] if k <= free else []
    assert found(spark, spark.createDataFrame(docs, "doc_id long, text string"), items) == want
