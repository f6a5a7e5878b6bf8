"""The kept index against BM25 over the texts themselves, and what it does not read."""

import random

from pyspark.sql import functions as F

from textloom.operators.relevance import bm25, top_k
from textloom.operators.search_index import SearchIndex
from textloom.sources.io import new_folder

WORDS = [f"w{i}" for i in range(400)]


def items(n, seed):
    rng = random.Random(seed)
    pick = lambda: WORDS[min(399, int(rng.paretovariate(0.7)) - 1)]
    return [(seed * 100_000 + i, " ".join(pick() for _ in range(rng.choice((5, 9, 30, 200))))) for i in range(n)]


def told(df):
    return {(r["query_id"], r["rank"]): (r["item_id"], round(r["score"], 6)) for r in df.collect()}


def test_equals_search_over_texts_and_reads_less(spark):
    rows = items(1_500, 1) + items(1_500, 2)
    df = spark.createDataFrame([*rows, (7, None), (8, ""), (9, "W3, w399!")], "item_id long, text string")
    index = SearchIndex(spark, new_folder(spark, "index"), segment_items=100)
    assert index.add(df.where("item_id < 200000")) == 0 and index.add(df.where("item_id >= 200000")) == 1
    asked = spark.createDataFrame([(1, "w390 w3 w398"), (2, "w0 w1"), (3, "w250 w250 w120"), (4, "none of these"), (5, ""), (6, "w7")], "query_id long, text string")
    for k in (1, 10):
        want = told(top_k(bm25(df, asked), k))
        assert told(index.search(asked, k)) == want and {q for q, _ in want} >= {1, 3, 6}
    turns = {r["turn"]: r["n"] for r in index.plan(asked, 3)[2].groupBy("turn").agg(F.sum("postings").alias("n")).collect()}
    assert turns[3] > sum(turns.values()) / 4  # a good part of the postings is never read


def test_an_add_counts_once(spark):
    index = SearchIndex(spark, new_folder(spark, "index"))
    asked = spark.createDataFrame([(1, "apple")], "query_id long, text string")
    assert index.search(asked).count() == 0
    first = spark.createDataFrame([(1, "apple pie"), (2, "pear pie")], "item_id long, text string")
    index.add(first, 0)
    before = told(index.search(asked))
    index.add(first, 0)
    assert told(index.search(asked)) == before and index.totals() == (2.0, 2.0)


def test_an_add_writes_no_texts_and_scores_lie_by_segment(spark, monkeypatch):
    from textloom.operators import search_index as S

    seen = []
    monkeypatch.setattr(S, "settle", lambda df, name="table", own=S.settle: seen.append(set(df.columns)) or own(df, name))
    index = SearchIndex(spark, new_folder(spark, "index"), segment_items=100)
    index.add(spark.createDataFrame(items(700, 1), "item_id long, text string"))
    assert not any({"t", "text"} & c for c in seen)
    sizes = spark.read.parquet(f"{index.path}/segments").agg(F.sum("items").alias("n"), F.max("items").alias("most"), F.count(F.lit(1)).alias("k")).first()
    assert sizes["n"] == 700 and sizes["most"] <= 300 and sizes["k"] >= 5
    q, pairs = index.bounds(spark.createDataFrame([(1, "w390 w3 w398")], "query_id long, text string"))
    assert "hashpartitioning(query_id" not in index._scored(q, pairs)._jdf.queryExecution().executedPlan().toString()
