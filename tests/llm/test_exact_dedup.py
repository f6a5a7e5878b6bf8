import hashlib
from collections import Counter

from tests.compare import same
from textloom.llm import exact_dedup as X
from textloom.llm.shared import work_dir


def plain(rows):
    """What stays, by plain Python: (id, keep_id, size, sha) of every row."""
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    least = lambda i: (i is not None, i or 0)
    return Counter((i, max(by[t or ""], key=least), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def told(out):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out.collect())


def test_matches_sql(spark, duck, sf_dir):
    same(X.op12_exact_dedup(spark, sf_dir), duck.execute(X.ORACLES["op12_exact_dedup"]).fetchdf())


def test_edges_and_collisions(spark, edge_docs, edge_rows, no_docs):
    at = work_dir(spark)
    edge_docs.write.parquet(at)
    want = plain([r[:2] for r in edge_rows])
    for digits in (64, 2, 0):  # with no digit at all, every row is a hit of one digest
        out = X.exact_dedup(spark, at, digits=digits).cache()
        assert told(out) == want
        assert out.where("kept").count() == len({r[1] or "" for r in edge_rows})  # one of each text, repeated ids too
        assert out.where("kept AND NOT doc_id <=> keep_id").count() == 0
    none = work_dir(spark)
    no_docs.write.parquet(none)
    assert X.exact_dedup(spark, none).count() == 0


def test_state_goes_on_over_batches_and_runs(spark):
    at, folder = work_dir(spark), work_dir(spark)
    first = [(i, f"text {i % 7}") for i in range(40)]
    spark.createDataFrame(first, "doc_id long, text string").repartition(5).write.parquet(at)
    out = X.exact_dedup(spark, at, folder=folder, files_per_batch=1)
    assert told(out) == plain(first)
    later = [(100, "text 3"), (-5, "text 4"), (101, "new"), (102, "x" * 300_000), (103, "x" * 300_000)]
    spark.createDataFrame(later, "doc_id long, text string").coalesce(1).write.mode("append").parquet(at)
    assert told(X.exact_dedup(spark, at, folder=folder)) == plain(first + later)


def test_bytes_are_compared_on_hits(spark):
    """A digest that two texts share is reported; one that copies share is not."""
    at = work_dir(spark)
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string").write.parquet(at)
    docs = spark.read.parquet(at)
    stream = spark.readStream.schema(docs.schema).parquet(at)
    whole = X.observed(stream, work_dir(spark))
    assert X.unequal(docs, whole).count() == 0
    short = X.observed(spark.readStream.schema(docs.schema).parquet(at), work_dir(spark), digits=0)
    assert X.unequal(docs, short, digits=0).count() == 1


def test_no_python_in_the_plan(spark, sf_dir):
    plan = X.op12_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_the_plan_does_not_grow_with_the_hits(spark, monkeypatch):
    """What tells hits from the rest is a table of the plan, not a text in it: the driver keeps every plan's description."""
    monkeypatch.setattr(X, "SLOTS_LEAST", X.SLOTS_MOST)
    at = work_dir(spark)
    spark.createDataFrame([(i, f"text {i % 300}") for i in range(1000)], "doc_id long, text string").write.parquet(at)
    docs = spark.read.parquet(at)
    clash = X.unequal(docs, X.observed(spark.readStream.schema(docs.schema).parquet(at), work_dir(spark)))
    assert len(clash._jdf.queryExecution().toString()) < 100_000 and clash.count() == 0
