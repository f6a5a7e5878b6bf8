"""Digests of diffs and of record sets: what is grouped is dealt once, and comes out the same the longer way."""

from pyspark.sql import functions as F

from tests.compare import rows
from textloom.operators import diffs as D


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_diff_is_dealt_by_its_document_once(spark, sf_dir):
    assert exchanges(D.diff_digest(D.order_diffs(spark, sf_dir))) == 1


def test_a_diff_without_a_hunk_and_one_of_several(spark):
    text = ["plain", "-a", "x1", "x2", "x3", "x4", "+b", "--- a/x", "+++ b/x", "@@ -1 +1 @@", "-a  b", "+ab", "y", "--- a/z/Cargo.lock", "+++ b/z/Cargo.lock", "@@ -1 +1 @@", "-q", "tail", "@@ -2 +2 @@", "-q"]
    text += ["--- a/w", "+++ b/w", "@@ -1 +1 @@", "+c", "d", "e", "f", "g"]
    ln = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "only"), (3, 0, "@@"), (3, 1, "+x")], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: r["digest"] for r in D.diff_digest(ln).collect()}
    want = "plain\n-a\nx1\nx2\nx3\nx4\n+b\n--- a/x\n+++ b/x\n... 4 lines of whitespace-only changes elided ...\n--- a/z/Cargo.lock\n+++ b/z/Cargo.lock\n"
    want += "... 3 lines of lockfile churn elided ...\n... 2 lines of lockfile churn elided ...\n--- a/w\n+++ b/w\n@@ -1 +1 @@\n+c\nd\ne\n... 2 unchanged lines ..."
    assert got == {1: want, 2: "... 1 unchanged lines ...", 3: None}


def _sets(spark):
    """A set whose fields come and go, one with a score, one of equal records, one record, and one with an outlier."""
    import json

    own = {"a": [{"id": i, "v": i % 3, **({"error": "x"} if i == 7 else {}), "n": 10_000 if i == 5 else i} for i in range(12)], "b": [{"score": (i * 7 % 10) / 10, "name": f"n{i}", "k": 1} for i in range(20)]}
    own |= {"c": [{"k": 1, "t": None}] * 6, "d": [{"x": 1}, {"y": "z" * 400}], "e": [{"q": i, "s": "u"} for i in range(9)] + [{"q": "long" * 90, "s": "w"}], "f": [{"k": 1}]}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in own.items()], "block_id string, content string")


def test_records_come_out_the_same_the_longer_way(spark):
    from textloom.operators import records as R
    from textloom.operators.jsonsets import records_of
    from textloom.sources.io import settle

    r = settle(records_of(_sets(spark)), "records")
    asked = spark.createDataFrame([("a", "v 2 id 11"), ("e", "u 6")], "doc_id string, query string")
    for queries in (None, asked):
        want = rows(R.record_digest(r, queries, big=3).toPandas())
        assert rows(R.record_digest(r, queries).toPandas()) == want and len(want[1]) == 5
    j = R.judged(r)
    assert rows(j.where("shown").select("doc_id", "rec_idx").toPandas()) == rows(R.anchors(r).toPandas())
    assert rows(j.where("reasons <> ''").select("doc_id", "rec_idx", "weight", "reasons").toPandas()) == rows(R.outliers(r).toPandas())


def test_records_are_dealt_by_their_set_once(spark):
    from textloom.operators import records as R
    from textloom.operators.jsonsets import records_of
    from textloom.sources.io import settle

    r = settle(records_of(_sets(spark)), "records")
    assert exchanges(R.record_digest(r)) == 1 and exchanges(R.plan(r)) == 1


def test_batches_of_records_are_small(spark, monkeypatch):
    from textloom.operators import jsonsets as J

    text = "[" + ",".join(f'{{"a":{i},"b":"{i}"}}' for i in range(300)) + "]"
    sizes = []

    class Df:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", None]), pa.array([text, text, text])], ["doc_id", "content"])
            sizes.extend(b.num_rows for b in run(iter([batch])))

    monkeypatch.setattr(J, "ROWS_A_BATCH", 100)
    J.records_of(Df())
    assert max(sizes) == 100 and sum(sizes) == 1800


def test_parity_writes_contents_once(spark, monkeypatch):
    from textloom.plans import reports

    seen = []
    monkeypatch.setattr(reports, "settle", lambda df, name="table", own=reports.settle: seen.append(set(df.columns)) or own(df, name))
    f = spark.createDataFrame([("a", "log", "log_digest", "2024-01-01 00:00:00 x\n" * 60, None)], "block_id string, content_type string, transform string, content string, skipped string")
    assert [(r["content_type"], r["outcome"]) for r in reports.parity(f).collect()] == [("log", "covered")]
    assert sum("content" in c for c in seen) == 1 and not any("digest" in c for c in seen)


def test_search_hits_of_repeated_ids_are_one_block(spark, tmp_path):
    from textloom.sources.tables import in_order, search_lines, search_texts

    spark.createDataFrame([(1, "de", "a", "x: y\r\nz\n"), (1, None, None, "b"), (2, "fr", "s", None), (3, "fr", "s", ""), (4, "fr", "s", "1\r2\n\n3")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = search_lines(spark, str(tmp_path)).groupBy("doc_id").agg(in_order(F.col("line"), F.col("line_no")).alias("content"))
    assert rows(search_texts(spark, str(tmp_path)).toPandas()) == rows(want.toPandas())


def test_lines_are_scored_without_their_texts_being_read_again(spark):
    """what is counted is counted from written hits; a query may lie in the rows of its lines."""
    from textloom.operators.relevance import relevant_lines

    at = ["plain", "disk error", "error error disk", "", "nothing here", "x", "y"]
    rows_of = [("a", i, t) for i, t in enumerate(at)] + [("b", i, f"{t} tail") for i, t in enumerate(at)] + [("b", 1, "disk"), (None, 0, "disk error")]
    ln = spark.createDataFrame(rows_of, "block_id string, line_no int, line string")
    queries = spark.createDataFrame([("a", "disk ERROR"), ("b", "error, error")], "block_id string, query string")
    want = [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    by_join = relevant_lines(ln, queries)
    assert "split(" not in by_join._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, by_join.collect())) == want
    own = ln.withColumn("query", F.when(F.col("block_id") == "a", "disk ERROR").otherwise("error, error"))
    assert sorted(map(tuple, relevant_lines(own).collect())) == want


def test_a_content_is_made_and_cut_once_for_its_lines(spark, sf_dir, tmp_path):
    from textloom.sources.tables import block_lines, search_texts

    d = [(1, "a:b\r\nc", "en", None), (1, "x", None, "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "\n", "en", "s"), (5, "a\rb\n\nq\n", "en", "s")]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = search_texts(spark, str(tmp_path))
    got = {r["doc_id"]: r["content"] for r in texts.collect()}
    both = "src/en/none/0.txt:1:a b\nsrc/none/s/0.txt:1:x\nsrc/en/none/0.txt:2:c"
    assert got == {1: both, 4: "src/en/s/0.txt:1:", 5: "src/en/s/0.txt:1:a b\nsrc/en/s/0.txt:2:\nsrc/en/s/0.txt:3:q"}
    ln = block_lines(texts.withColumnRenamed("doc_id", "block_id"))
    plan = ln._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 2 and plan.count("split(") == 3, plan  # of the hits and of ids together; each text and content once
    assert ln.count() == 7


def test_the_sources_of_one_file_are_dealt_to_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """tasks follow the number of parts, not that of row groups."""
    from textloom.operators import code

    spark.range(900).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = rows(code.q_code_digest(spark, str(tmp_path)).toPandas())
    monkeypatch.setattr(code, "PARTS_A_TASK", 100)
    dealt = code.q_code_digest(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 9 and max(len(p) for p in dealt.rdd.glom().collect()) < 200
    assert rows(dealt.toPandas()) == whole
    below = dealt._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "repeat(" not in below, below
