"""Tables are read whole, and what the driver's tables do not hold is tested on small fixtures."""

from pyspark.sql import functions as F

from textloom import plans
from textloom.functions import text as T
from textloom.operators.signals import Limits, detect, hazard
from textloom.sources.tables import blocks


def test_every_row_has_a_block(spark, duck, sf_dir):
    got = {r["kind"]: r["n"] for r in blocks(spark, sf_dir).groupBy(F.regexp_extract("block_id", "^[a-z]+", 0).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {"doc": "count(*) FROM documents", "page": "count(*) FROM pages", "log": "count(DISTINCT user_id) FROM events", "json": "count(DISTINCT o_custkey) FROM orders", "search": "count(*) FROM documents WHERE text <> ''"}
    assert got == {k: duck.execute(f"SELECT {v}").fetchone()[0] for k, v in want.items()}


def test_hazards_of_contents(spark):
    deep = lambda n: "[" * n + '"]["' + "]" * n
    m = Limits()
    b = spark.createDataFrame([(0, deep(m.max_depth)), (1, deep(m.max_depth + 1)), (2, "a\n" * m.max_lines), (3, "x" * (m.max_line + 1)), (4, "x\n" * (m.max_bytes // 2 + 1)), (5, None)], "id int, c string")
    assert [r[0] for r in b.orderBy("id").select(hazard(F.col("c"))).collect()] == [None, "too_deep", "too_many_lines", "line_too_long", "too_large", None]


def test_json_to_its_end(spark):
    good = ['{"a":1}', "[1,2]", ' {"a":{"b":[]}}\n', '{"a":1,"a":2}', '["a\\"]["]', "{}", "[1.0e5, -2, null, true]"]
    bad = ['{"a":1} and {oops}', "[1]] [[2]", "{}} {{}", "[1],[2]", "{'a':1}", '{"a":01}', "[1,]", "[NaN]", '["a\tb"]', "12", '"x"', "", "[1"]
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "c string, want boolean")
    assert [r["c"] for r in rows.where(T.is_json(F.col("c")) != F.col("want")).collect()] == []


def test_detection_of_short_texts(spark):
    texts = {
        "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b": ("diff", 1.0), "diff --git a b\n-x": ("diff", 0.85), "@@ -1 +1 @@\r\n+b\r\n": ("diff", 0.8), "a/b.py:1:x\nc.py:2:y": ("search", 0.9),
        "[2024-01-02 x\n2024-01-03 y": ("log", 0.95), "ERROR a\nx WARN\nINFO": ("log", 0.8), "\n \n": ("unknown", 1.0), "hello": ("prose", 0.4), "{1}": ("prose", 0.4), "-\r\n+\r\n@@": ("prose", 0.4),
    }
    got = detect(spark.createDataFrame([(t,) for t in texts], "content string")).collect()
    assert {r["content"]: (r["content_type"], r["confidence"]) for r in got} == texts
    assert detect(spark.createDataFrame([(None,)], "content string")).first()["content_type"] == "unknown"


def test_structure_hash_of_every_block(spark, sf_dir):
    shapes = plans.queries()["structure_hash"](spark, sf_dir)
    assert shapes.where("shape IS NOT NULL").count() == blocks(spark, sf_dir).count()
