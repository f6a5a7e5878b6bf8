"""SQL functions over single blocks against the column form."""

import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textloom.operators.signals import detect, route
from textloom.plans import table_functions as X

PIECES = ("2024-01-02 10:00:00 INFO a", "ERROR b failed", "src/a.py:12:def f(x):", "@@ -1 +1 @@", "--- a/x", "+++ b/x", "diff --git a b", "-old", "+new", "def f(a): return [x];", "import os", "    if (a) { return 1; }", "plain words here.", "", "  ", "é ü", '{"a": 1}', "[1, 2]", "from x import y")


def texts():
    rng = random.Random(4)
    out = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(300)]
    out += [json.dumps({"a": [1, {"b": "x\\y"}]}), "[1,]", "[NaN]", '{"a":1} x', "[1] [2]", '["a\tb"]', "[" * 2000 + "]" * 2000, "{}", "[]", "　 ", "\r\n".join(["a.py:1:x"] * 3), "[01]", '{"a":"' + "x" * 50_000 + '"}', None]
    return out


def test_blocks_are_what_the_column_form_says(spark):
    X.register(spark)
    df = spark.createDataFrame([(i, t, ["text", "tool_result"][i % 2], ["payg", "oauth", "subscription", "nobody", None][i % 5]) for i, t in enumerate(texts())], "i int, content string, kind string, mode string")
    df.createOrReplaceTempView("some_blocks")
    got = spark.sql("SELECT i, condense_detect(content) AS detected, f.* FROM some_blocks, LATERAL condense_block(content, kind, mode) f")
    want = {r["i"]: r for r in route(df).collect()}
    scores = {r["i"]: r["confidence"] for r in detect(df).collect()}
    for r in got.collect():
        w = want[r["i"]]
        assert (r["detected"], r["content_type"], r["transform"], r["reason"]) == (w["content_type"], w["content_type"], w["transform"], w["reason"]), w
        assert r["confidence"] == scores[r["i"]]
    assert got.count() == len(want)


def test_partitions_of_a_table(spark):
    X.register(spark)
    rows = [(k, "x " * n, "tool_result", a) for k in ("p", "q") for n in (10, 4000) for a in ("payg", "oauth")] + [("q", None, None, None)]
    spark.createDataFrame(rows, "k string, content string, kind string, auth string").createOrReplaceTempView("some_blocks")
    got = {tuple(r) for r in spark.sql("SELECT * FROM condense_budget(TABLE(some_blocks) PARTITION BY k)").collect()}
    each = {("below_size", 1, 20, 20), ("compress", 1, 8000, 8000), ("lossless", 2, 8020, 8000)}
    assert got == {(k, *r) for k in ("p", "q") for r in each} | {("q", "policy_forbids", 1, 0, 0)}


@pytest.mark.parametrize(("query", "says"), [
    ("SELECT * FROM condense_block('a', 'text', 'nobody')", "auth is to be one of"), ("SELECT * FROM condense_block(1, 'text', 'payg')", "content is to be a string"),
    ("SELECT * FROM condense_budget(TABLE(SELECT 1 AS content))", "no column kind, auth"), ("SELECT * FROM condense_budget('a')", "takes a table"),
])
def test_wrong_arguments_are_errors_of_the_query(spark, query, says):
    X.register(spark)
    with pytest.raises(AnalysisException, match=says):
        spark.sql(query).schema  # noqa: B018


def test_nothing_in_the_plan_runs_python_for_sql_functions(spark):
    X.register(spark)
    plan = spark.range(1).select(F.expr("condense_detect(cast(id AS string))"), F.expr("condense_tokens(cast(id AS string))"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_a_block_under_three_kinds_of_authentication_is_looked_at_once(monkeypatch):
    seen, looked_at = [], X.what
    monkeypatch.setattr(X, "what", lambda content: seen.append(content) or looked_at(content))
    X._looked_at.cache_clear()
    rows = [X.block_row(t, "text", auth) for t in ("a line", None, "a line") for auth in ("payg", "oauth", "subscription")]
    assert seen == ["a line", None, "a line"] and [r[-1] for r in rows[:3]] == ["no_compressor", "lossless", "policy_forbids"]


def test_patterns_are_not_run_over_texts_that_cannot_hold_them(monkeypatch):
    class Never:
        def finditer(self, t):
            raise AssertionError

        search = finditer

    monkeypatch.setattr(X, "_COUNTED", X._COUNTED | {k: Never() for k in ("hits", "stamps", "levels")})
    monkeypatch.setattr(X, "_LOOKED_FOR", {k: Never() for k in X._LOOKED_FOR})
    assert X.what("words of prose and no more\n" * 9) == X.PROSE
