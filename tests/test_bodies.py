"""JSON bodies, content store, SQL functions and streaming state."""

from pyspark.sql import functions as F

from textloom.functions import sql
from textloom.functions import text as T
from textloom.operators import bodies as B
from textloom.operators import relevance
from textloom.sources import io


def test_structure_hash_literals():
    assert B.structure_hash('{"a":1,"b":[2,3]}', "json") == "b937411607289da4"
    assert B.structure_hash("not json", "log") == "125073191daf5431"
    assert B.structure_hash('{"b":[9],"a":0}', "json") == B.structure_hash('{"a":1,"b":[2,3]}', "json")


def test_members_and_edits():
    body = '{"model" : "m", "messages":[{"a": 1.0}], "n":12345678901234567890}'
    assert B.members(body) == [("model", '"m"'), ("messages", '[{"a": 1.0}]'), ("n", "12345678901234567890")]
    assert B.members("[1]") is None and B.members('{"a":1} x') is None and B.members('{"a":}') is None and B.members("") is None and B.members("{}") == []
    assert B.set_member(body, "k", '"v"', replace=False) == '{"k":"v",' + body[1:]
    assert B.set_member(body, "model", '"v"', replace=False) == body
    assert B.set_member(body, "model", '"v"', replace=True) == body.replace('"m"', '"v"')
    assert B.set_member("{}", "k", "1", replace=False) == '{"k":1}' and B.set_member("no", "k", "1", replace=False) == "no"


def test_sort_keys_keeps_literals():
    assert B.sort_keys('{"b":1.0,"a":[{"d":12345678901234567890,"c":"é"}]}') == '{"a":[{"c":"é","d":12345678901234567890}],"b":1.0}'
    assert B.sort_keys("no json") == "no json"


def test_minify(spark):
    df = spark.createDataFrame([('{"a" : [1 , 2], "b": "x , y"}',), ("not : json ,",)], "t string")
    assert [r[0] for r in df.select(B.minify_json(F.col("t"))).collect()] == ['{"a":[1,2],"b":"x , y"}', "not : json ,"]


def test_content_store(spark, tmp_path):
    store = io.ContentStore(spark, str(tmp_path / "ccr"))
    t0 = F.lit("2026-01-01 00:00:00").cast("timestamp")
    out = store.put(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "content string"), at=t0)
    store.put(spark.createDataFrame([("b",)], "content string"), at=t0 + F.expr("INTERVAL 12 HOURS"))
    names = [r["marker"] for r in out.where("content = 'a'").collect()]
    assert len(set(names)) == 1
    h = names[0][6:38]
    assert store.get([h], t0).count() == 1 and store.get([h], t0 + F.expr("INTERVAL 25 HOURS")).count() == 0
    assert store.purge(t0 + F.expr("INTERVAL 25 HOURS"), str(tmp_path / "live")) == 1


def test_merge_is_commutative(spark):
    a = spark.createDataFrame([("x", 1, 2)], "k string, n long, t long")
    b = spark.createDataFrame([("x", 3, 4), ("y", 5, 6)], "k string, n long, t long")
    want = {("x", 4, 6), ("y", 5, 6)}
    assert {tuple(r) for r in io.merge_ledgers(a, b, ["k"]).collect()} == want == {tuple(r) for r in io.merge_ledgers(b, a, ["k"]).collect()}


def test_metrics_and_jsonl(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP a b\na_total 3\nb{x="1"} 4\nc 1.5\n')
    assert {tuple(r) for r in io.read_metrics(spark, str(tmp_path / "m.txt")).collect()} == {("a_total", 3.0), ("c", 1.5)}
    (tmp_path / "m.jsonl").write_text('{"content":"x","source":"a"}\nbad\n{"content":"y","sensitive":true}\n{"source":"b"}\n')
    got = B.memories_from_jsonl(io.read_jsonl_lines(spark, str(tmp_path / "m.jsonl"))).collect()
    assert [(r["content"], r["source"], r["context"]) for r in got] == [("x", "a", "unknown")]


def test_sql_functions(spark):
    assert "condense_marker" in sql.register(spark)
    r = spark.sql("SELECT condense_marker('x') AS m, condense_ratio(10, 4) AS r, condense_saved(3, 9) AS s").first()
    df = spark.createDataFrame([("x",)], "t string").select(T.marker(F.col("t")).alias("m")).first()
    assert (r["m"], r["r"], r["s"]) == (df["m"], 0.6, 0)


def test_bm25_empty_and_repeated_terms(spark):
    items = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "")], "item_id long, text string")
    q = spark.createDataFrame([(9, "red fox fox"), (8, "")], "query_id long, text string")
    top = relevance.top_k(relevance.bm25(items, q), 1, 0.0).collect()
    assert [(r["query_id"], r["item_id"]) for r in top] == [(9, 1)]
    assert relevance.bm25(items.where("1 = 0"), q).count() == 0
