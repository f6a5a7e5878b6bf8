"""What the driver's tables don't hold: hand cases, round trips and edge rows of the core operators."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import sql
from textloom.functions import text as T
from textloom.operators import bodies, code, jsonsets, relevance, shaping
from textloom.operators.signals import Limits, route
from textloom.plans import registry, reports
from textloom.plans.requests import condense_requests
from textloom.sources import io
from textloom.sources.tables import blocks
from textloom.streaming import sse

LOG = "\n".join(f"2026-01-02 03:04:{i % 60:02d} {'ERROR' if i % 9 == 0 else 'INFO'} worker {i} done in {i}ms" for i in range(60))
HITS = "\n".join(f"src/a{i % 4}.py:{i + 1}: value = {i}" for i in range(40))
SETS = json.dumps([{"id": i, "level": "info", "kind": "order", "ms": 5000 if i == 17 else 10 + i % 3} for i in range(60)])
DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,30 +1,30 @@\n" + "\n".join(f" same line number {i}" for i in range(60)) + "\n-old\n+new\n" + "\n".join(f" more of the same {i}" for i in range(30))
CODE = "import os\n\n" + "\n\n".join(f"def job_{i}(self):\n" + "\n".join(f"    value_{k} = self.step({k}, [{i}])" for k in range(12)) for i in range(8))
PROSE = "\n".join(f"This is sentence number {i} of a rather long report about nothing in particular, and so it goes on." for i in range(90))
LEAVES = json.dumps({"title": "report", "pages": [PROSE, 1.5], "n": 12345678901234567890}).replace("1.5]", "1.50]")
CONTENTS = {"log": LOG, "search": HITS, "json": SETS, "diff": DIFF, "code": CODE, "prose": PROSE}


def request(content, **more):
    msgs = [{"role": "user", "content": "which worker had the error in job_3"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "run", "input": {"q": "17"}}]}]
    return json.dumps({"model": "claude-opus-4", "messages": [*msgs, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": content}]}], **more}, ensure_ascii=False)


def test_every_marker_resolves(spark):
    """All six content types and long leaves shrink, and what their markers name is the original."""
    rows = [(i, request(c), "payg") for i, c in enumerate([*CONTENTS.values(), LEAVES])]
    out = condense_requests(spark.createDataFrame(rows, "request_id long, body string, mode string"))
    originals = {r["hash"]: r["content"] for r in out.originals.collect()}
    got = {r["request_id"]: r["body"] for r in out.bodies.collect()}
    seen = {r["request_id"]: (r["content_type"], r["outcome"]) for r in out.outcomes.collect()}
    assert seen == {**{i: (k, "compressed") for i, k in enumerate(CONTENTS)}, 6: ("json", "compressed")}
    for i, content in enumerate([*CONTENTS.values(), LEAVES]):
        text = json.loads(got[i])["messages"][2]["content"][0]["content"]
        names = [m[6:38] for m in text.split() if m.startswith("<<ccr:")] or [text[text.index("<<ccr:") + 6 :][:32]]
        assert len(text) < len(content) and all(n in originals for n in names)
        assert originals[names[-1]] == (PROSE if i == 6 else content)
    assert "17:" in json.loads(got[2])["messages"][2]["content"][0]["content"]  # the outlier, and what the query asks for
    assert json.loads(json.loads(got[6])["messages"][2]["content"][0]["content"], parse_float=str)["pages"][1] == "1.50"


def test_modes_limits_and_broken_bodies(spark):
    rows = [(0, request(LOG), "subscription"), (1, request('{"a" :   [1 , 2],   "b" : "c"}'), "oauth"), (2, "no json", "payg"), (3, None, "payg"), (4, '{"messages":[]}', "payg"), (5, request("x" * 900), "payg"), (6, request(LOG), "payg"), (7, request(""), None)]
    df = spark.createDataFrame(rows, "request_id long, body string, mode string")
    out = condense_requests(df, limits=Limits(max_bytes=800), recommended=spark.createDataFrame([("log", False)], "content_type string, worth boolean"))
    got = {r["request_id"]: r["body"] for r in out.bodies.collect()}
    assert {i: b for i, b in got.items() if i != 1} == {i: b for i, b, _ in rows if i != 1}
    assert json.loads(got[1])["messages"][2]["content"][0]["content"] == '{"a":[1,2],"b":"c"}'
    reasons = {r["request_id"]: r["reason"] for r in out.outcomes.collect()}
    assert (reasons[0], reasons[1], reasons[5], reasons[6]) == ("unsafe", "lossless", "unsafe", "unsafe")
    b = spark.createDataFrame([("a", LOG, "tool_result", "payg"), ("b", LOG, "tool_result", None), ("c", PROSE, "text", "payg"), ("d", None, "text", "payg")], "block_id string, content string, kind string, mode string")
    advice = spark.createDataFrame([("log", False)], "content_type string, worth boolean")
    assert {r["block_id"]: r["reason"] for r in route(b, advice).collect()} == {"a": "measured_useless", "b": "policy_forbids", "c": "no_compressor", "d": "no_compressor"}


def test_responses_and_chat_bodies(spark):
    chat = json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": LOG}]})
    resp = json.dumps({"model": "gpt-5", "input": [{"type": "message", "role": "user", "content": [{"type": "text", "text": "q"}]}, {"type": "function_call_output", "call_id": "c", "output": LOG}]})
    for dialect, body, path in (("chat", chat, lambda b: b["messages"][1]["content"]), ("responses", resp, lambda b: b["input"][1]["output"])):
        out = condense_requests(spark.createDataFrame([(1, body, "payg")], "request_id long, body string, mode string"), dialect)
        assert "<<ccr:" in path(json.loads(out.bodies.first()["body"]))


def test_insert_member(spark):
    cases = {'{"a":1}': '{"k":1,"a":1}', " { }": ' {"k":1 }', '{"k":2}': '{"k":2}', "[1]": "[1]", "no": "no", None: None}
    df = spark.createDataFrame([(c,) for c in cases], "b string")
    assert {r["b"]: r["x"] for r in df.select("b", bodies.insert_member(F.col("b"), "k", F.lit("1")).alias("x")).collect()} == cases


def test_braces():
    rows = "class A;\nvoid f() {\n  a {\n  }\n  b;\n  c;\n}\nint x;\nvoid g()\n{\n1;\n2;\n3;\n4;\n}".split("\n")
    b = code.Braces(rows)
    assert [b.end(i) for i in (1, 2, 8)] == [7, 4, 15] and code.Braces(["f {", "x"]).end(0) is None and code.Braces(["f", "x"]).end(0) is None
    for seed in range(300):
        import random

        rng = random.Random(seed)
        rows = ["".join(rng.choice("{}ab ") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 25))]
        b = code.Braces(rows)
        for i in range(len(rows)):
            depth, seen, want = 0, False, None
            for k in range(i, len(rows)):
                depth += rows[k].count("{") - rows[k].count("}")
                seen |= "{" in rows[k]
                if seen and depth <= 0:
                    want = k + 1
                    break
            assert b.end(i) == want, (rows, i)


def test_code_digests():
    src = "import x\ndef f():\n" + "    y = 1\n" * 6 + "z = 2"
    assert code.elide_bodies(src, "python") == "[9 lines, python — bodies elided]\nimport x\ndef f():\n    ... 6 lines ...\nz = 2"
    assert code.elide_bodies("def f():\n    return 1", "python") is None and code.elide_bodies("", "go") is None
    go = "package a\nfunc f() {\n\t1\n\t2\n\t3\n\t4\n}\n"
    # a package clause counts as a definition, so that the first function goes with its signature
    assert code.elide_bodies(go, "go") == "[7 lines, go — bodies elided]\npackage a\n    ... 5 lines ...\n}"
    assert code.elide_bodies(go.removeprefix("package a\n"), "go") == "[6 lines, go — bodies elided]\nfunc f() {\n    ... 4 lines ...\n}"


def test_json_patterns_and_records(spark):
    assert jsonsets.pattern('[{"a":"xx"},{"a":"yy"}]')[:2] == ("record_set", 2) and jsonsets.pattern('[{"a":"x"},{"a":"yy"}]')[0] == "unremarkable"
    assert jsonsets.pattern("null")[0] == "unremarkable" and jsonsets.pattern("no") is None and jsonsets.pattern(None) is None
    b = spark.createDataFrame([("a", '[{"n":1.0,"t":"é"},{"n":12345678901234567890,"u":[1,{"x":null}]}]'), ("b", "[1,2]"), ("c", "no"), ("d", None), ("e", '[{"n":1}]')], "block_id string, content string")
    got = sorted(tuple(r)[:5] for r in jsonsets.records_of(b).collect())
    assert got == [("a", 0, 0, "n", "1.0"), ("a", 0, 1, "t", '"é"'), ("a", 1, 0, "n", "12345678901234567890"), ("a", 1, 1, "u", '[1,{"x":null}]')]
    assert jsonsets.replace_leaves('{"a":"x","b":["y",1.0]}', {1: "z"}) == '{"a":"x","b":["z",1.0]}'


def test_stable_bodies():
    body = '{"tools":[{"name":"b","z":1.0,"a":2},{"name":"a"}], "messages":[{"role":"user","content":"0"} ,{"role":"user","content":"1"},{"role":"user","content":"2"},{"role":"user","content":"3"},{"role":"user","content":"4"}]}'
    want = body.replace('[{"name":"b","z":1.0,"a":2},{"name":"a"}]', '[{"name":"a"},{"a":2,"name":"b","z":1.0}]')
    assert shaping.normalize_tools(body) == want and shaping.normalize_tools(want) == want
    mark = ',"cache_control":{"type":"ephemeral"}}'
    marked = body.replace('"content":"1"}', '"content":"1"' + mark).replace('"content":"3"}', '"content":"3"' + mark)
    assert shaping.place_marks(body) == marked and shaping.place_marks(marked) == marked
    theirs = body.replace('"content":"0"}', '"content":"0"' + mark)
    assert shaping.place_marks(theirs) == theirs and shaping.place_marks("no") == "no"


def test_sql_functions_match_columns(spark, sf_dir):
    sql.register(spark)
    df = blocks(spark, sf_dir).select("content", T.estimated_tokens(F.col("content")).alias("t"))
    assert df.selectExpr("count_if(NOT condense_tokens(content) <=> t) AS n").first()["n"] == 0


def test_registry(spark):
    df = spark.createDataFrame([("claude-3", "a b c"), ("gpt-4o", "a b c"), (None, "a")], "model string, text string")
    registry.register_counter("openai", lambda c: F.length(c).cast("long"))
    registry.register_scorer("same", lambda items, queries: items.select("group_id", "item_id", F.lit(1.0).alias("score")))
    try:
        got = {r["model"]: r["n"] for r in df.select("model", registry.count_tokens(F.col("text"), F.col("model")).alias("n")).collect()}
    finally:
        registry._COUNTERS.clear()
    assert got["gpt-4o"] == 5 and got["claude-3"] != 5 and registry.scorer("same") is not registry.scorer()
    assert {t.name for t in registry.transforms()} >= {"log_digest", "record_set", "reformat"}


def test_ledgers_that_are_not_there(spark, tmp_path):
    assert io.load_ledger(spark, str(tmp_path / "none")).count() == 0 and io.load_recommendations(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"x": 1}')
    assert io.load_recommendations(spark, str(tmp_path / "bad")).count() == 0
    assert reports.ledger_report(io.load_ledger(spark, str(tmp_path / "none"))).first()["tokens_saved"] == 0


def test_parity_details(spark):
    rows = [("a", "log", "log_digest", LOG, None), ("b", "json", "log_digest", SETS, None), ("c", "prose", "prose_summary", "hello", None), ("d", "log", "log_digest", LOG, "not now")]
    f = spark.createDataFrame(rows, "block_id string, content_type string, transform string, content string, skipped string")
    got = {r["fixture"]: (r["outcome"], r["detail"]) for r in reports.parity(f).collect()}
    assert got == {"a": ("covered", None), "b": ("failed", "routed to record_set rather than log_digest"), "c": ("failed", "nothing routed to it; expected prose_summary"), "d": ("skipped", "not now")}


def test_frames_overflow_and_flush(spark):
    big = "x" * (sse.MAX_FRAME + 1)
    rows = [(1, 0, "data: a\n\ndata: "), (1, 1, big), (1, 2, "\n\ndata: b\n\n"), (2, 0, "data: c\n\ndata: d")]
    df = spark.createDataFrame(rows, "stream_id long, chunk_no int, chunk string")
    assert [(r["stream_id"], r["data"]) for r in sse.frames(df).orderBy("stream_id", "seq").collect()] == [(1, "a"), (2, "c")]
    assert [(r["stream_id"], r["data"]) for r in sse.frames(df, flush=True).orderBy("stream_id", "seq").collect()] == [(1, "a"), (2, "c"), (2, "d")]


@pytest.mark.parametrize("query", [None, "  ", "zebra"])
def test_recall_without_an_answer(spark, query):
    m = relevance.remember(spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, "c", "x")], "ord long, content string, source string"))
    assert [r["content"] for r in relevance.recall_for_query(m, query, 1).collect()] == ["a b"]
    block = relevance.memory_block(relevance.recall(m, 1), F.col("key")).first()["block"]
    assert block == "\n\n<memory>\n- a b (corroborated)\n</memory>" and relevance.memory_block(m.where("1 = 0"), F.col("key")).count() == 0


def test_long_strings_and_runs(spark):
    """Texts on which a careless pattern would run out of stack or of time."""
    from textloom.operators.condense import parse_hits, tidy
    from textloom.operators.signals import detect

    n = 400_000
    texts = ['{"a":"' + "x\\n" * n + '"}', '{"a" : "' + '\\"' * n + '"}', "a" + " " * n + "b", "/" * n, "a/b" + ":" * n, "[" * 1000 + "\\" * n, "\t" * n + "\n", "-" * n, "9" * n + ":"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {r["id"]: r for r in detect(df).collect()}
    assert [got[i]["content_type"] for i in range(3)] == ["json", "json", "prose"] and got[6]["content_type"] == "unknown"
    c = F.col("content")
    small = {r["id"]: r for r in df.select("id", F.length(bodies.minify_json(c)).alias("m"), F.length(tidy(c)).alias("t"), T.estimated_tokens(c).alias("e"), shaping.reformat(c).isNull().alias("r")).collect()}
    assert small[1]["m"] == len(texts[1]) - 2 and small[0]["m"] == len(texts[0]) and not small[1]["r"] and small[6]["t"] == 1
    assert parse_hits(df.select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.col("content").alias("line"))).count() == 0


def test_white_space_of_many_lines(spark):
    """Lines are not gone through again for each line: seconds, not minutes, for a text of many."""
    import time

    from textloom.operators.shaping import normalize_whitespace

    cases = {"a \t\r\n\r\n \n\n b": "a\n\n b\n", "\n\n": "\n", "": "", None: None, "x  ": "x\n", "a\r\rb\n": "a\r\rb\n", "z  \n" * 8000 + "\n" * 8000: "z\n" * 8000 + "\n"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    began = time.time()
    assert {r["c"]: r["n"] for r in df.select("c", normalize_whitespace(F.col("c")).alias("n")).collect()} == cases
    assert time.time() - began < 15


def test_scores_are_added_up_where_an_item_is(spark, monkeypatch):
    """A frequent term's hits go to no task of their own, and pairs of queries and items are not shuffled."""
    items = spark.createDataFrame([(i, "the " * (i % 3 + 1) + f"w{i % 5}") for i in range(40)], "item_id long, text string")
    queries = spark.createDataFrame([(q, f"the the w{q}") for q in range(4)], "query_id long, text string")
    want = {(r["query_id"], r["item_id"]): round(r["score"], 9) for r in relevance.bm25(items, queries).collect()}
    monkeypatch.setattr(relevance, "PAIRS_A_TASK", 20)
    monkeypatch.setattr(relevance, "settle", lambda df, name: df.localCheckpoint())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = relevance.bm25(items, queries)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert {(r["query_id"], r["item_id"]): round(r["score"], 9) for r in scored.collect()} == want and len(want) == 160
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(item_id" in plan


def test_ranked_lines_are_sorted_by_spark_itself(spark):
    """Without a comparing function that is called for each pair of lines."""
    from textloom.operators.condense import most_important

    b = spark.createDataFrame([(1, "plain\nerror: x\n# head\nplain\nfatal y"), (2, None)], "block_id long, content string")
    out = most_important(b, 3)
    assert sorted((r["block_id"], r["line_no"]) for r in out.collect()) == [(1, 1), (1, 2), (1, 4)]
    assert "array_sort(" not in out._jdf.queryExecution().optimizedPlan().toString()
