from textloom.plans.requests import rewrite

BODY = '{"model" : "m",  "messages": [ {"role":"user","content":"a \\u00e9"} , {"role":"user","content":[{"type":"tool_result","content":"long"},{"type":"text","text":"t"}]}], "n":1.0}'


def test_untouched_bytes_stay():
    assert rewrite(BODY, []) == BODY and rewrite("no json", [(0, 0, "x")]) == "no json" and rewrite('{"a":1}', [(0, 0, "x")]) == '{"a":1}'
    out = rewrite(BODY, [(1, 0, 'short "q"'), (1, 1, "u"), (7, 0, "z")])
    assert out == BODY.replace('"content":"long"', '"content":"short \\"q\\""').replace('"text":"t"', '"text":"u"')
    assert rewrite(BODY, [(0, 0, "b")]) == BODY.replace("a \\u00e9", "b")


def test_requests_are_worked_out_once(spark):
    """What makes the requests is not run again for their models, their calls and their bodies."""
    from pyspark.sql import functions as F

    from textloom.plans.requests import condense_requests

    body = F.concat(F.lit('{"model": "m-1", "messages": [{"role": "user", "content": "'), F.expr("uuid()"), F.lit('"}]}'))
    bodies = condense_requests(spark.range(3).select(F.col("id").alias("request_id"), body.alias("body"), F.lit("payg").alias("mode"))).bodies
    assert any("/requests-" in f for f in bodies.inputFiles())
