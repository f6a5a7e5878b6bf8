from textloom.llm import url_filters as U

from tests.compare import same

URLS = [
    ("http://a.example.net/en/1", "example.net", "allow"), ("http://x.net/en/", "net/", "block"), ("HTTP://EXAMPLE.NET/EN/1", "net/", "block"), ("http://net/", "net/", "block"), ("http://a.net", None, "allow"),
    ("http://example.com/de/x", "example.com/de/", "block"), ("http://sub.example.com/de", None, "allow"), ("http://notexample.com/de/", None, "allow"), ("http://b.org/fr/?x=/fr/", "org/fr/", "allow"), ("http://b.org?x=/fr/", None, "allow"),
    (None, None, "allow"), ("", None, "allow"), ("no scheme net/", None, "allow"), ("http://cheap-pills.example.com/en/1", None, "block"), ("x://y://z.net/", None, "allow"), ("http://a.net:80/", None, "allow"), ("http://my-net/", None, "allow"),
]


def rows(spark):
    return spark.createDataFrame([(i, u, "x", 1) for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, host string, rule int")


def test_cases_and_join_path(spark):
    got = {r["page_id"]: r for r in U.judge_urls(rows(spark)).collect()}
    for i, (u, rule, verdict) in enumerate(URLS):
        assert got[i]["verdict"] == verdict, u
        assert (got[i]["rule"] is None) == (rule is None), u
    same(U.judge_urls(rows(spark)), U.judge_urls(rows(spark), inline_rules=0).toPandas())
    assert got[0]["rule"] == "example.net/en/" and got[2]["host"] == "example.net" and got[2]["path"] == "/EN/1" and got[12]["host"] == ""


def test_empty_and_repeated(spark):
    r = rows(spark)
    assert U.judge_urls(r.where("1 = 0")).count() == 0
    assert U.judge_urls(r.union(r)).count() == 2 * len(URLS)
    assert U.judge_urls(r, (), ()).where("verdict <> 'allow'").count() == 0


def test_rarest_token():
    idx = U.index_rules([U.Rule("a", "block", "net", "/"), U.Rule("b", "block", "example.net", "/en/")])
    assert idx == {"net": [0], "example": [1]}


def test_query(spark, duck, sf_dir):
    same(U.op3_url_filters(spark, sf_dir), duck.execute(U.ORACLES["op3_url_filters"]).fetchdf())
