"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch candidates, only those are tested.

Main path: one projection without shuffle or Python. The index is a literal map from token to rules, so it serves rule
lists of at most `INLINE_RULES` rules; larger lists go through an equi-join on the token (same results).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

INLINE_RULES = 2000
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """label: name shown; verdict: allow or block; host and path: literal host suffix and path prefix, or
    pattern: a regular expression on `host + path` with at least one literal token that every match contains."""

    label: str
    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literal: str = ""

    def tokens(self) -> list[str]:
        """Whole tokens that every URL the rule fits contains."""
        if self.pattern:
            return re.findall(_TOKEN, self.literal.lower())
        # a path prefix may end inside a longer token, so only tokens closed by another character count
        return re.findall(_TOKEN, self.host.lower()) + re.findall(_TOKEN + "(?=[^a-z0-9])", self.path.lower())

    def regex(self) -> str:
        if self.pattern:
            return self.pattern
        return f"^([^/]*[.])?{re.escape(self.host)}{re.escape(self.path) if self.path else '(/|$)'}"


#: The rules of op3's contract.
HOST_RULES = (
    Rule("net/", "block", "net", "/"),
    Rule("example.net/en/", "allow", "example.net", "/en/"),
    Rule("example.com/de/", "block", "example.com", "/de/"),
    Rule("org/fr/", "allow", "org", "/fr/"),
)
#: Decide URLs that no host rule fits: link farms, pill and casino pages, tracking hosts.
PATTERN_RULES = (
    Rule("spam farm", "block", pattern=r"(^|[.])spam-farm[.]", literal="spam farm"),
    Rule("cheap pills", "block", pattern=r"(^|[.])cheap-pills[.]", literal="cheap pills"),
    Rule("casino", "block", pattern=r"(^|[./-])casino[./-]", literal="casino"),
    Rule("ads host", "block", pattern=r"(^|[.])ads[.]", literal="ads"),
    Rule("tracker", "block", pattern=r"(^|[.])tracker[.]", literal="tracker"),
)


def index_rules(rules) -> dict[str, list[int]]:
    """Rarest literal token of each rule (ties: the longer, then the smaller token) -> positions of its rules."""
    df = Counter(t for r in rules for t in set(r.tokens()))
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if not r.tokens():
            raise ValueError(f"rule {r.label!r} has no literal token")
        out.setdefault(min(r.tokens(), key=lambda t: (df[t], -len(t), t)), []).append(i)
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract cuts them; both empty for null or where there is no `://`."""
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(df: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict, pattern_rule.

    Verdict: that of the longest host rule that fits; else block if a pattern rule fits; else allow. Null or
    unparsable URLs have an empty host and path, no rule, verdict allow. Repeated rows each give a row; other columns of
    df are not looked at, so their names can't clash. Ties of equally long rules go to the rule listed first.
    """
    url = F.col("__url")
    host, path = url_parts(url)
    base = df.select(F.col(id_col), F.col(url_col).alias("__url")).select(id_col, host.alias("host"), path.alias("path"))
    rules = [*host_rules, *pattern_rules]
    index = index_rules(rules) if rules else {}
    if len(rules) > inline_rules:
        return _judge_joined(base, rules, len(host_rules), index, id_col)
    return _choose(base.withColumn("__hit", _hits(rules, index)), rules, len(host_rules), id_col)


def _key() -> Column:
    return F.concat("host", "path")


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_key()), F.lit(f"({_TOKEN})")))


def _hits(rules, index) -> Column:
    """Positions of the rules whose regular expression fits, out of those fetched by the URL's tokens.

    The index is a map literal over hash slots, so a token costs one array access, not a scan of the rule list.
    """
    if not rules:
        return F.array().cast("array<int>")
    slots = 1 << max(4, (2 * len(index)).bit_length())
    spark = SparkSession.active()
    homes = spark.createDataFrame([(t,) for t in index], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(slots)).cast("int").alias("s")).collect()
    cells: list[list[int]] = [[] for _ in range(slots)]
    for r in homes:
        cells[r["s"]].extend(index[r["t"]])
    by_slot = F.array(*[F.array(*[F.lit(i) for i in c]).cast("array<int>") for c in cells])
    cands = F.array_distinct(F.flatten(F.transform(_tokens(), lambda t: F.element_at(by_slot, (F.pmod(F.xxhash64(t), F.lit(slots)) + 1).cast("int")))))
    patterns = F.array(*[F.lit(r.regex()) for r in rules])
    return F.filter(cands, lambda i: F.regexp_like(_key(), F.element_at(patterns, i + 1)))


def _choose(df: DataFrame, rules, n_host: int, id_col: str) -> DataFrame:
    """Of the rules hit: the longest host rule, and the first pattern rule."""
    order = sorted(range(n_host), key=lambda i: (-len(rules[i].host) - len(rules[i].path), i))
    hit = F.col("__hit")
    best = F.coalesce(*[F.when(F.array_contains(hit, i), F.lit(i)) for i in order], F.lit(None).cast("int"))
    pat = F.array_min(F.filter(hit, lambda i: i >= n_host))
    name = F.array(*[F.lit(r.label) for r in rules]) if rules else F.array(F.lit(""))
    verdict = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array(F.lit(""))
    df = df.withColumn("__best", best).withColumn("__pat", pat)
    return df.select(
        id_col, "host", "path",
        F.when(F.col("__best").isNotNull(), F.element_at(name, F.col("__best") + 1)).alias("rule"),
        F.when(F.col("__best").isNotNull(), F.element_at(verdict, F.col("__best") + 1)).when(F.col("__pat").isNotNull(), F.element_at(verdict, F.col("__pat") + 1)).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("__pat").isNotNull(), F.element_at(name, F.col("__pat") + 1)).alias("pattern_rule"),
    )


def _judge_joined(base: DataFrame, rules, n_host: int, index, id_col: str) -> DataFrame:
    """For long rule lists: distinct URLs' tokens join the index; results return by URL."""
    spark = base.sparkSession
    place = {i: t for t, own in index.items() for i in own}
    table_ = spark.createDataFrame([(place[i], i, r.regex(), i < n_host, -len(r.host) - len(r.path), r.label, r.verdict) for i, r in enumerate(rules)], "t string, i int, regex string, is_host boolean, len int, label string, verdict string")
    urls = base.select("host", "path").distinct()
    hits = urls.withColumn("t", F.explode(_tokens())).join(table_, "t").where(F.regexp_like(_key(), F.col("regex")))
    best = hits.groupBy("host", "path").agg(
        F.min(F.when(F.col("is_host"), F.struct("len", "i", "label", "verdict"))).alias("b"),
        F.min(F.when(~F.col("is_host"), F.struct("i", "label", "verdict"))).alias("p"),
    )
    return base.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("b.label").alias("rule"), F.coalesce("b.verdict", "p.verdict", F.lit("allow")).alias("verdict"), F.col("p.label").alias("pattern_rule"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _sql() -> str:
    hosts = sorted(HOST_RULES, key=lambda r: -len(r.host) - len(r.path))
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    pats = " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.label}'" for r in PATTERN_RULES)
    verd = " ".join(f"WHEN '{r.label}' THEN '{r.verdict}'" for r in [*HOST_RULES, *PATTERN_RULES])
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.label}'" for r in hosts)} END AS rule, CASE {pats} END AS pattern_rule FROM parts)
    SELECT page_id, host, path, rule, COALESCE(CASE rule {verd} END, CASE pattern_rule {verd} END, 'allow') AS verdict, pattern_rule FROM ruled"""


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLES = {"op3_url_filters": _sql()}
