"""Digests of logs, search hits and prose: grouping, budgets and gaps over lines as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import BLOCKS_SQL, LOG_SQL, SEARCH_SQL, blocks, in_order, log_lines, search_lines
from .signals import _EST, _LEVEL, _LN, _SCORE, _STRIP, _TAGS, ANCHOR_SQL, TOKENS_SQL, anchor

# Budgets of the digests.
MIN_LOG_LINES, MAX_SEVERITY = 8, 50
MAX_FILES, PER_FILE, TOTAL_HITS, MIN_HITS = 40, 5, 40, 6


def log_templates(ln: DataFrame) -> DataFrame:
    """doc_id, template, n, first_line, example: groups of non-blank log lines alike but for their variable tokens."""
    t = ln.where(T.strip(F.col("line")) != "").withColumn("template", T.template(F.col("line")))
    return t.groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.min_by("line", "line_no").alias("example"))


def log_digest(ln: DataFrame) -> DataFrame:
    """doc_id, digest: patterns in order of first appearance, then up to MAX_SEVERITY severe lines.

    Null where there are fewer than MIN_LOG_LINES non-blank lines or every pattern occurs once.
    """
    shown = F.concat(F.lit("x"), F.col("n").cast("string"), F.lit(" "), "template", F.when(F.col("example") != F.col("template"), F.concat(F.lit("\n     e.g. "), "example")).otherwise(""))
    body = log_templates(ln).groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("patterns"), in_order(shown, F.col("first_line")).alias("body"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    severe = ln.where(T.has_word(F.col("line"), *T.SEVERITIES)).withColumn("r", rank).where(F.col("r") <= MAX_SEVERITY)
    tail = severe.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), in_order(F.concat(F.lit("  "), "line"), F.col("line_no")).alias("severe"))
    head = F.concat(F.lit("["), F.col("lines").cast("string"), F.lit(" lines, "), F.col("patterns").cast("string"), F.lit(" patterns]\n"))
    end = F.when(F.col("k") > 0, F.concat(F.lit("\n\nerrors and warnings ("), F.col("k").cast("string"), F.lit("):\n"), "severe")).otherwise("")
    fits = (F.col("lines") >= MIN_LOG_LINES) & (F.col("patterns") < F.col("lines"))
    return body.join(tail, "doc_id", "left").select("doc_id", F.when(fits, F.concat(head, "body", end)).alias("digest"))


def parse_hits(ln: DataFrame) -> DataFrame:
    """doc_id, line_no, path, number, hit of lines shaped path:line:text or path:line:column:text."""
    parts = F.split("line", ":", 3)
    h = ln.select("doc_id", "line_no", parts.alias("p")).where((F.size("p") == 3) & F.regexp_like(F.get("p", F.lit(0)), F.lit(r"[/.\\]")) & F.regexp_like(F.get("p", F.lit(1)), F.lit("^[0-9]{1,18}$")))
    return h.select("doc_id", "line_no", F.get("p", F.lit(0)).alias("path"), F.get("p", F.lit(1)).cast("long").alias("number"), F.regexp_replace(F.get("p", F.lit(2)), "^[0-9]+:", "").alias("hit"))


def search_files(ln: DataFrame) -> DataFrame:
    """doc_id, path, n, first_line, shown: how many hits of each file a digest shows; files past MAX_FILES are absent."""
    f = parse_hits(ln).groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    w = Window.partitionBy("doc_id").orderBy("first_line")
    want = F.least(F.col("n"), F.lit(PER_FILE))
    f = f.withColumn("pos", F.row_number().over(w)).withColumn("before", F.sum(want).over(w) - want).where(F.col("pos") <= MAX_FILES)
    return f.select("doc_id", "path", "n", "first_line", F.greatest(F.lit(0), F.least(want, TOTAL_HITS - F.col("before"))).alias("shown"))


def search_digest(ln: DataFrame) -> DataFrame:
    """doc_id, digest: hits under their files within the budgets; null below MIN_HITS hits or if each file has one hit."""
    hits, files = parse_hits(ln), search_files(ln)
    rank = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("line_no"))
    kept = hits.withColumn("r", rank).join(files.select("doc_id", "path", "shown"), ["doc_id", "path"]).where(F.col("r") <= F.col("shown"))
    text = kept.groupBy("doc_id", "path").agg(in_order(F.concat(F.lit("  "), F.col("number").cast("string"), F.lit(":"), "hit"), F.col("line_no")).alias("rows"))
    rest = F.col("n") - F.col("shown")
    part = files.join(text, ["doc_id", "path"], "left").select("doc_id", "first_line", "shown", F.concat("path", F.coalesce(F.concat(F.lit("\n"), "rows"), F.lit("")), F.when(rest > 0, F.concat(F.lit("\n  ... "), rest.cast("string"), F.lit(" more in this file"))).otherwise("")).alias("part"))
    body = part.groupBy("doc_id").agg(in_order(F.col("part"), F.col("first_line")).alias("body"), F.count(F.lit(1)).alias("listed"), F.sum("shown").alias("shown"))
    total = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))
    more = F.when(F.col("files") > F.col("listed"), F.concat(F.lit("\n... "), (F.col("files") - F.col("listed")).cast("string"), F.lit(" more files not shown"))).otherwise("")
    gone = F.when(F.col("hits") > F.col("shown"), F.concat(F.lit("\n"), (F.col("hits") - F.col("shown")).cast("string"), F.lit(" matches elided"))).otherwise("")
    head = F.concat(F.lit("["), F.col("hits").cast("string"), F.lit(" matches in "), F.col("files").cast("string"), F.lit(" files]\n"))
    return total.join(body, "doc_id").select("doc_id", F.when((F.col("hits") >= MIN_HITS) & (F.col("files") < F.col("hits")), F.concat(head, "body", more, gone)).alias("digest"))


def most_important(b: DataFrame, budget: int) -> DataFrame:
    """block_id, line_no of the `budget` most important lines of each text, equal ones by place; null texts have no lines."""
    level = lambda line: T.let(T.let(T.keyword_score(line), lambda score: T.importance(line, score)), lambda i: F.when(i == "critical", -2).when(i == "notable", -1).otherwise(0))
    ranked = F.sort_array(F.transform(T.lines(F.col("content")), lambda line, at: F.struct(level(line).alias("level"), at.alias("at"))))
    return b.select("block_id", F.explode(F.slice(ranked, 1, budget)).alias("r")).select("block_id", F.col("r.at").alias("line_no"))


def summarise(b: DataFrame, budget: int = 60, min_lines: int = 60, queries: DataFrame | None = None) -> DataFrame:
    """block_id, digest: the most important lines of a text with gaps counted between them.

    Anchors, lines with markup and, where there is a query, the lines that answer it best are always kept, even beyond the
    budget; others by importance, then place. Texts of at most min_lines lines give no row. b: block_id, content; queries:
    block_id, query. A block's lines are ranked in its own row; without queries nothing is shuffled.
    """
    from .relevance import relevant_lines

    held = b.select("block_id", T.lines(F.col("content")).alias("a")).where(F.size("a") > min_lines)
    answers = F.array().cast("array<int>")
    if queries is not None:
        ln = held.select("block_id", F.posexplode("a").alias("line_no", "line"))
        found = relevant_lines(ln, queries).groupBy("block_id").agg(F.collect_list(F.col("line_no").cast("int")).alias("answers"))  # a few lines a block
        held = held.join(found, "block_id", "left")
        answers = F.coalesce("answers", answers)

    # one expression over names of its own: a filter on the digest that moves below it repeats no step for each line
    def ranked(a: Column) -> Column:
        """Lines by what sorts first: what is required (by importance alike), then the others by importance, then by place."""

        def rank(line: Column, at: Column) -> Column:
            required = anchor(line, (at == 0) | (at == F.size(a) - 1)).isNotNull() | (F.size(T.tags(line)) > 0) | F.array_contains(answers, at)
            level = F.when(required, F.lit(-3)).otherwise(T.let(T.importance(line), lambda i: F.when(i == "critical", -2).when(i == "notable", -1).otherwise(0)))
            return F.struct(level.alias("level"), at.alias("at"))

        return F.array_sort(F.transform(a, rank))

    def places(r: Column) -> Column:
        must = F.size(F.filter(r, lambda x: x["level"] == -3))
        return F.array_sort(F.transform(F.slice(r, F.lit(1), F.greatest(F.lit(budget), must)), lambda x: x["at"]))

    def written(a: Column, kept: Column) -> Column:
        gap = lambda at, i: at - F.when(i > 0, F.get(kept, i - 1)).otherwise(at - 1) - 1
        shown = lambda at, i: F.concat(T.let(gap(at, i), lambda n: F.when(n > 0, F.concat(F.lit("... "), n.cast("string"), F.lit(" lines ...\n"))).otherwise("")), F.get(a, at))
        head = F.concat(F.lit("["), F.size(a).cast("string"), F.lit(" lines, "), F.size(kept).cast("string"), F.lit(" shown]\n"))
        return F.concat(head, F.array_join(F.transform(kept, shown), "\n"))

    digest = T.let(F.col("a"), lambda a: T.let(ranked(a), lambda r: T.let(places(r), lambda kept: written(a, kept))))
    return held.select("block_id", digest.alias("digest"))


def tidy(c: Column) -> Column:
    """Lines without trailing spaces and tabs, blank runs of one line at most."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<![ \t\r])[ \t\r]++(\n|\z)", "$1"), r"\n{3,}", "\n\n")


def stored(b: DataFrame) -> DataFrame:
    """block_id, marker, hash: what is stored under which name before a digest replaces it; equal contents share a name."""
    return b.select("block_id", T.content_hash(F.col("content")).alias("hash"), T.marker(F.col("content")).alias("marker"))


def keep_if_smaller(b: DataFrame, digests: DataFrame) -> DataFrame:
    """block_id, outcome, tokens_before, tokens_after: a digest counts only if its estimate is strictly smaller."""
    before, after = T.estimated_tokens(F.col("content")), T.estimated_tokens(F.col("digest"))
    j = b.join(digests, "block_id", "left").select("block_id", before.alias("tokens_before"), after.alias("a"))
    ok = F.col("a").isNotNull() & (F.col("a") < F.col("tokens_before"))
    return j.select("block_id", F.when(F.col("a").isNull(), "declined").when(ok, "compressed").otherwise("not_smaller").alias("outcome"), "tokens_before", F.when(ok, F.col("a")).otherwise(F.col("tokens_before")).alias("tokens_after"))


def q_log_templates(spark: SparkSession, d: str) -> DataFrame:
    return log_templates(log_lines(spark, d)).select("doc_id", "template", "n", F.col("first_line").cast("long").alias("first_line"), "example")


def q_log_digest(spark: SparkSession, d: str) -> DataFrame:
    return log_digest(log_lines(spark, d))


def q_search_digest(spark: SparkSession, d: str) -> DataFrame:
    return search_digest(search_lines(spark, d))


def q_prose_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarise(blocks(spark, d), budget=12, min_lines=15)


def q_most_important_lines(spark: SparkSession, d: str) -> DataFrame:
    return most_important(blocks(spark, d), 5)


def q_tidy_lines(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.select("block_id", F.octet_length(tidy(F.col("content"))).cast("long").alias("bytes_after"), F.sha2(tidy(F.col("content")).cast("binary"), 256).alias("sha"))


def q_content_markers(spark: SparkSession, d: str) -> DataFrame:
    return stored(blocks(spark, d))


def q_digest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select("block_id", "content")
    name = lambda df, k: df.select(F.concat(F.lit(k), F.col("doc_id").cast("string")).alias("block_id"), "digest")
    return keep_if_smaller(b, name(log_digest(log_lines(spark, d)), "log-").union(name(search_digest(search_lines(spark, d)), "search-")))


_PART = r"""^([(\[{"''<]*)(.*?)([)\]}"''>,;:.]*)$"""
_C = f"regexp_extract(r, '{_PART}', 2)"
_NDIG = lambda p: f"len(regexp_extract_all({_C}, '{p}'))"
_KIND = rf"""CASE WHEN regexp_matches({_C}, '^[-0-9:TZ.+]{{8,}}$') AND {_NDIG("[0-9]")} >= 4 AND {_NDIG("[-:TZ.+]")} >= 2 THEN '<ts>' WHEN regexp_matches({_C}, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') THEN '<uuid>'
 WHEN regexp_matches({_C}, '^0[xX][0-9A-Fa-f]+$') OR (regexp_matches({_C}, '^[0-9A-Fa-f]{{12,}}$') AND regexp_matches({_C}, '[A-Fa-f]')) THEN '<hex>' WHEN regexp_matches({_C}, '^[-+]?[0-9.]*[0-9][0-9.]*(%|[A-Za-z]{{1,3}})?$') THEN '<n>'
 WHEN regexp_matches({_C}, '[/\\]') AND strlen({_C}) > 1 AND NOT starts_with({_C}, '//') AND regexp_matches({_C}, '[0-9A-Za-z]') THEN '<path>' ELSE {_C} END"""
_TEMPLATE = rf"""array_to_string(list_transform(regexp_extract_all(line, '([^{T.WS}]+|[{T.WS}]+)'), lambda r: CASE WHEN regexp_matches(r, '^[{T.WS}]') OR {_C} = '' THEN r ELSE regexp_extract(r, '{_PART}', 1) || {_KIND} || regexp_extract(r, '{_PART}', 3) END), '')"""
_WORDS = lambda w: f"regexp_matches(line, '(^|[^0-9A-Za-z_])({w})($|[^0-9A-Za-z_])')"
_TPL = f"{LOG_SQL}, tp AS (SELECT doc_id, {_TEMPLATE} AS template, count(*) AS n, min(line_no)::BIGINT AS first_line, min_by(line, line_no) AS example FROM log_lines WHERE {_STRIP('line')} <> '' GROUP BY 1, 2)"
_LOGD = f"""{_TPL}, bd AS (SELECT doc_id, sum(n)::BIGINT AS lines, count(*) AS patterns, string_agg('x' || n || ' ' || template || CASE WHEN example <> template THEN chr(10) || '     e.g. ' || example ELSE '' END, chr(10) ORDER BY first_line) AS body FROM tp GROUP BY 1),
 sv AS (SELECT doc_id, count(*) AS k, string_agg('  ' || line, chr(10) ORDER BY line_no) AS severe FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM log_lines WHERE {_WORDS('|'.join(T.SEVERITIES))}) WHERE r <= {MAX_SEVERITY} GROUP BY 1),
 logd AS (SELECT doc_id, CASE WHEN lines >= {MIN_LOG_LINES} AND patterns < lines THEN '[' || lines || ' lines, ' || patterns || ' patterns]' || chr(10) || body || CASE WHEN k > 0 THEN chr(10) || chr(10) || 'errors and warnings (' || k || '):' || chr(10) || severe ELSE '' END END AS digest FROM bd LEFT JOIN sv USING (doc_id))"""
_SEAD = rf"""{SEARCH_SQL}, h AS (SELECT doc_id, line_no, regexp_extract(line, '^([^:]*[/.\\][^:]*):([0-9]+):(?:[0-9]+:)?(.*)$', 1) AS path, regexp_extract(line, '^([^:]*[/.\\][^:]*):([0-9]+):(?:[0-9]+:)?(.*)$', 2)::BIGINT AS number, regexp_extract(line, '^([^:]*[/.\\][^:]*):([0-9]+):(?:[0-9]+:)?(.*)$', 3) AS hit FROM search_lines WHERE regexp_matches(line, '^([^:]*[/.\\][^:]*):([0-9]+):(?:[0-9]+:)?(.*)$')),
 f0 AS (SELECT doc_id, path, count(*) AS n, min(line_no) AS first_line FROM h GROUP BY 1, 2), f1 AS (SELECT *, row_number() OVER w AS pos, sum(least(n, {PER_FILE})) OVER w - least(n, {PER_FILE}) AS before FROM f0 WINDOW w AS (PARTITION BY doc_id ORDER BY first_line)),
 f AS (SELECT *, greatest(0, least(least(n, {PER_FILE}), {TOTAL_HITS} - before))::BIGINT AS shown FROM f1 WHERE pos <= {MAX_FILES}), hr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY line_no) AS r FROM h),
 tx AS (SELECT hr.doc_id, hr.path, string_agg('  ' || number || ':' || hit, chr(10) ORDER BY line_no) AS rows_ FROM hr JOIN f USING (doc_id, path) WHERE r <= shown GROUP BY 1, 2),
 pt AS (SELECT f.doc_id, first_line, shown, f.path || coalesce(chr(10) || rows_, '') || CASE WHEN n > shown THEN chr(10) || '  ... ' || (n - shown) || ' more in this file' ELSE '' END AS part FROM f LEFT JOIN tx USING (doc_id, path)),
 sb AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY first_line) AS body, count(*) AS listed, sum(shown)::BIGINT AS shown FROM pt GROUP BY 1), tt AS (SELECT doc_id, count(*) AS hits, count(DISTINCT path) AS files FROM h GROUP BY 1),
 sead AS (SELECT doc_id, CASE WHEN hits >= {MIN_HITS} AND files < hits THEN '[' || hits || ' matches in ' || files || ' files]' || chr(10) || body || CASE WHEN files > listed THEN chr(10) || '... ' || (files - listed) || ' more files not shown' ELSE '' END || CASE WHEN hits > shown THEN chr(10) || (hits - shown) || ' matches elided' ELSE '' END END AS digest FROM tt JOIN sb USING (doc_id))"""
_TIDY = r"regexp_replace(regexp_replace(content, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


_AFTER = TOKENS_SQL.replace("measured AS", "after AS").replace("FROM blocks", "FROM dg")
_OUTCOMES = f"""WITH {BLOCKS_SQL}, {_LOGD.replace(LOG_SQL + ', ', '')}, {_SEAD.replace(SEARCH_SQL + ', ', '')},
 dg AS (SELECT 'log-' || doc_id AS block_id, digest AS content FROM logd UNION ALL SELECT 'search-' || doc_id, digest FROM sead), {TOKENS_SQL}, {_AFTER},
 b AS (SELECT block_id, {_EST} AS tokens_before FROM measured), a AS (SELECT block_id, {_EST} AS a FROM after WHERE content IS NOT NULL)
 SELECT block_id, CASE WHEN a IS NULL THEN 'declined' WHEN a < tokens_before THEN 'compressed' ELSE 'not_smaller' END AS outcome, tokens_before,
 CASE WHEN a < tokens_before THEN a ELSE tokens_before END AS tokens_after FROM b LEFT JOIN a USING (block_id)"""


QUERIES = {"log_templates": q_log_templates, "log_digest": q_log_digest, "search_digest": q_search_digest, "prose_summary": q_prose_summary, "most_important_lines": q_most_important_lines, "tidy_lines": q_tidy_lines, "content_markers": q_content_markers, "digest_outcomes": q_digest_outcomes}
ORACLES = {
    "log_templates": f"WITH {_TPL} SELECT * FROM tp",
    "log_digest": f"WITH {_LOGD} SELECT * FROM logd",
    "search_digest": f"WITH {_SEAD} SELECT * FROM sead",
    "prose_summary": rf"""WITH {BLOCKS_SQL}, {_LN}, l1 AS (SELECT *, {_STRIP("line")} AS t, {_SCORE} AS score FROM ln),
 l2 AS (SELECT *, ({ANCHOR_SQL}) IS NOT NULL OR {_TAGS} > 0 AS req, CASE {_LEVEL} WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END AS lv FROM l1 WHERE n > 15),
 l3 AS (SELECT *, sum(req::INT) OVER (PARTITION BY block_id) AS must, row_number() OVER (PARTITION BY block_id ORDER BY req DESC, lv DESC, line_no) AS r FROM l2),
 l4 AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY block_id ORDER BY line_no) - 1 AS gap FROM l3 WHERE r <= greatest(12, must))
 SELECT block_id, '[' || max(n) || ' lines, ' || count(*) || ' shown]' || chr(10) || string_agg(CASE WHEN gap > 0 THEN '... ' || gap || ' lines ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY line_no) AS digest FROM l4 GROUP BY 1""",
    "most_important_lines": rf"""WITH {BLOCKS_SQL}, {_LN}, l1 AS (SELECT *, {_STRIP("line")} AS t, {_SCORE} AS score FROM ln), l2 AS (SELECT *, CASE {_LEVEL} WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END AS lv FROM l1)
 SELECT block_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY lv DESC, line_no) AS r FROM l2) WHERE r <= 5""",
    "tidy_lines": rf"WITH {BLOCKS_SQL} SELECT block_id, strlen({_TIDY})::BIGINT AS bytes_after, sha256({_TIDY}) AS sha FROM blocks",
    "content_markers": f"WITH {BLOCKS_SQL} SELECT block_id, left(sha256(content), 32) AS hash, '<<ccr:' || left(sha256(content), 32) || '>>' AS marker FROM blocks",
    "digest_outcomes": _OUTCOMES,
}
