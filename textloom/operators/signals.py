"""Detection, safety, routing and line signals over blocks and lines.

A block is one row: what its lines tell is counted by patterns over the whole text, in the scan, without a row for each line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sql import IS_JSON, let, raw
from ..sources.tables import BLOCKS_SQL, LINES_SQL, block_lines, blocks, read

# Size gates in bytes, and what each authentication mode allows.
THRESHOLDS = {"code": 2048, "json": 1024, "log": 500, "diff": 500, "search": 500, "prose": 5120}
POLICY_COLUMNS = ("lossy", "lossless", "auto_cache_control", "auto_prompt_cache_key", "forwarded_headers", "may_strip_accept_encoding")
POLICIES = {
    "payg": (True, True, True, True, True, True),
    "oauth": (False, True, False, False, True, True),
    "subscription": (False, False, False, False, False, False),
}
#: The transform of each content type, and those that only tool output gets.
TRANSFORMS = {"json": "record_set", "log": "log_digest", "search": "search_digest", "diff": "diff_digest", "code": "code_digest", "prose": "prose_summary"}
TOOL_OUTPUT_ONLY = ("prose",)
# Names that tell a counter.
COUNTER_NAMES = ("count", "seq", "index", "number", "iteration", "turn", "nonce")


@dataclass(frozen=True)
class Limits:
    """Beyond these a text is left alone."""

    max_bytes: int = 8 << 20
    max_line: int = 1 << 20
    max_lines: int = 200_000
    max_depth: int = 64


_WS, _SP = T.WS, T.WS_IN_LINE
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}"
#: What detection counts or looks for, line by line of the stripped text ((?md): only a line feed ends a line).
LINE_PATTERNS = {
    "n": rf"(?md)^[{_SP}]*[^{_WS}]",
    "hits": r"(?md)^(?=[^:\n]*[/.\\])[^:\n]++:[0-9]++(:|\r?$)",
    "stamps": rf"(?md)^[{_SP}]*[\[(]*({_DATE})",
    "levels": rf"(?md)^(?:.*[^0-9A-Za-z_\n])?(?:{'|'.join(T.LOG_LEVELS)})(?![0-9A-Za-z_]).*$",
    "indented": rf"(?md)^(?:  |\t)[{_SP}]*[^{_WS}]",
}
DIFF_PATTERNS = {
    "diff_mark": r"(?md)^--- .*\n\+\+\+ |^diff --git ",
    "hunk": rf"(?md)^@@(?:.*@@)?[{_SP}]*$",
    "change": r"(?md)^(?!--- )[-+](?!\r?$).",
}


#: Content type and confidence by a condition over what is counted; the first that holds. Conditions read alike in SQL and
#: in Python. A stage's counts are only made where no earlier stage has found a type.
STAGES = (
    (("json",), (("json", 1.0, "json"),)),
    (("diff_mark", "hunk", "change"), (("diff", 1.0, "diff_mark and hunk"), ("diff", 0.85, "diff_mark and change"), ("diff", 0.8, "hunk and change"))),
    (("n", "hits"), (("search", 0.9, "n >= 2 and 5 * hits >= 4 * n"), ("search", 0.7, "n >= 2 and 5 * hits >= 3 * n"))),
    (
        ("stamps", "levels"),
        (("log", 0.95, "n >= 2 and 5 * stamps >= 4 * n"), ("log", 0.8, "n >= 2 and (2 * stamps >= n or 5 * levels >= 4 * n)"), ("log", 0.65, "n >= 2 and 2 * levels >= n")),
    ),
    (
        ("words", "marks", "size", "indented"),
        (
            ("code", 0.95, "words >= 3 and marks >= 2 * size"), ("code", 0.85, "words >= 2 and marks >= 3 * size"), ("code", 0.75, "words >= 3"),
            ("code", 0.7, "words >= 1 and marks >= 5 * size and 10 * indented >= 3 * n"),
        ),
    ),
)
#: What a text must hold for a pattern to be looked for: the plain search is many times cheaper.
NEEDED = {"diff_mark": ("--- ", "diff --git "), "hunk": ("@@",), "change": ("@@", "--- ", "diff --git "), "hits": (":",), "stamps": ("-", ":"), "levels": T.LOG_LEVELS}
BRACKETS = r"[{}()\[\];]+"
UNKNOWN, PROSE = ("unknown", 1.0), ("prose", 0.4)


def detection(content: str) -> str:
    """SQL text of the struct (t: content type, c: confidence) of a text: one expression in which the stripped text is worked
    out once, and a stage's counts once where it is reached."""
    held = lambda name: " OR ".join(f"contains(t, '{w}')" for w in NEEDED[name])
    counts = {k: (f"regexp_count(t, {raw(p)})", "0") for k, p in LINE_PATTERNS.items()} | {k: (f"t RLIKE {raw(p)}", "false") for k, p in DIFF_PATTERNS.items()}
    counts = {k: f"CASE WHEN {held(k)} THEN {c} ELSE {none} END" if k in NEEDED else c for k, (c, none) in counts.items()}
    counts |= {"json": IS_JSON, "words": " + ".join(f"cast(contains(t, '{w}') AS int)" for w in T.CODE_WORDS), "size": "octet_length(t)"}
    counts["marks"] = f"100 * (length(t) - length(regexp_replace(t, {raw(BRACKETS)}, '')))"
    stage = {n: i for i, (names, _) in enumerate(STAGES) for n in names}
    found = lambda name, score: f"named_struct('t', '{name}', 'c', {score}D)"
    # a condition may also look at what earlier stages have counted
    placed = lambda condition: re.sub("[a-z_]+", lambda m: f"s{stage[m[0]]}.{m[0]}" if m[0] in stage else m[0], condition)
    out = found(*PROSE)
    for i, (names, rules) in reversed(list(enumerate(STAGES))):
        cases = " ".join(f"WHEN {placed(condition)} THEN {found(name, score)}" for name, score, condition in rules)
        out = let(f"named_struct({', '.join(f"'{n}', {counts[n]}" for n in names)})", f"s{i}", f"CASE {cases} ELSE {out} END")
    return let(f"btrim(coalesce({content}, ''), '{T.WS_CHARS}')", "t", f"CASE WHEN t = '' THEN {found(*UNKNOWN)} ELSE {out} END")


def detect(b: DataFrame) -> DataFrame:
    """The columns of b with content_type and confidence: JSON, diff, search hits, log, code, else prose; blank is unknown.

    Null contents are unknown. Ratios over a block's lines are compared by whole numbers. JSON is what parses as an object or
    array to its end. Other columns stay; every row is judged by itself, so repeated rows are judged alike.
    """
    return b.select("*", F.expr(detection("content")).alias("__f")).select(*b.columns, F.col("__f.t").alias("content_type"), F.col("__f.c").alias("confidence"))


def bracket_depth(c: Column) -> Column:
    """Greatest depth of [ and { outside strings."""
    plain = F.regexp_replace(T.without_strings(c), r"[^\[\]{}]+", "")
    runs = F.regexp_extract_all(plain, F.lit(r"([\[{]+|[\]}]+)"))  # of openings or of closings: depth is greatest behind openings

    def step(a: Column, run: Column) -> Column:
        now = a["now"] + F.when(F.substring(run, 1, 1).isin("[", "{"), F.length(run)).otherwise(-F.length(run))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    walked = F.aggregate(runs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)
    return walked["most"]


def hazard(c: Column, limits: Limits = Limits()) -> Column:
    """First of too_large, line_too_long, too_many_lines, too_deep that holds for a text; null if none."""
    rows = F.split(c, "\n")
    deep = F.regexp_like(c, F.lit(rf"^[{_WS}]*[\[{{]")) & (bracket_depth(c) > limits.max_depth)
    return (
        F.when(F.octet_length(c) > limits.max_bytes, "too_large").when(F.exists(rows, lambda r: F.octet_length(r) > limits.max_line), "line_too_long")
        .when(F.size(rows) > limits.max_lines, "too_many_lines").when(deep, "too_deep")
    )


def policies(spark: SparkSession) -> DataFrame:
    """mode and what it allows: a fixed table of three rows."""
    return spark.createDataFrame([(m, *p) for m, p in POLICIES.items()], "mode string, " + ", ".join(f"{c} boolean" for c in POLICY_COLUMNS))


def _by_type(values: dict) -> Column:
    """The value of a row's content_type; null where there is none."""
    return F.coalesce(*[F.when(F.col("content_type") == k, F.lit(v)) for k, v in values.items()])


def reason_of(unsafe: Column, size: Column, kind: Column, lossy: Column, lossless: Column, worth: Column) -> Column:
    """What is done with a block of a content_type, and why: the reasons of `route`."""
    unfit = _by_type(TRANSFORMS).isNull() | (F.col("content_type").isin(*TOOL_OUTPUT_ONLY) & (kind == "text"))
    return (
        F.when(unsafe, "unsafe").when(~lossy & lossless, "lossless").when(~lossy, "policy_forbids")
        .when(unfit, "no_compressor").when(size <= _by_type(THRESHOLDS), "below_size").when(~worth, "measured_useless").otherwise("compress")
    )


def route(b: DataFrame, recommended: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """The columns of b with content_type, confidence, transform and reason.

    b: content, kind and mode; an unknown mode allows nothing. Reasons, the first that holds: unsafe, lossless or
    policy_forbids where the mode allows no loss, no_compressor (also prose that is no tool output), below_size,
    measured_useless, compress. transform is null unless the reason is lossless (reformat) or compress.
    recommended: content_type, worth; a type without a row is worth trying.
    """
    routed = detect(b).join(F.broadcast(policies(b.sparkSession).select("mode", "lossy", "lossless")), "mode", "left")
    worth = F.lit(True)
    if recommended is not None:  # at most a row for each content type
        routed = routed.join(F.broadcast(recommended.select("content_type", "worth")), "content_type", "left")
        worth = F.coalesce("worth", F.lit(True))
    unsafe = hazard(F.col("content"), limits).isNotNull()
    reason = reason_of(unsafe, F.octet_length("content"), F.col("kind"), F.coalesce("lossy", F.lit(False)), F.coalesce("lossless", F.lit(False)), worth)
    routed = routed.withColumn("reason", reason)
    transform = F.when(F.col("reason") == "compress", _by_type(TRANSFORMS)).when(F.col("reason") == "lossless", "reformat")
    return routed.withColumn("transform", transform).select(*b.columns, "content_type", "confidence", "transform", "reason")


def anchor(line: Column, first_or_last: Column) -> Column:
    """Why a line holds a text together: hunk_header, fence, heading, stack_frame, structure_open or boundary; else null."""
    t = T.strip(line)
    # a pattern is only looked for where a plain search finds what it must hold
    place = F.contains(t, F.lit(".")) & F.contains(t, F.lit(":")) & F.regexp_like(t, F.lit(r"[A-Za-z0-9_]\.[A-Za-z]+:[0-9]+"))
    frame = T.starts(t, "at ", 'File "') | place
    heading = T.starts(t, "#", "===", "---") & F.regexp_like(t, F.lit(r"^(#+ .+|={3,}|-{3,})$"))
    opens = F.endswith(t, F.lit("[")) | F.endswith(t, F.lit("{")) | F.endswith(t, F.lit("("))
    return (
        F.when(F.startswith(line, F.lit("@@")), "hunk_header").when(F.startswith(t, F.lit("```")), "fence").when(heading, "heading")
        .when(frame, "stack_frame").when(opens, "structure_open").when(first_or_last, "boundary")
    )


def is_boundary() -> Column:
    """The first or last line of a block, of the rows block_lines gives."""
    return (F.col("line_no") == 0) | (F.col("line_no") == F.col("n") - 1)


def line_flags(line: Column, first_or_last: Column) -> dict[str, Column]:
    """Public predicates of a line: breaks_markup (removing it would split a tag pair), removable (no anchor), is_error."""
    return {"breaks_markup": F.size(T.tags(line)) > 0, "removable": anchor(line, first_or_last).isNull(), "is_error": T.keyword_score(line) >= 3}


def volatile_kind(t: Column) -> Column:
    """uuid, timestamp, hex or null of a token of at least 8 bytes."""
    return (
        F.when(F.regexp_like(t, F.lit("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")), "uuid").when(F.regexp_like(t, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}")), "timestamp")
        .when(F.regexp_like(t, F.lit("^[0-9A-Fa-f]{16,}$")), "hex")
    )


def volatile_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, sample: distinct values that change from call to call (UUIDs, timestamps, long hex strings) of each text."""
    tok = df.select(key, F.explode(F.split(text, rf'[{_WS},;"]+')).alias("t")).select(key, F.regexp_replace("t", r"^[()\[\].]+|[()\[\].]+$", "").alias("t")).where(F.octet_length("t") >= 8)
    shown = F.when(F.length("t") > 24, F.concat(F.substring("t", 1, 24), F.lit("…"))).otherwise(F.col("t"))
    return tok.select(key, volatile_kind(F.col("t")).alias("kind"), shown.alias("sample")).where("kind IS NOT NULL").distinct()


def names_a_counter(name: Column, value: Column) -> Column:
    """A member whose name tells a counter and whose literal is a whole number that an unsigned 64-bit word holds."""
    whole = F.expr("try_cast(value AS decimal(20, 0))") if isinstance(value, str) else F.when(F.regexp_like(value, F.lit("^[0-9]{1,20}$")), value.cast("decimal(20,0)"))
    return F.coalesce(F.regexp_like(F.lower(name), F.lit("|".join(COUNTER_NAMES))) & (whole <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(False))


def _mode() -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in POLICIES]), (F.pmod(F.length("block_id"), F.lit(3)) + 1).cast("int"))


def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("block_id", T.estimated_tokens(F.col("content")).alias("tokens"))


def q_detect(spark: SparkSession, d: str) -> DataFrame:
    return detect(blocks(spark, d)).select("block_id", "content_type", "confidence")


def q_route(spark: SparkSession, d: str) -> DataFrame:
    """Blocks under all three modes, with tight limits that some blocks break and a recommendation against search hits."""
    advice = spark.createDataFrame([("search", False), ("json", True)], "content_type string, worth boolean")
    b = blocks(spark, d).withColumn("mode", _mode())
    return route(b, advice, Limits(max_bytes=60_000, max_lines=400)).select("block_id", "content_type", "transform", "reason")


LEVELS = ("critical", "notable", "routine")


def line_importance(b: DataFrame) -> DataFrame:
    """block_id, importance, n_lines, score: the lines of each block by importance, counted in the block's own row."""
    def scored(line: Column) -> Column:
        return T.let(T.keyword_score(line), lambda s: F.struct(T.importance(line, s).alias("importance"), s.alias("score")))

    own = b.select("block_id", F.transform(T.lines(F.col("content")), scored).alias("a"))
    level = lambda name: F.transform(F.filter("a", lambda x: x["importance"] == name), lambda x: x["score"])
    sums = lambda name: T.let(level(name), lambda s: F.struct(F.lit(name).alias("importance"), F.size(s).cast("long").alias("n_lines"), F.aggregate(s, F.lit(0).cast("long"), lambda x, y: x + y).alias("score")))
    return own.select("block_id", F.explode(F.array(*[sums(n) for n in LEVELS])).alias("s")).select("block_id", "s.*").where("n_lines > 0")


def q_line_importance(spark: SparkSession, d: str) -> DataFrame:
    return line_importance(blocks(spark, d))


def q_line_anchors(spark: SparkSession, d: str) -> DataFrame:
    a = block_lines(blocks(spark, d)).withColumn("anchor", anchor(F.col("line"), is_boundary())).where("anchor IS NOT NULL")
    return a.groupBy("block_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


def q_line_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = line_flags(F.col("line"), is_boundary())
    return block_lines(blocks(spark, d)).groupBy("block_id").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def q_protected_lines(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "<", "\n<"), "\n")).alias("line_no", "line"))
    t = p.select("page_id", T.tags(F.col("line")).alias("tags"))
    return t.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum((F.size("tags") > 0).cast("long")).alias("n_protected"), F.sum(F.size("tags")).alias("n_tags"))


#: Limits that blocks of the driver tables break.
TIGHT = Limits(max_bytes=30_000, max_line=3_000, max_lines=150, max_depth=1)


def q_hazards(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("block_id", F.coalesce(hazard(F.col("content"), TIGHT), F.lit("none")).alias("hazard"))


def q_volatile_tokens(spark: SparkSession, d: str) -> DataFrame:
    return volatile_tokens(read(spark, d, "documents"), "doc_id", "text")


def q_policies(spark: SparkSession, d: str) -> DataFrame:
    return policies(spark)


def q_counters(spark: SparkSession, d: str) -> DataFrame:
    """Members of the events' properties and of invented ones, and whether they name a counter."""
    e = read(spark, d, "events").select("event_id", F.explode(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("turn_no"), F.col("event_id").cast("string"), F.lit("Sequence"), F.col("event_type")))).alias("name", "value"))
    return e.select("event_id", "name", names_a_counter(F.col("name"), F.col("value")).alias("counter"))


# --- the same in DuckDB -----------------------------------------------------------------------------------------------

_EST = rf"""CASE WHEN content = '' THEN 0 ELSE greatest(1, ceil(2 * (w - dense) / 7.0) + ceil(d / 2.0) + ceil(2 * dense / 3.0) + punct + 2 * wide + len(runs)
 + coalesce(list_sum(list_transform(list_filter(runs, lambda r: length(r) > 1),
 lambda r: length(r) // 8 + ceil(len(list_filter(range(1, length(r)), lambda i: substr(r, i, 1) <> substr(r, i + 1, 1))) / 2.0))), 0)) END::BIGINT"""
_COUNT = lambda p: f"len(regexp_extract_all(content, '{p}'))"
TOKENS_SQL = rf"""measured AS (SELECT *, {_COUNT("[A-Za-z]")} AS w, {_COUNT("[0-9]")} AS d, {_COUNT(r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]")} AS punct,
 {_COUNT(rf"[^\x00-\x7F{_WS}]")} AS wide, regexp_extract_all(content, '[{_WS}]+') AS runs,
 coalesce(list_sum(list_filter(list_transform(regexp_split_to_array(content, '[{_WS}0-9]+'), lambda s: length(regexp_replace(s, '[^A-Za-z]', '', 'g'))), lambda n: n > 12)), 0) AS dense FROM blocks)"""
_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = lambda c, w: f"regexp_matches({c}, '(^|[^0-9A-Za-z_])({w})($|[^0-9A-Za-z_])')"
_SCORE = "(" + " + ".join([f"3 * {_WORD(_LOW, w)}::INT" for w in T.ERROR_WORDS] + [f"{_WORD(_LOW, w)}::INT" for w in T.WARNING_WORDS]) + ")"
_STRIP = lambda c: rf"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_LN = f"ln AS (SELECT block_id, len(a) AS n, unnest(range(0, len(a)))::INT AS line_no, unnest(a) AS line FROM (SELECT block_id, {LINES_SQL} AS a FROM blocks))"
_TAGS = rf"len(list_filter(regexp_extract_all(line, '<([^>]*)>', 1), lambda x: NOT ends_with(x, '/') AND regexp_matches(x, '^/?[A-Za-z][A-Za-z0-9_-]*([{_WS}]|$)')))"
_CODE = " + ".join(f"contains(content, '{w}')::INT" for w in T.CODE_WORDS)
_HUNK = rf"(starts_with(line, '@@') AND regexp_matches(line, '@@[{_WS}]*$'))"
DETECT_SQL = rf"""{_LN.replace("AS a FROM blocks", "AS a FROM (SELECT block_id, " + _STRIP("content") + " AS content FROM blocks)")},
 l2 AS (SELECT *, {_STRIP("line")} = '' AS blank, lead(line) OVER (PARTITION BY block_id ORDER BY line_no) AS nxt FROM ln),
 st AS (SELECT block_id, count(*) FILTER (NOT blank) AS n, count(*) FILTER (NOT blank AND regexp_matches(line, '^[^:]*[/.\\][^:]*:[0-9]+(:|$)')) AS hits,
  count(*) FILTER (NOT blank AND regexp_matches(line, '^[{_WS}]*[\[(]*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})')) AS stamps,
  count(*) FILTER (NOT blank AND {_WORD("line", "|".join(T.LOG_LEVELS))}) AS levels, count(*) FILTER (NOT blank AND regexp_matches(line, '^(  |\t)')) AS indented,
  bool_or((starts_with(line, '--- ') AND coalesce(starts_with(nxt, '+++ '), false)) OR starts_with(line, 'diff --git ')) AS dm, bool_or({_HUNK}) AS hk,
  bool_or(NOT starts_with(line, '--- ') AND NOT {_HUNK} AND NOT starts_with(line, 'diff --git ') AND regexp_matches(line, '^[-+].')) AS ch FROM l2 GROUP BY 1),
 j AS (SELECT b.*, st.* EXCLUDE (block_id), {_CODE} AS words, {_STRIP("content")} AS tr, 100 * len(regexp_extract_all({_STRIP("content")}, '[{{}}()\[\];]')) AS mk, strlen({_STRIP("content")}) AS sz
  FROM blocks b LEFT JOIN st USING (block_id)),
 det AS (SELECT block_id, kind, content, CASE WHEN coalesce(tr, '') = '' THEN ['unknown', '1'] WHEN left(tr, 1) IN ('{{', '[') AND json_valid(tr) THEN ['json', '1']
  WHEN dm AND hk THEN ['diff', '1'] WHEN dm AND ch THEN ['diff', '0.85'] WHEN hk AND ch THEN ['diff', '0.8']
  WHEN n >= 2 AND 5 * hits >= 4 * n THEN ['search', '0.9'] WHEN n >= 2 AND 5 * hits >= 3 * n THEN ['search', '0.7']
  WHEN n >= 2 AND 5 * stamps >= 4 * n THEN ['log', '0.95'] WHEN n >= 2 AND (2 * stamps >= n OR 5 * levels >= 4 * n) THEN ['log', '0.8'] WHEN n >= 2 AND 2 * levels >= n THEN ['log', '0.65']
  WHEN words >= 3 AND mk >= 2 * sz THEN ['code', '0.95'] WHEN words >= 2 AND mk >= 3 * sz THEN ['code', '0.85'] WHEN words >= 3 THEN ['code', '0.75']
  WHEN words >= 1 AND mk >= 5 * sz AND 10 * indented >= 3 * n THEN ['code', '0.7'] ELSE ['prose', '0.4'] END AS f FROM j)"""
_CASE = lambda values: " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
_LNSQL = f"WITH {BLOCKS_SQL}, {_LN}"
_DEPTH = r"""list_max(list_prepend(0, list_transform(range(1, length(br) + 1), lambda i: length(regexp_replace(substr(br, 1, i), '[\]}]', '', 'g')) - length(regexp_replace(substr(br, 1, i), '[\[{]', '', 'g')))))"""
_LEVEL = f"""CASE WHEN score >= 3 THEN 'critical' WHEN t <> '' AND (score > 0 OR regexp_matches(t, '^(#|==|--)|:$')
 OR regexp_matches({_LOW.replace("(line", "(t")}, '^({"|".join(T.SUMMARY_STARTS)})')) THEN 'notable' ELSE 'routine' END"""
ANCHOR_SQL = r"""CASE WHEN starts_with(line, '@@') THEN 'hunk_header' WHEN starts_with(t, '```') THEN 'fence' WHEN regexp_matches(t, '^(#+ .+|={3,}|-{3,})$') THEN 'heading'
 WHEN starts_with(t, 'at ') OR starts_with(t, 'File "') OR regexp_matches(t, '[A-Za-z0-9_]\.[A-Za-z]+:[0-9]+') THEN 'stack_frame' WHEN regexp_matches(t, '[\[{(]$') THEN 'structure_open' WHEN line_no IN (0, n - 1) THEN 'boundary' END"""

QUERIES = {
    "token_estimate": q_token_estimate, "detect_content": q_detect, "route_blocks": q_route, "line_importance": q_line_importance, "line_anchors": q_line_anchors, "line_flags": q_line_flags,
    "protected_lines": q_protected_lines, "safety_hazards": q_hazards, "volatile_tokens": q_volatile_tokens, "policies": q_policies, "counters": q_counters,
}
ORACLES = {
    "token_estimate": f"WITH {BLOCKS_SQL}, {TOKENS_SQL} SELECT block_id, {_EST} AS tokens FROM measured",
    "detect_content": f"WITH {BLOCKS_SQL}, {DETECT_SQL} SELECT block_id, f[1] AS content_type, f[2]::DOUBLE AS confidence FROM det",
    "route_blocks": f"""WITH {BLOCKS_SQL}, {DETECT_SQL}, m AS (SELECT *, f[1] AS ct, ['payg', 'oauth', 'subscription'][(length(block_id) % 3 + 1)::INT] AS mode, CASE f[1] {_CASE(THRESHOLDS)} END AS gate FROM det),
 x AS (SELECT block_id, ct, CASE WHEN strlen(content) > 60000 OR len(string_split(content, chr(10))) > 400 THEN 'unsafe' WHEN mode = 'oauth' THEN 'lossless' WHEN mode = 'subscription' THEN 'policy_forbids'
  WHEN gate IS NULL OR (ct = 'prose' AND kind = 'text') THEN 'no_compressor' WHEN strlen(content) <= gate THEN 'below_size' WHEN ct = 'search' THEN 'measured_useless' ELSE 'compress' END AS reason FROM m)
 SELECT block_id, ct AS content_type, CASE reason WHEN 'lossless' THEN 'reformat' WHEN 'compress' THEN CASE ct {_CASE(TRANSFORMS)} END END AS transform, reason FROM x""",
    "line_importance": rf"""{_LNSQL}, s AS (SELECT block_id, line, {_STRIP("line")} AS t, {_SCORE} AS score FROM ln)
 SELECT block_id, {_LEVEL} AS importance, count(*) AS n_lines, sum(score)::BIGINT AS score FROM s GROUP BY 1, 2""",
    "line_anchors": rf"""{_LNSQL}, s AS (SELECT *, {_STRIP("line")} AS t FROM ln), a AS (SELECT block_id, line_no, {ANCHOR_SQL} AS anchor FROM s)
 SELECT block_id, anchor, count(*) AS n, min(line_no)::BIGINT AS first_line FROM a WHERE anchor IS NOT NULL GROUP BY 1, 2""",
    "line_flags": rf"""{_LNSQL}, s AS (SELECT *, {_STRIP("line")} AS t, {_SCORE} AS score, {_TAGS} AS tags FROM ln)
 SELECT block_id, count(*) FILTER (tags > 0) AS breaks_markup, count(*) FILTER (({ANCHOR_SQL}) IS NULL) AS removable, count(*) FILTER (score >= 3) AS is_error FROM s GROUP BY 1""",
    "protected_lines": rf"""WITH p AS (SELECT page_id, unnest(string_split(replace(html, '<', chr(10) || '<'), chr(10))) AS line FROM pages), t AS (SELECT page_id, {_TAGS} AS k FROM p)
 SELECT page_id, count(*) AS n_lines, sum((k > 0)::INT)::BIGINT AS n_protected, sum(k)::BIGINT AS n_tags FROM t GROUP BY 1""",
    "safety_hazards": rf"""WITH {BLOCKS_SQL}, s AS (SELECT block_id, content, string_split(content, chr(10)) AS rows_, regexp_replace(regexp_replace(content, '"(?:\\.|[^"\\])*"', '', 'g'), '[^\[\]{{}}]+', '', 'g') AS br FROM blocks)
 SELECT block_id, CASE WHEN strlen(content) > {TIGHT.max_bytes} THEN 'too_large' WHEN len(list_filter(rows_, lambda r: strlen(r) > {TIGHT.max_line})) > 0 THEN 'line_too_long'
 WHEN len(rows_) > {TIGHT.max_lines} THEN 'too_many_lines' WHEN regexp_matches(content, '^[{_WS}]*[\[{{]') AND {_DEPTH} > {TIGHT.max_depth} THEN 'too_deep' ELSE 'none' END AS hazard FROM s""",
    "volatile_tokens": rf"""WITH t AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[{_WS},;"]+')), '^[()\[\].]+|[()\[\].]+$', '', 'g') AS t FROM documents),
 k AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') THEN 'uuid' WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'timestamp'
  WHEN regexp_matches(t, '^[0-9A-Fa-f]{{16,}}$') THEN 'hex' END AS kind FROM t WHERE strlen(t) >= 8)
 SELECT DISTINCT doc_id, kind, CASE WHEN length(t) > 24 THEN substr(t, 1, 24) || '…' ELSE t END AS sample FROM k WHERE kind IS NOT NULL""",
    "policies": f"""SELECT * FROM (VALUES {", ".join(str((m, *p)) for m, p in POLICIES.items())}) t(mode, {", ".join(POLICY_COLUMNS)})""",
    "counters": """SELECT event_id, 'k' AS name, false AS counter FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'turn_no', true FROM events UNION ALL SELECT event_id, 'Sequence', false FROM events""",
}
