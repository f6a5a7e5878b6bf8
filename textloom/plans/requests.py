"""The whole request transform: bodies to blocks, live zone, routing by policy, digests, and bodies with only those blocks
changed; beside them the originals that the digests' markers name, and what each block came to."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.bodies import compressible, members, model_of, read_blocks
from ..operators.code import MODULE_SQL, code_digest, module_sources, part_sources
from ..operators.condense import _LOGD, _SEAD, log_digest, search_digest, summarise
from ..operators.conversation import call_arguments, frozen_floor, live_zone, request_query
from ..operators.diffs import _DIFF, diff_digest, order_diffs
from ..operators.jsonsets import DIGEST_SQL, LISTS_SQL, long_leaves, order_lists, records_of, with_leaves
from ..operators.records import _R, record_digest
from ..operators.shaping import reformat
from ..operators.signals import _EST, _LEVEL, _LN, _SCORE, _STRIP, _TAGS, ANCHOR_SQL, DETECT_SQL, THRESHOLDS, TOKENS_SQL, TRANSFORMS, Limits, route
from ..sources.io import settle
from . import registry
from ..sources.tables import block_lines, in_order, log_lines, read, search_texts


def rewrite(body: str, edits: list[tuple[int, int, str]]) -> str:
    """The body with the text of (message, block) replaced; messages without an edit keep their bytes.

    Messages are those of `messages` or of `input`. String content is block 0; of a content item the `content` member is
    replaced, or `text` where it has one; of an output item its `output`. A body that does not parse, or an edit that points
    nowhere, changes nothing.
    """
    own = dict(members(body) or ())
    name = "messages" if "messages" in own else "input"
    if not edits or not own.get(name, "").startswith("["):
        return body
    raw = own[name]
    dec, parts, i = json.JSONDecoder(), [], 1
    while raw[i:].lstrip()[:1] not in ("]", ""):
        i += len(raw[i:]) - len(raw[i:].lstrip(" \t\r\n,"))
        _, end = dec.raw_decode(raw, i)
        parts.append((i, end))
        i = end
    out, pos = [], 0
    for n, (s, e) in enumerate(parts):
        mine = {b: t for m, b, t in edits if m == n}
        out.append(raw[pos:s])
        out.append(_message(raw[s:e], mine) if mine else raw[s:e])
        pos = e
    new = "".join([*out, raw[pos:]])
    at = body.index(raw, body.index(f'"{name}"'))
    return body[:at] + new + body[at + len(raw) :]


def _message(raw: str, edits: dict[int, str]) -> str:
    msg = json.loads(raw)
    content = msg.get("content")
    if isinstance(msg.get("output"), str):
        msg["output"] = edits.get(0, msg["output"])
    elif isinstance(content, str):
        msg["content"] = edits.get(0, content)
    elif isinstance(content, list):
        for b, text in edits.items():
            if b < len(content) and isinstance(content[b], dict):
                content[b]["text" if isinstance(content[b].get("text"), str) else "content"] = text
    return json.dumps(msg, ensure_ascii=False, separators=(",", ":"))


def digests(typed: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """block_id, digest of blocks by their `transform`, worked out by the transform registered under that name; null digests
    are left out.

    typed: block_id, content, transform. queries: block_id, query; records and lines that answer it are kept.
    """
    whole = None
    for t in registry.transforms():
        own = t.apply(typed.where(F.col("transform") == t.name).select("block_id", "content"), queries).toDF("block_id", "digest")
        whole = own if whole is None else whole.unionByName(own)
    return whole.where("digest IS NOT NULL")


def _by_lines(digest):
    """A transform over lines (doc_id, line_no, line) as one over blocks."""
    return lambda b, queries: digest(block_lines(b).drop("n").withColumnRenamed("block_id", "doc_id"))


def _records(b: DataFrame, queries: DataFrame | None) -> DataFrame:
    return record_digest(records_of(b), None if queries is None else queries.select(F.col("block_id").alias("doc_id"), "query"))


for _name, _apply in (
    ("log_digest", _by_lines(log_digest)), ("search_digest", _by_lines(search_digest)), ("diff_digest", _by_lines(diff_digest)), ("code_digest", lambda b, queries: code_digest(b)),
    ("prose_summary", lambda b, queries: summarise(b, queries=queries)), ("record_set", _records),
):
    registry.register_transform(registry.BlockTransform(_name, lossy=True, apply=_apply))
registry.register_transform(registry.BlockTransform("reformat", lossy=False, apply=lambda b, queries: b.select("block_id", reformat(F.col("content")).alias("digest"))))


def shrunk_leaves(sets: DataFrame, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON blocks whose long prose leaves are summarised in place, and the originals of these leaves.

    (block_id, content), (hash, content). Leaves of other kinds, and those a summary would not shorten, stay.
    """
    from ..operators.signals import detect

    leaves = long_leaves(sets)
    named = leaves.withColumn("leaf_id", F.concat_ws("#", "block_id", F.col("leaf").cast("string")))
    prose = settle(detect(named).where("content_type = 'prose'").select("block_id", "leaf", "leaf_id", "content"), "leaves")
    asked = None if queries is None else prose.join(queries, "block_id").select(F.col("leaf_id").alias("block_id"), "query")
    short = summarise(prose.select(F.col("leaf_id").alias("block_id"), "content"), queries=asked)
    j = prose.join(short.withColumnRenamed("block_id", "leaf_id"), "leaf_id").withColumn("text", _marked("digest", "content"))
    j = j.where(T.estimated_tokens(F.col("text")) < T.estimated_tokens(F.col("content")))
    return with_leaves(sets, j.select("block_id", "leaf", "text")), j.select(T.content_hash(F.col("content")).alias("hash"), "content")


def _marked(digest: str, content: str):
    """A digest with the marker of the original at its end."""
    return F.concat(F.col(digest), F.lit("\nfull content: "), T.marker(F.col(content)))


@dataclass
class Condensed:
    """bodies: request_id, body, edits; originals: hash, content; outcomes: one row for each live block (request_id, msg_idx,
    block_idx, mode, family, content_type, reason, outcome, tokens_before, tokens_after)."""

    bodies: DataFrame
    originals: DataFrame
    outcomes: DataFrame


def condense_requests(requests: DataFrame, dialect: str = "messages", recommended: DataFrame | None = None, limits: Limits = Limits()) -> Condensed:
    """Requests with their live blocks condensed as their mode allows.

    requests: request_id, body, mode. Only blocks of kinds that may change, above the frozen floor and newest of their kind
    are looked at; each is routed (see signals.route), digested with the conversation's query in view or, under a mode that
    allows no loss, reformatted; and changed only if its estimate shrinks. Every marker in the bodies names a row of
    originals. Bodies that are not understood, null ones, and requests without such blocks come back as they are.
    """
    requests = settle(requests, "requests")  # read for its blocks, its models, its calls, and to be rewritten
    b = read_blocks(requests, dialect).join(requests.select("request_id", "mode", T.model_family(model_of(F.col("body"))).alias("family")), "request_id")
    b = settle(b, "blocks")
    category = F.when(F.col("kind") == "text", "text").otherwise("tool_result")
    m = b.select("request_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", category.alias("category"), F.coalesce("content", F.lit("")).alias("text"), "marked")
    calls = call_arguments(requests, dialect)
    live = live_zone(m.dropDuplicates(["request_id", "msg_idx", "category"]), frozen_floor(m, dialect)).select("request_id", F.col("msg_idx").cast("int").alias("msg_idx"), "category")
    name = F.concat_ws("/", F.col("request_id").cast("string"), "msg_idx", "block_idx").alias("block_id")
    own = compressible(b.where("content IS NOT NULL")).withColumn("category", category).join(live, ["request_id", "msg_idx", "category"], "left_semi")
    own = own.select(name, "request_id", "msg_idx", "block_idx", "kind", "content", "mode", "family")
    typed = settle(route(own, recommended, limits), "typed")
    queries = settle(typed.select("block_id", "request_id").join(request_query(m, calls), "request_id").select("block_id", "query"), "queries")

    sets = typed.where("transform = 'record_set'").select("block_id", "content")
    reduced, leaf_originals = shrunk_leaves(sets, queries)
    made = settle(digests(typed, queries), "digests")
    lossy = F.col("transform").isin(*[t.name for t in registry.transforms() if t.lossy])
    marked = typed.join(made, "block_id").select("block_id", F.when(lossy, _marked("digest", "content")).otherwise(F.col("digest")).alias("text"), lossy.alias("lossy"))
    # where the records themselves do not condense, the document with shorter leaves may do
    leafy = reduced.join(made, "block_id", "left_anti").join(typed.select("block_id", F.col("content").alias("whole")), "block_id").select("block_id", F.col("content").alias("text"))
    offered = marked.unionByName(leafy.withColumn("lossy", F.lit(True)))

    before, after = T.estimated_tokens(F.col("content")), T.estimated_tokens(F.col("text"))
    judged = typed.join(offered, "block_id", "left").withColumns({"tokens_before": before, "offered": after})
    smaller = F.coalesce(F.col("offered") < F.col("tokens_before"), F.lit(False))
    outcome = F.when(F.col("transform").isNull(), "passed").when(F.col("text").isNull(), "declined").when(smaller, "compressed").otherwise("not_smaller")
    judged = settle(judged.withColumns({"outcome": outcome, "tokens_after": F.when(smaller, F.col("offered")).otherwise(F.col("tokens_before"))}), "judged")

    done = judged.where("outcome = 'compressed'")
    edits = done.groupBy("request_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("msg_idx", "block_idx", "text")))).alias("edits"))

    @F.pandas_udf("string")
    def apply(body: pd.Series, edit: pd.Series) -> pd.Series:
        new = [b if b is None or e is None else rewrite(b, [(x["msg_idx"], x["block_idx"], x["text"]) for x in json.loads(e)]) for b, e in zip(body, edit, strict=True)]
        return pd.Series(new, dtype=object)

    j = requests.join(edits, "request_id", "left")
    bodies = j.select("request_id", apply("body", "edits").alias("body"), F.coalesce(F.expr("json_array_length(edits)"), F.lit(0)).alias("edits"))
    kept = done.where("lossy").select(T.content_hash(F.col("content")).alias("hash"), "content")
    originals = kept.unionByName(leaf_originals).dropDuplicates(["hash"])
    outcomes = judged.select("request_id", "msg_idx", "block_idx", "mode", "family", "content_type", "reason", "outcome", "tokens_before", "tokens_after")
    return Condensed(bodies, originals, outcomes)


MODES = ("payg", "payg", "oauth", "subscription")


#: Content types of `typed_blocks`, by number.
TYPES = ("log", "search", "json", "code", "diff", "prose")


def typed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, k, content: a log of each user, each document's search hits, record lists of customers, modules of parts, diffs
    of suppliers and each document with a line for each sentence; k: the number of its type."""
    whole = lambda ln: ln.groupBy("doc_id").agg(in_order(F.col("line"), F.col("line_no")).alias("content"))
    named = lambda df: df.select(F.col("block_id").alias("doc_id"), "content")
    prose = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("content"))
    every = (whole(log_lines(spark, d)), search_texts(spark, d), named(order_lists(spark, d)), named(module_sources(spark, d)), whole(order_diffs(spark, d)), prose)
    out = None
    for k, own in enumerate(every):
        own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(k).alias("k"), "content")
        out = own if out is None else out.unionByName(own)
    return out


def typed_requests(spark: SparkSession, d: str) -> DataFrame:
    """request_id, body, mode: a question about a block of any type; the same text once below a cache mark and once in the
    live zone. Modes in turn."""
    t = typed_blocks(spark, d).withColumnRenamed("content", "c")
    msg = lambda role, content: F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")))
    tool = F.array(F.struct(F.lit("tool_result").alias("type"), F.col("c").alias("content")))
    old = F.array(F.struct(F.lit("tool_result").alias("type"), F.col("c").alias("content"), F.struct(F.lit("ephemeral").alias("type")).alias("cache_control")))
    body = F.concat(F.lit('{"model": "m-1", "messages": ['), msg("user", F.lit("what is it?")), F.lit(" , "), msg("user", old), F.lit(","), msg("assistant", F.lit("looking")), F.lit(","), msg("user", tool), F.lit('], "stream" : true}'))
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.pmod(F.col("doc_id"), F.lit(len(MODES))) + 1).cast("int"))
    return t.select((F.col("doc_id") * len(TYPES) + F.col("k")).alias("request_id"), body.alias("body"), mode.alias("mode"))


def q_condense_requests(spark: SparkSession, d: str) -> DataFrame:
    """What each request's blocks hold after the transform."""
    after = read_blocks(condense_requests(typed_requests(spark, d)).bodies.drop("edits"))
    return after.select("request_id", "msg_idx", "kind", F.sha2("content", 256).alias("sha"))


def q_condense_originals(spark: SparkSession, d: str) -> DataFrame:
    """The originals that the markers in condensed requests name."""
    return condense_requests(typed_requests(spark, d)).originals


def q_condense_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Live blocks by mode, type, reason and outcome, with their tokens."""
    o = condense_requests(typed_requests(spark, d)).outcomes
    return o.groupBy("mode", "content_type", "reason", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))


def q_code_requests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of code blocks by size and language gates, as the transform routes them."""
    src = part_sources(spark, d).select(F.col("block_id").cast("string").alias("block_id"), "content").withColumns({"kind": F.lit("tool_result"), "mode": F.lit("payg")})
    typed = route(src)
    return typed.groupBy("content_type", "reason").agg(F.count(F.lit(1)).alias("n"))


_MODE = "['" + "', '".join(MODES) + "'][doc_id % 4 + 1]"
#: Digests of prose with the question in view: its words in a line, lines in their order, what the question asks for kept.
_PROSE = rf"""WITH blocks AS (SELECT doc_id AS block_id, replace(text, '. ', '.' || chr(10)) AS content FROM documents WHERE text IS NOT NULL), {_LN},
 it AS (SELECT block_id, line_no, list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM ln WHERE n > 60), tot AS (SELECT block_id, count(*) AS n, avg(len(t)) AS a FROM it GROUP BY 1),
 tf AS (SELECT block_id, line_no, len(t) AS l, w.term, len(list_filter(t, lambda x: x = w.term)) AS tf FROM it, (VALUES ('what'), ('is'), ('it')) w(term)), dfr AS (SELECT block_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1, 2),
 sc AS (SELECT block_id, line_no, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN dfr USING (block_id, term) JOIN tot USING (block_id) WHERE tf > 0 GROUP BY 1, 2),
 an AS (SELECT block_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY round(score, 9) DESC, line_no) AS p FROM sc WHERE score >= 0.5) WHERE p <= 10),
 l1 AS (SELECT ln.*, an.line_no IS NOT NULL AS asked, {_STRIP("line")} AS t, {_SCORE} AS score FROM ln LEFT JOIN an USING (block_id, line_no) WHERE n > 60),
 l2 AS (SELECT *, asked OR ({ANCHOR_SQL}) IS NOT NULL OR {_TAGS} > 0 AS req, CASE {_LEVEL} WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END AS lv FROM l1),
 l3 AS (SELECT *, sum(req::INT) OVER (PARTITION BY block_id) AS must, row_number() OVER (PARTITION BY block_id ORDER BY req DESC, lv DESC, line_no) AS r FROM l2),
 l4 AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY block_id ORDER BY line_no) - 1 AS gap FROM l3 WHERE r <= greatest(60, must))
 SELECT block_id AS doc_id, '[' || max(n) || ' lines, ' || count(*) || ' shown]' || chr(10) || string_agg(CASE WHEN gap > 0 THEN '... ' || gap || ' lines ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY line_no) AS digest FROM l4 GROUP BY 1"""
_DIFFS = f"""WITH {_DIFF}, x AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no, text) AS digest FROM t GROUP BY 1), dr AS (SELECT doc_id, bool_or(NOT keep) AS dropped FROM r GROUP BY 1), w AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM ln GROUP BY 1)
 SELECT doc_id, content, CASE WHEN dropped THEN digest END AS digest FROM x JOIN dr USING (doc_id) JOIN w USING (doc_id)"""
_DIGESTED = f"""{_LOGD}, {_SEAD}, {_R}, {LISTS_SQL}, {DIGEST_SQL}, mods AS MATERIALIZED ({MODULE_SQL}), dfs AS MATERIALIZED ({_DIFFS}), prs AS MATERIALIZED ({_PROSE}),
 tx0 AS (SELECT doc_id, 0 AS k, string_agg(line, chr(10) ORDER BY line_no) AS content FROM log_lines GROUP BY 1 UNION ALL SELECT doc_id, 1, string_agg(line, chr(10) ORDER BY line_no) FROM search_lines GROUP BY 1
  UNION ALL SELECT doc_id, 2, content FROM lists UNION ALL SELECT block_id, 3, content FROM mods UNION ALL SELECT doc_id, 4, content FROM dfs UNION ALL SELECT doc_id, 5, replace(text, '. ', '.' || chr(10)) FROM documents WHERE text IS NOT NULL),
 dg0 AS (SELECT doc_id, 0 AS k, digest FROM logd UNION ALL SELECT doc_id, 1, digest FROM sead UNION ALL SELECT recd.doc_id, 2, digest FROM recd JOIN n USING (doc_id) WHERE records >= 2
  UNION ALL SELECT block_id, 3, digest FROM mods UNION ALL SELECT doc_id, 4, digest FROM dfs UNION ALL SELECT doc_id, 5, digest FROM prs)"""
_TYPE = "['" + "', '".join(TYPES) + f"'][(block_id % {len(TYPES)} + 1)::INT]"


def transform_sql(last: str, mode: str = _MODE) -> str:
    """Blocks whose type detection finds to be what they were made as; the rest of their kinds declines or is too short."""
    gate = " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())
    return f"""WITH {_DIGESTED}, blocks AS (SELECT doc_id * {len(TYPES)} + k AS block_id, 'tool_result' AS kind, content FROM tx0), dt AS (WITH {DETECT_SQL} SELECT * FROM det),
 rt AS (SELECT dt.block_id, dt.content, doc_id, k, f[1] AS ct, digest, {mode} AS mode FROM dt JOIN tx0 ON tx0.doc_id * {len(TYPES)} + tx0.k = dt.block_id LEFT JOIN dg0 USING (doc_id, k)),
 rr AS (SELECT *, CASE WHEN mode = 'oauth' THEN 'lossless' WHEN mode = 'subscription' THEN 'policy_forbids' WHEN ct = 'unknown' THEN 'no_compressor' WHEN strlen(content) <= CASE ct {gate} ELSE 1e18 END THEN 'below_size' ELSE 'compress' END AS reason FROM rt),
 mk AS (SELECT block_id, CASE WHEN reason = 'compress' AND ct = {_TYPE} THEN digest || chr(10) || 'full content: <<ccr:' || left(sha256(content), 32) || '>>' END AS text FROM rr),
 t1 AS (WITH blocks AS (SELECT block_id, content FROM rr), {TOKENS_SQL} SELECT block_id, {_EST} AS tokens_before FROM measured), t2 AS (WITH blocks AS (SELECT block_id, text AS content FROM mk WHERE text IS NOT NULL), {TOKENS_SQL} SELECT block_id, {_EST} AS offered FROM measured),
 jd AS (SELECT rr.*, text, tokens_before, CASE WHEN reason NOT IN ('compress', 'lossless') THEN 'passed' WHEN text IS NULL THEN 'declined' WHEN offered < tokens_before THEN 'compressed' ELSE 'not_smaller' END AS outcome,
  CASE WHEN offered < tokens_before THEN offered ELSE tokens_before END AS tokens_after FROM rr JOIN mk USING (block_id) JOIN t1 USING (block_id) LEFT JOIN t2 USING (block_id)) {last}"""


_EXPECTED = "CASE " + _TYPE + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRANSFORMS.items()) + " END"
_ROUTED = "CASE WHEN reason = 'compress' THEN CASE ct " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRANSFORMS.items()) + " END END"
QUERIES = {"condense_requests": q_condense_requests, "condense_originals": q_condense_originals, "condense_outcomes": q_condense_outcomes, "code_requests": q_code_requests}
ORACLES = {
    "condense_requests": transform_sql("""SELECT block_id AS request_id, 0 AS msg_idx, 'text' AS kind, sha256('what is it?') AS sha FROM jd UNION ALL SELECT block_id, 1, 'tool_result', sha256(content) FROM jd
 UNION ALL SELECT block_id, 2, 'text', sha256('looking') FROM jd UNION ALL SELECT block_id, 3, 'tool_result', sha256(CASE WHEN outcome = 'compressed' THEN text ELSE content END) FROM jd"""),
    "condense_originals": transform_sql("SELECT DISTINCT left(sha256(content), 32) AS hash, content FROM jd WHERE outcome = 'compressed'"),
    "condense_outcomes": transform_sql("SELECT mode, ct AS content_type, reason, outcome, count(*) AS n, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after FROM jd GROUP BY 1, 2, 3, 4"),
    "code_requests": f"""WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS py, i, (i * 3 + p_partkey) % 9 AS m FROM part, range(1, 7) t(i) WHERE i <= p_size % 6 + 1),
 blocks AS (SELECT p_partkey AS block_id, 'tool_result' AS kind, CASE WHEN py THEN 'import x' ELSE 'var a int' END || chr(10) || string_agg(CASE WHEN py THEN 'def f' || i || '():' || chr(10) || repeat('    y = 1' || chr(10), m)
  ELSE 'func f' || i || '() {{' || chr(10) || repeat(chr(9) || 'y := nil' || chr(10), m) || '}}' || chr(10) END, chr(10) ORDER BY i) AS content FROM f GROUP BY p_partkey, py), {DETECT_SQL}
 SELECT f[1] AS content_type, CASE WHEN f[1] = 'unknown' THEN 'no_compressor' WHEN strlen(content) <= CASE f[1] {" ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())} END THEN 'below_size' ELSE 'compress' END AS reason, count(*) AS n FROM det GROUP BY 1, 2""",
}
#: What `reports.parity` finds of every typed block, without a question in view.
PARITY_SQL = transform_sql(
    f"""SELECT content_type, CASE WHEN detail IS NULL THEN 'covered' ELSE 'failed' END AS outcome, detail, count(*) AS n FROM (SELECT {_TYPE} AS content_type,
 CASE WHEN {_ROUTED} IS NULL THEN 'nothing routed to it; expected ' || {_EXPECTED} WHEN {_ROUTED} <> {_EXPECTED} THEN 'routed to ' || {_ROUTED} || ' rather than ' || {_EXPECTED} WHEN digest IS NULL THEN {_EXPECTED} || ' declined'
 WHEN strlen(digest) >= strlen(content) THEN 'did not shrink' END AS detail FROM rr WHERE k <> 5) GROUP BY 1, 2, 3""", "'payg'"
)
