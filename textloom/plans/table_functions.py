"""Table functions over single blocks, for SQL: what a block is and what each kind of authentication lets be done with it.

`condense_block(content, kind, auth)` gives one row for a block, beside the block by LATERAL. `condense_budget(TABLE(t)
PARTITION BY …)` sees all blocks of a partition, and gives one row for each reason. Both count with the patterns and judge by
the rules of the column form (operators.signals).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import sql
from ..functions import text as T
from ..operators.signals import _EST, BRACKETS, DETECT_SQL, DIFF_PATTERNS, LINE_PATTERNS, NEEDED, PROSE, STAGES, THRESHOLDS, TOKENS_SQL, TOOL_OUTPUT_ONLY, TRANSFORMS, UNKNOWN, POLICIES, Limits
from ..sources.tables import BLOCKS_SQL, blocks

_struct = lambda **fields: StructType([StructField(k, t) for k, t in fields.items()])
BLOCK = _struct(content_type=StringType(), confidence=DoubleType(), threshold=IntegerType(), transform=StringType(), reason=StringType())
BUDGET = _struct(reason=StringType(), blocks=LongType(), bytes=LongType(), largest=LongType())

_here = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", p).replace("(?md)", "(?m)"))
_COUNTED = {k: _here(p) for k, p in LINE_PATTERNS.items()}
_LOOKED_FOR = {k: _here(p) for k, p in DIFF_PATTERNS.items()}
_BRACKETS = re.compile(BRACKETS)
_RULES = [(names, [(name, score, compile(condition, name, "eval")) for name, score, condition in rules]) for names, rules in STAGES]


#: JSON nested deeper than this is not read as JSON (the built-in reader's own limit).
DEEPEST = 999


def depth(t: str) -> int:
    """Greatest depth of [ and { outside strings."""
    now = most = 0
    for run in re.findall(r"[\[{]+|[\]}]+", re.sub(r'"[^"\x00-\x1F]*"', "", re.sub(r"(?s)\\.", "", t))):
        now += len(run) if run[0] in "[{" else -len(run)
        most = max(most, now)
    return most


def unsafe(content: str, limits: Limits = Limits()) -> bool:
    """Whether a text breaks one of the limits of signals.hazard."""
    rows = content.split("\n")
    if len(content.encode()) > limits.max_bytes or max(len(r.encode()) for r in rows) > limits.max_line or len(rows) > limits.max_lines:
        return True
    return content.lstrip(T.WS_CHARS)[:1] in ("[", "{") and depth(content) > limits.max_depth


def _refuse(name: str) -> None:
    raise ValueError(name)


def _is_json(t: str) -> bool:
    if t[:1] + t[-1:] not in ("{}", "[]") or depth(t) > DEEPEST:
        return False
    try:
        json.loads(t, parse_constant=_refuse, parse_int=len, parse_float=len)
    except (ValueError, RecursionError):
        return False
    return True


def _count(name: str, t: str):
    if name in NEEDED and not any(w in t for w in NEEDED[name]):
        return 0 if name in _COUNTED else False
    if name in _COUNTED:
        return sum(1 for _ in _COUNTED[name].finditer(t))
    if name in _LOOKED_FOR:
        return _LOOKED_FOR[name].search(t) is not None
    if name == "json":
        return _is_json(t)
    if name == "words":
        return sum(w in t for w in T.CODE_WORDS)
    return len(t.encode()) if name == "size" else 100 * (len(t) - len(_BRACKETS.sub("", t)))


def what(content: str | None) -> tuple[str, float]:
    """Content type and confidence of a block."""
    t = (content or "").strip(T.WS_CHARS)
    if not t:
        return UNKNOWN
    known: dict = {}
    for names, rules in _RULES:
        known |= {n: _count(n, t) for n in names}
        for name, score, condition in rules:
            if eval(condition, {}, known):  # a rule of STAGES
                return name, score
    return PROSE


@lru_cache(maxsize=1)
def _looked_at(content: str | None) -> tuple[str, float, bool, int]:
    """Content type, confidence, whether a limit is broken, bytes; of a text that comes again next, as under another kind of
    authentication, only once."""
    return (*what(content), unsafe(content or ""), len((content or "").encode()))


def block_row(content: str | None, kind: str | None, auth: str | None) -> tuple:
    """content_type, confidence, threshold, transform, reason; the reasons of signals.route."""
    name, score, broken, size = _looked_at(content)
    _, lossy, lossless = ("", *POLICIES[auth][:2]) if auth in POLICIES else ("", False, False)
    gate = THRESHOLDS.get(name)
    if broken:
        reason = "unsafe"
    elif not lossy:
        reason = "lossless" if lossless else "policy_forbids"
    elif name not in TRANSFORMS or (name in TOOL_OUTPUT_ONLY and kind == "text"):
        reason = "no_compressor"
    else:
        reason = "below_size" if size <= gate else "compress"
    return name, score, gate, {"compress": TRANSFORMS.get(name), "lossless": "reformat"}.get(reason), reason


def _texts(arguments: dict[str, AnalyzeArgument]) -> None:
    for name, a in arguments.items():
        if a.isTable or not isinstance(a.dataType, StringType):
            raise ValueError(f"condense_block: {name} is to be a string")
    auth = arguments["auth"]
    if auth.isConstantExpression and auth.value is not None and auth.value not in POLICIES:
        raise ValueError(f"condense_block: auth is to be one of {', '.join(POLICIES)}, not {auth.value}")


class CondenseBlock:
    """One row for a block. A constant auth that is no known mode is an error of the query; one in the data allows nothing."""

    @staticmethod
    def analyze(content: AnalyzeArgument, kind: AnalyzeArgument, auth: AnalyzeArgument) -> AnalyzeResult:
        _texts({"content": content, "kind": kind, "auth": auth})
        return AnalyzeResult(BLOCK)

    def eval(self, content, kind, auth):
        yield block_row(content, kind, auth)


class CondenseBudget:
    """One row a reason for the blocks of a partition (content, kind, auth, and the columns it is partitioned by, which come
    first in the result): how many, their bytes, and the bytes of the largest."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("condense_budget: it takes a table")
        names = [f.name for f in rows.dataType.fields]
        if missing := [c for c in ("content", "kind", "auth") if c not in names]:
            raise ValueError(f"condense_budget: the table has no column {', '.join(missing)}")
        schema = StructType([f for f in rows.dataType.fields if f.name not in ("content", "kind", "auth")])
        for f in BUDGET.fields:
            schema = schema.add(f)
        return AnalyzeResult(schema)

    def __init__(self):
        self.key, self.sums = (), {}

    def eval(self, rows):
        self.key = tuple(v for k, v in rows.asDict().items() if k not in ("content", "kind", "auth"))
        n, size, most = self.sums.get(reason := block_row(rows["content"], rows["kind"], rows["auth"])[-1], (0, 0, 0))
        own = len((rows["content"] or "").encode())
        self.sums[reason] = (n + 1, size + own, max(most, own))

    def terminate(self):
        for reason, sums in sorted(self.sums.items()):
            yield (*self.key, reason, *sums)


def register(spark: SparkSession) -> list[str]:
    """Create the SQL and table functions in the session; returns their names."""
    functions = {"condense_block": CondenseBlock, "condense_budget": CondenseBudget}
    for name, f in functions.items():
        spark.udtf.register(name, F.udtf(f))
    return sorted([*sql.register(spark), *functions])


def q_condense_block(spark: SparkSession, d: str) -> DataFrame:
    """Every block under each kind of authentication, in SQL text."""
    register(spark)
    blocks(spark, d).createOrReplaceTempView("textloom_blocks")
    return spark.sql("""
        SELECT block_id, auth, octet_length(content) AS bytes, condense_tokens(content) AS tokens, condense_detect(content) AS detected, f.*
        FROM textloom_blocks, LATERAL explode(array('payg', 'oauth', 'subscription')) m(auth), LATERAL condense_block(content, kind, auth) f""")


def q_condense_budget(spark: SparkSession, d: str) -> DataFrame:
    """What may be done with the blocks of each source, a partition for each source and seventh of its blocks."""
    register(spark)
    blocks(spark, d).createOrReplaceTempView("textloom_blocks")
    return spark.sql("""
        SELECT source, slot, reason, blocks, bytes, largest FROM condense_budget(TABLE(
            SELECT substring_index(block_id, '-', 1) AS source, cast(pmod(length(content), 7) AS int) AS slot, content, kind, 'payg' AS auth FROM textloom_blocks) PARTITION BY (source, slot))""")


_GATE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())
_CASES = f"""bl AS (SELECT block_id, strlen(det.content) AS bytes, det.content, kind, f[1] AS content_type, f[2]::DOUBLE AS confidence, CASE f[1] {_GATE} END::INT AS threshold FROM det),
 au AS (SELECT unnest(['payg', 'oauth', 'subscription']) AS auth),
 rs AS (SELECT *, CASE WHEN auth = 'oauth' THEN 'lossless' WHEN auth = 'subscription' THEN 'policy_forbids' WHEN threshold IS NULL OR (content_type = 'prose' AND kind = 'text') THEN 'no_compressor'
  WHEN coalesce(bytes, 0) <= threshold THEN 'below_size' ELSE 'compress' END AS reason FROM bl, au)"""
QUERIES = {"condense_block": q_condense_block, "condense_budget": q_condense_budget}
ORACLES = {
    "condense_block": f"""WITH {BLOCKS_SQL}, {DETECT_SQL}, {TOKENS_SQL}, {_CASES}
 SELECT block_id, auth, bytes, {_EST.replace("content", "measured.content")} AS tokens, content_type AS detected, content_type, confidence, threshold,
 CASE reason WHEN 'lossless' THEN 'reformat' WHEN 'compress' THEN CASE content_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRANSFORMS.items())} END END AS transform, reason FROM rs JOIN measured USING (block_id)""",
    "condense_budget": f"""WITH {BLOCKS_SQL}, {DETECT_SQL}, {_CASES} SELECT string_split(block_id, '-')[1] AS source, (length(content) % 7)::INT AS slot, reason, count(*) AS blocks, sum(coalesce(bytes, 0))::BIGINT AS bytes,
 max(coalesce(bytes, 0)) AS largest FROM rs WHERE auth = 'payg' GROUP BY 1, 2, 3""",
}
