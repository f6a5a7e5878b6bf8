"""Request bodies, JSON text, headers, scalar helpers: parsing into blocks and edits that keep untouched bytes."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import BLOCKS_SQL, blocks, in_order, read

# Block kinds that are sacrosanct, compressible, and tool output; hop-by-hop headers.
BLOCK_KINDS = {
    "text": (False, True, False), "tool_result": (False, True, True), "function_call_output": (False, True, True), "local_shell_call_output": (False, True, True), "apply_patch_call_output": (False, True, True), "tool_use": (False, False, False),
    "thinking": (True, False, False), "redacted_thinking": (True, False, False), "reasoning": (True, False, False), "compaction": (True, False, False), "attachment": (True, False, False),
}
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
FORWARDED = ("x-forwarded-for", "x-forwarded-host", "x-forwarded-proto")
FNV_BASIS, FNV_PRIME, SHAPE_DEPTH = 0xCBF29CE484222325, 0x100000001B3, 8

_SPACE = " \t\r\n"


def members(body: str) -> list[tuple[str, str]] | None:
    """(key, raw value text) of a JSON object's top-level members, in order; None if it is no JSON object."""
    dec = json.JSONDecoder()
    skip = lambda i: i + len(body[i:]) - len(body[i:].lstrip(_SPACE)) if body[i : i + 1] in _SPACE else i
    try:
        i, out = skip(0), []
        if body[i] != "{":
            return None
        i = skip(i + 1)
        while body[i] != "}":
            key, i = dec.raw_decode(body, i)
            i = skip(i)
            if body[i] != ":" or not isinstance(key, str):
                return None
            start = skip(i + 1)
            _, i = dec.raw_decode(body, start)
            out.append((key, body[start:i]))
            i = skip(i)
            if body[i] == ",":
                i = skip(i + 1)
                if body[i] != '"':
                    return None
        return out if not body[i + 1 :].strip(_SPACE) else None
    except (ValueError, IndexError, RecursionError):
        return None


def set_member(body: str, key: str, raw: str, replace: bool) -> str:
    """The body with a member put in front if absent (replace: its value changed if present); other bytes stay."""
    own = members(body)
    if own is None or (key in dict(own)) != replace:
        return body
    if not replace:
        at = body.index("{") + 1
        return f"{body[:at]}{json.dumps(key)}:{raw}{',' if own else ''}{body[at:]}"
    pos = 0
    for k, v in own:
        pos = body.index(v, body.index(":", body.index(json.dumps(k)[1:-1], pos))) if v else pos
        if k == key:
            return body[:pos] + raw + body[pos + len(v) :]
        pos += len(v)
    return body


def sort_keys(text: str) -> str:
    """JSON with every object's keys sorted; number literals as written."""
    lit = type("Literal", (float,), {"__repr__": lambda s: s.text})

    def number(t: str):
        n = lit(0)
        n.text = t
        return n

    def show(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(show, v)) + "]"
        return v.text if isinstance(v, lit) else json.dumps(v, ensure_ascii=False)

    try:
        return show(json.loads(text, parse_int=number, parse_float=number))
    except (ValueError, RecursionError):
        return text


def shape(v, depth: int = 0) -> str:
    """A value's structure: types, sorted keys, the first element of arrays."""
    if depth >= SHAPE_DEPTH:
        return "…"
    if isinstance(v, dict):
        return "{" + "".join(f"{k}:{shape(v[k], depth + 1)}," for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + (shape(v[0], depth + 1) if v else "") + "]"
    return "n" if v is None else "b" if isinstance(v, bool) else "s" if isinstance(v, str) else "#"


def fnv1a(data: bytes) -> str:
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def structure_hash(text: str, content_type: str) -> str:
    try:
        return fnv1a(shape(json.loads(text)).encode())
    except (ValueError, RecursionError):
        return fnv1a(content_type.encode())


def _udf(fn, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else fn(v))

    return run


def structure_hashes(df: DataFrame, text: str, content_type: str) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([structure_hash(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run(F.col(text), F.col(content_type))


@functools.lru_cache(maxsize=4)
def _counting(vocab: str):
    """Encoder of a rank file, read once by each of Python's processes rather than in each task."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocab if "/" in vocab else public_tokenizers.path(f"{vocab}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def exact_tokens(vocab: str = "byte_bpe_50k"):
    """Column -> Column: exact token count under a public rank file, by name or path."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _counting(vocab)
        for s in batches:
            yield s.map(lambda v: None if v is None else len(enc.encode_ordinary(v)))

    return run


# --- request bodies as Column expressions ------------------------------------------------------------------------------

# What a Responses item of output carries.
OUTPUT_ITEMS = ("function_call_output", "local_shell_call_output", "apply_patch_call_output")


def understood(body: Column) -> Column:
    """The body is a JSON object with exactly one of `messages` and `input`; false for null."""
    keys = F.json_object_keys(body)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return T.is_json(body) & F.startswith(T.strip(body), F.lit("{")) & (has("messages") != has("input"))


def insert_member(body: Column, key: str, raw: Column) -> Column:
    """The body with a member put in front; as it is where the key is there, raw is null, or it is no JSON object."""
    keys = F.json_object_keys(body)
    at = F.instr(body, "{")
    comma = F.when(F.size(keys) > 0, ",").otherwise("")
    put = F.concat(F.substring(body, F.lit(1), at), F.lit(json.dumps(key) + ":"), raw, comma, F.substring(body, at + 1, F.length(body)))
    return F.when(T.is_json(body) & keys.isNotNull() & ~F.array_contains(keys, key) & raw.isNotNull(), put).otherwise(body)


def raw_messages(body: Column) -> Column:
    """The messages (or input items) of a body, each as its JSON text."""
    return F.from_json(F.coalesce(F.get_json_object(body, "$.messages"), F.get_json_object(body, "$.input")), "array<string>")


def cache_key(body: Column) -> Column:
    """32 hex digits that name all but the newest message; null for fewer than two messages or a body not understood."""
    m = raw_messages(body)
    return F.when(understood(body) & (F.size(m) >= 2), T.content_hash(F.array_join(F.slice(m, F.lit(1), F.size(m) - 1), "")))


def model_of(body: Column) -> Column:
    """Text of the first "model" member written in a body; null if there is none. Names with escapes are not read."""
    m = F.regexp_extract(body, r'"model"\s*+:\s*+"([^"\\]*+)"', 1)
    return F.when(m != "", m)


def minify_json(c: Column) -> Column:
    """White space outside strings dropped, for text that parses as JSON; other text as it is."""
    return F.when(T.is_json(c), T.outside_strings(c, lambda p: F.regexp_replace(p, r"[ \t\r\n]+", ""))).otherwise(c)


def auth_mode(headers: Column) -> Column:
    """payg, oauth or subscription, by the key a request carries."""
    key = F.coalesce(headers["x-api-key"], F.regexp_replace(headers["authorization"], "^[Bb]earer +", ""))
    return F.when(F.regexp_like(key, F.lit(r"^(sk-ant-oat|ya29\.)")), "oauth").when(F.startswith(key, F.lit("sk-")) | headers["x-api-key"].isNotNull(), "payg").otherwise("subscription")


def forwarded(headers: Column, forward: Column | None = None, strip_encoding: Column | None = None, client: Column | None = None) -> Column:
    """Headers that go on upstream: without hop-by-hop ones and those the engine itself sets.

    forward: whether x-forwarded-* headers are allowed (else they go, also the client's own); where they are, and a client is
    named, x-forwarded-for becomes that client. strip_encoding: whether accept-encoding goes.
    """
    forward = F.lit(True) if forward is None else forward
    strip_encoding = F.lit(False) if strip_encoding is None else strip_encoding

    def stays(name: Column) -> Column:
        low = F.lower(name)
        foreign = ~low.isin(*HOP_BY_HOP) & ~F.startswith(low, F.lit("x-textloom-"))
        return foreign & (forward | ~low.isin(*FORWARDED)) & ~(strip_encoding & (low == "accept-encoding"))

    kept = F.map_filter(headers, lambda k, v: stays(k))
    if client is None:
        return kept
    others = F.map_filter(kept, lambda k, v: F.lower(k) != "x-forwarded-for")
    return F.when(forward & client.isNotNull(), F.map_concat(others, F.create_map(F.lit("x-forwarded-for"), client))).otherwise(kept)


def redacted(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 12), F.lit("..."))


MODELS = ("claude-opus-4", "gpt-4o-mini", "o3-mini", "gemini-1.5-pro", "llama-3", "mixtral-8x7b", "olmo")
SYSTEM = ("keep answers short", "session 123e4567-e89b-12d3-a456-426614174000 began 2026-01-02T03:04:05", "build deadbeefdeadbeefdeadbeef of today")
TOOLS = '[{"name":"write","input":{"z":1,"a":[2.0]}},{"name":"read","turn_count":7},{"name":"read","b":1,"a":2}]'


def _pick(values: tuple, c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """request_id, body: each conversation as one JSON request.

    Every fourth turn holds a typed item (a tool result or an image), the one before it a tool call; in every fifth
    conversation the second message carries a cache mark.
    """
    c = read(spark, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    call = lambda t: F.concat(F.lit("t"), t.cast("string"))
    result = F.struct(F.when(conv % 2 == 0, "tool_result").otherwise("image").alias("type"), F.when(turn > 0, call(turn - 1)).alias("tool_use_id"), F.col("text").alias("content"))
    use = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<q:string>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call(turn).alias("id"), F.lit("search").alias("name"), F.struct(F.col("role").alias("q")).alias("input")),
    )
    mark = F.when((conv % 5 == 0) & (turn == 1), F.struct(F.lit("ephemeral").alias("type"))).alias("cache_control")
    item = F.when(turn % 4 == 0, F.to_json(F.struct("role", F.array(result).alias("content")))).when(turn % 4 == 3, F.to_json(F.struct("role", use.alias("content")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"), mark)))
    m = c.groupBy("conv_id").agg(in_order(item, F.col("turn"), by=",").alias("j"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    head = F.concat(F.lit('{"model":'), quoted(_pick(MODELS, conv)), F.lit(',"system":'), quoted(_pick(SYSTEM, conv)), F.lit(f',"tools":{TOOLS},"messages":['))
    return m.select(conv.alias("request_id"), F.concat(head, "j", F.lit("]}")).alias("body"))


def response_bodies(spark: SparkSession, d: str) -> DataFrame:
    """request_id, body: each conversation in the Responses dialect; every seventh has a plain string as its input."""
    c = read(spark, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    output = F.struct(_pick(OUTPUT_ITEMS, conv).alias("type"), F.lit("c").alias("call_id"), F.col("text").alias("output"))
    call = F.struct(F.lit("function_call").alias("type"), F.col("role").alias("arguments"))
    item = F.when(turn % 4 == 0, F.to_json(output)).when(turn % 4 == 3, F.to_json(call)).otherwise(F.to_json(F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))))
    m = c.groupBy("conv_id").agg(in_order(item, F.col("turn"), by=",").alias("j"))
    items = F.when(conv % 7 == 0, F.lit('"one plain question"')).otherwise(F.concat(F.lit("["), "j", F.lit("]")))
    return m.select(conv.alias("request_id"), F.concat(F.lit('{"model":"gpt-5","instructions":"be kind","input":'), items, F.lit("}")).alias("body"))


_ITEM = "type string, text string, content string, tool_use_id string, id string, cache_control string"


def read_blocks(b: DataFrame, dialect: str = "messages") -> DataFrame:
    """request_id, msg_idx, block_idx, role, kind, content, call_id, marked out of request bodies.

    dialect: `messages`, `chat` (a message of role tool is a tool result) or `responses` (items of output are blocks of
    their kind; a string input is one user text). String content is one text block; items keep their type, unknown types are
    attachments; a text block's content is its text, any other's its string content; roles other than assistant read as
    user. call_id: the call that a result or a tool_use names. marked: the message or one of its items carries
    cache_control. Bodies without such an array give no rows.
    """
    path = "$.input" if dialect == "responses" else "$.messages"
    inside = F.get_json_object("body", path)
    msgs = F.from_json(inside, "array<struct<role:string,content:string,cache_control:string,type:string,output:string,call_id:string>>")
    if dialect == "responses":
        plain = F.array(F.struct(F.lit("user").alias("role"), inside.alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("cache_control", "type", "output", "call_id")]))
        msgs = F.when(F.regexp_like(inside, F.lit(r"^\s*\[")), msgs).otherwise(F.when(inside.isNotNull(), plain))
    m = b.select("request_id", F.posexplode(msgs).alias("msg_idx", "m")).select("request_id", "msg_idx", "m.*")
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    is_list = F.regexp_like("content", F.lit(r"^\s*\[\s*[\{\]]"))
    items = F.when(is_list, F.from_json("content", f"array<struct<{_ITEM.replace(' string', ':string')}>>"))
    none = lambda n: F.lit(None).cast("string").alias(n)
    single = lambda kind, text, call: F.array(F.struct(kind.alias("type"), text.alias("text"), text.alias("content"), call.alias("tool_use_id"), none("id"), none("cache_control")))
    kind = F.when((F.col("role") == "tool") & F.lit(dialect == "chat"), "tool_result").otherwise("text")
    blocks_ = F.when(items.isNotNull(), items).when(F.col("content").isNotNull(), single(kind, F.col("content"), F.lit(None).cast("string")))
    if dialect == "responses":
        blocks_ = F.when(F.col("type").isin(*OUTPUT_ITEMS), single(F.col("type"), F.coalesce("output", F.lit("")), F.col("call_id"))).otherwise(blocks_)
    marked = F.col("cache_control").isNotNull() | F.coalesce(F.exists(items, lambda i: i["cache_control"].isNotNull()), F.lit(False))
    e = m.select("request_id", "msg_idx", role.alias("role"), marked.alias("marked"), F.posexplode(blocks_).alias("block_idx", "i"))
    block_kind = F.when(F.col("i.type").isin(*BLOCK_KINDS), F.col("i.type")).otherwise("attachment")
    content = F.when(F.col("i.type") == "text", F.col("i.text")).otherwise(F.col("i.content"))
    return e.select("request_id", "msg_idx", "block_idx", "role", block_kind.alias("kind"), content.alias("content"), F.coalesce("i.tool_use_id", "i.id").alias("call_id"), "marked")


def block_kinds(spark: SparkSession) -> DataFrame:
    """kind, sacrosanct, compressible, tool_output: a fixed table of eleven rows."""
    return spark.createDataFrame([(k, *v) for k, v in BLOCK_KINDS.items()], "kind string, sacrosanct boolean, compressible boolean, tool_output boolean")


def compressible(blocks_: DataFrame) -> DataFrame:
    """Blocks that may be condensed, with whether they are tool output: neither sacrosanct nor of a kind that must stay."""
    kinds = block_kinds(blocks_.sparkSession).where("compressible AND NOT sacrosanct").select("kind", "tool_output")
    return blocks_.join(F.broadcast(kinds), "kind")


def tool_pairs(blocks_: DataFrame) -> DataFrame:
    """request_id, call_id, called_at, answered_at: each tool result with the call it answers; null where there is none."""
    result = blocks_.where("kind = 'tool_result' AND call_id IS NOT NULL").select("request_id", "call_id", F.col("msg_idx").alias("answered_at"))
    call = blocks_.where("kind = 'tool_use'").select("request_id", "call_id", F.col("msg_idx").alias("called_at"))
    return result.join(call, ["request_id", "call_id"], "left").select("request_id", "call_id", "called_at", "answered_at")


def volatile_findings(b: DataFrame) -> DataFrame:
    """request_id, location, kind, sample: values that change from call to call in the part of a body that is meant to be
    cached (system, tools, instructions, messages of role system or developer); distinct."""
    from .signals import names_a_counter, volatile_tokens

    msgs = F.from_json(F.get_json_object("body", "$.messages"), "array<struct<role:string,content:string>>")
    own = F.transform(F.filter(msgs, lambda m: m["role"].isin("system", "developer")), lambda m: F.struct(F.lit("system message").alias("location"), m["content"].alias("text")))
    top = [F.struct(F.lit(k).alias("location"), F.get_json_object("body", f"$.{k}").alias("text")) for k in ("system", "tools", "instructions")]
    parts = b.select("request_id", F.explode(F.concat(F.array(*top), F.coalesce(own, F.array().cast("array<struct<location:string,text:string>>")))).alias("p")).select("request_id", "p.*").where("text IS NOT NULL")
    # in JSON text quotes, commas and white space part the strings; brackets and colons stand outside them
    words = parts.select(F.struct("request_id", "location").alias("at"), F.regexp_replace("text", r'[\[\]{}]|":', '"').alias("text"))
    found = volatile_tokens(words, "at", "text")
    pair = r'"([^"\\]*+)"\s*+:\s*+([0-9]++)'
    member = parts.select("request_id", "location", F.explode(F.regexp_extract_all("text", F.lit(pair + r"(?![0-9.eE])"), F.lit(0))).alias("m"))
    name, value = F.regexp_extract("m", pair, 1), F.regexp_extract("m", pair, 2)
    counters = member.where(names_a_counter(name, value)).select("request_id", "location", F.lit("counter").alias("kind"), name.alias("sample"))
    return found.select("at.request_id", "at.location", "kind", "sample").unionByName(counters).distinct()


def pooled(df: DataFrame, by: str, vec: str) -> DataFrame:
    """by, dim, value: the unit-length mean vector of each group."""
    m = df.select(by, F.posexplode(F.col(vec)).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = m.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(norm, by).select(by, "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"))


def memories_from_jsonl(lines: DataFrame) -> DataFrame:
    """ord, content, source, context of JSON lines; bad lines, sensitive and superseded ones are skipped."""
    j = lines.select("ord", F.from_json("line", "content string, source string, category string, sensitive boolean, superseded_by string").alias("j"))
    ok = F.col("j.content").isNotNull() & ~F.coalesce("j.sensitive", F.lit(False)) & F.col("j.superseded_by").isNull()
    return j.where(ok).select("ord", "j.content", F.coalesce("j.source", F.lit("unknown")).alias("source"), F.coalesce("j.category", F.lit("unknown")).alias("context"))


def _spaced(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(","), F.lit(" , ")), F.lit(":"), F.lit(": "))


def q_json_minify(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.select("block_id", F.sha2(minify_json(_spaced(F.col("content"))).cast("binary"), 256).alias("sha"))


def q_request_blocks(spark: SparkSession, d: str) -> DataFrame:
    return read_blocks(request_bodies(spark, d))


def q_response_items(spark: SparkSession, d: str) -> DataFrame:
    return read_blocks(response_bodies(spark, d), "responses").select("request_id", "msg_idx", "block_idx", "role", "kind", "content")


def q_compressible_blocks(spark: SparkSession, d: str) -> DataFrame:
    j = compressible(read_blocks(request_bodies(spark, d)))
    return j.groupBy("kind", "tool_output").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


def q_compressible_content(spark: SparkSession, d: str) -> DataFrame:
    """(text, kind) of all blocks that may be condensed, of both dialects: a corpus to measure digests on."""
    both = read_blocks(request_bodies(spark, d)).unionByName(read_blocks(response_bodies(spark, d), "responses"))
    return compressible(both).where("content <> ''").select(F.col("content").alias("text"), "kind")


def q_tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tool_pairs(read_blocks(request_bodies(spark, d)))


def q_volatile_findings(spark: SparkSession, d: str) -> DataFrame:
    return volatile_findings(request_bodies(spark, d))


def q_understood(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of both dialects and broken ones: whether they are understood, their model and their cache key."""
    r = request_bodies(spark, d)
    broken = r.select((-F.col("request_id") - 1).alias("request_id"), F.when(F.col("request_id") % 2 == 0, F.regexp_replace("body", r"\}$", "")).otherwise(F.regexp_replace("body", r"^\{", '{"input":[],')).alias("body"))
    b = r.unionByName(broken)
    return b.select("request_id", understood(F.col("body")).alias("understood"), model_of(F.col("body")).alias("model"), cache_key(F.col("body")).alias("cache_key"))


def q_shaped_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of bodies with a cache key and an effort put in front where they are absent."""
    b = request_bodies(spark, d)
    key = F.concat(F.lit('"'), cache_key(F.col("body")), F.lit('"'))
    with_key = b.withColumn("body", insert_member(F.col("body"), "prompt_cache_key", key))
    twice = with_key.withColumn("body", insert_member(insert_member(F.col("body"), "prompt_cache_key", F.lit('"again"')), "reasoning_effort", F.lit('"low"')))
    return twice.select("request_id", F.sha2("body", 256).alias("sha"))


def q_auth_mode(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    n = F.col("c_custkey")
    key = F.when(n % 4 == 0, F.lit("sk-ant-oat01-x")).when(n % 4 == 1, F.lit("sk-live-y")).when(n % 4 == 2, F.lit("Bearer ya29.z"))
    named = {"x-api-key": F.when(n % 4 < 2, key), "authorization": F.when(n % 4 == 2, key), "Connection": F.lit("close"), "x-textloom-mode": F.lit("a"), "accept": F.lit("b"), "Accept-Encoding": F.lit("br"), "X-Forwarded-For": F.lit("evil")}
    h = F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    mode = auth_mode(h)
    sent = forwarded(h, forward=mode != "subscription", strip_encoding=mode == "payg", client=F.when(n % 3 == 0, F.lit("10.0.0.1")))
    return c.select(n, mode.alias("mode"), F.array_join(F.array_sort(F.map_keys(sent)), ",").alias("forwarded"), F.element_at(sent, "x-forwarded-for").alias("client"), F.coalesce(redacted(key), F.lit("")).alias("shown"))


def q_pooled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return pooled(read(spark, d, "embeddings"), "label", "embedding").select("label", "dim", F.round("value", 6).alias("value"))


def q_jsonl_memories(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("turn") % 5 == 4, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("source"), (F.col("conv_id") % 7 == 0).alias("sensitive")))).alias("line"))
    return memories_from_jsonl(c)


def q_structure_hash(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).withColumn("ct", F.regexp_extract("block_id", "^([a-z]+)", 1))
    return b.select("block_id", structure_hashes(b, "content", "ct").alias("shape"))


def q_sorted_keys(spark: SparkSession, d: str) -> DataFrame:
    return request_bodies(spark, d).select("request_id", _udf(sort_keys)(F.col("body")).alias("body"))


def q_cache_key_member(spark: SparkSession, d: str) -> DataFrame:
    return request_bodies(spark, d).select("request_id", _udf(lambda b: set_member(b, "prompt_cache_key", '"k"', replace=False))(F.col("body")).alias("body"))


def q_exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", exact_tokens()(F.col("text")).alias("tokens"), T.estimated_tokens(F.col("text")).alias("estimate"))


_SQL_PICK = lambda values, c: "[" + ", ".join(f"'{v}'" for v in values) + f"][({c} % {len(values)} + 1)::INT]"
_RB = """c0 AS (SELECT conv_id AS request_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS msg_idx, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, role AS own, text,
  conv_id % 5 = 0 AND turn = 1 AS marked FROM conversations),
 rb AS (SELECT request_id, msg_idx, 0 AS block_idx, role, CASE WHEN turn % 4 <> 0 THEN 'text' WHEN request_id % 2 = 0 THEN 'tool_result' ELSE 'attachment' END AS kind, text AS content, CASE WHEN turn % 4 = 0 AND turn > 0 THEN 't' || (turn - 1) END AS call_id, marked FROM c0
  UNION ALL SELECT request_id, msg_idx, 1, role, 'tool_use', NULL, 't' || turn, false FROM c0 WHERE turn % 4 = 3)"""
_RI = f"""ri AS (SELECT conv_id AS request_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS msg_idx, 0 AS block_idx, CASE WHEN turn % 4 <> 0 AND role = 'assistant' THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN turn % 4 = 0 THEN {_SQL_PICK(OUTPUT_ITEMS, "conv_id")} ELSE 'text' END AS kind, text AS content, turn FROM conversations WHERE conv_id % 7 <> 0),
 rr AS (SELECT request_id, msg_idx, block_idx, role, kind, content FROM ri WHERE turn % 4 <> 3 UNION ALL SELECT DISTINCT conv_id, 0, 0, 'user', 'text', 'one plain question' FROM conversations WHERE conv_id % 7 = 0)"""
_BODY = f"""jm AS (SELECT conv_id AS request_id, turn, CASE WHEN turn % 4 = 0 THEN '{{"role":' || to_json(role) || ',"content":[{{"type":' || CASE WHEN conv_id % 2 = 0 THEN '"tool_result"' ELSE '"image"' END || CASE WHEN turn > 0 THEN ',"tool_use_id":"t' || (turn - 1) || '"' ELSE '' END || ',"content":' || to_json(text) || '}}]}}'
  WHEN turn % 4 = 3 THEN '{{"role":' || to_json(role) || ',"content":[{{"type":"text","text":' || to_json(text) || '}},{{"type":"tool_use","id":"t' || turn || '","name":"search","input":{{"q":' || to_json(role) || '}}}}]}}'
  ELSE '{{"role":' || to_json(role) || ',"content":' || to_json(text) || CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN ',"cache_control":{{"type":"ephemeral"}}' ELSE '' END || '}}' END AS j FROM conversations),
 jb AS (SELECT request_id, count(*) AS n, '{{"model":"' || {_SQL_PICK(MODELS, "request_id")} || '","system":"' || {_SQL_PICK(SYSTEM, "request_id")} || '","tools":{TOOLS},"messages":[' || string_agg(j, ',' ORDER BY turn) || ']}}' AS body FROM jm GROUP BY 1),
 jk AS (SELECT request_id, left(sha256(string_agg(j, '' ORDER BY turn)), 32) AS k FROM (SELECT *, max(turn) OVER (PARTITION BY request_id) AS last FROM jm) WHERE turn < last GROUP BY 1)"""
_KIND_ROWS = ", ".join(f"('{k}', {v[1]}, {v[2]})" for k, v in BLOCK_KINDS.items())
QUERIES = {
    "json_minify": q_json_minify, "request_blocks": q_request_blocks, "response_items": q_response_items, "compressible_content": q_compressible_content, "tool_pairs": q_tool_pairs, "volatile_findings": q_volatile_findings,
    "understood_bodies": q_understood, "shaped_bodies": q_shaped_bodies, "compressible_blocks": q_compressible_blocks, "auth_mode": q_auth_mode, "pooled_embeddings": q_pooled_embeddings, "jsonl_memories": q_jsonl_memories,
    "structure_hash": q_structure_hash, "sorted_keys": q_sorted_keys, "cache_key_member": q_cache_key_member, "exact_tokens": q_exact_tokens,
}
ORACLES = {
    "json_minify": f"""WITH {BLOCKS_SQL}, s AS (SELECT block_id, replace(replace(content, ',', ' , '), ':', ': ') AS c FROM blocks)
 SELECT block_id, sha256(CASE WHEN json_valid(c) THEN regexp_replace(c, '("(?:\\\\.|[^"\\\\])*")|[ \\t\\r\\n]+', '\\1', 'g') ELSE c END) AS sha FROM s""",
    "request_blocks": f"WITH {_RB} SELECT * FROM rb",
    "response_items": f"WITH {_RI} SELECT * FROM rr",
    "compressible_blocks": f"WITH {_RB}, k(kind, compressible, tool_output) AS (VALUES {_KIND_ROWS}) SELECT kind, tool_output, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM rb JOIN k USING (kind) WHERE compressible GROUP BY 1, 2",
    "compressible_content": f"WITH {_RB}, {_RI} SELECT content AS text, kind FROM (SELECT content, kind FROM rb UNION ALL SELECT content, kind FROM rr) WHERE kind NOT IN ('attachment', 'tool_use') AND content <> ''",
    "tool_pairs": f"WITH {_RB} SELECT r.request_id, r.call_id, u.msg_idx AS called_at, r.msg_idx AS answered_at FROM rb r LEFT JOIN rb u ON u.request_id = r.request_id AND u.call_id = r.call_id AND u.kind = 'tool_use' WHERE r.kind = 'tool_result' AND r.call_id IS NOT NULL",
    "volatile_findings": """WITH r AS (SELECT DISTINCT conv_id AS request_id FROM conversations) SELECT request_id, 'tools' AS location, 'counter' AS kind, 'turn_count' AS sample FROM r
 UNION ALL SELECT request_id, 'system', 'uuid', '123e4567-e89b-12d3-a456-…' FROM r WHERE request_id % 3 = 1 UNION ALL SELECT request_id, 'system', 'timestamp', '2026-01-02T03:04:05' FROM r WHERE request_id % 3 = 1
 UNION ALL SELECT request_id, 'system', 'hex', 'deadbeefdeadbeefdeadbeef' FROM r WHERE request_id % 3 = 2""",
    "understood_bodies": f"""WITH {_BODY} SELECT request_id, true AS understood, {_SQL_PICK(MODELS, "request_id")} AS model, k AS cache_key FROM jb LEFT JOIN jk USING (request_id)
 UNION ALL SELECT -request_id - 1, false, {_SQL_PICK(MODELS, "request_id")}, NULL FROM jb""",
    "shaped_bodies": f"""WITH {_BODY} SELECT request_id, sha256('{{"reasoning_effort":"low","prompt_cache_key":"' || coalesce(k, 'again') || '",' || substr(body, 2)) AS sha FROM jb LEFT JOIN jk USING (request_id)""",
    "auth_mode": """WITH m AS (SELECT c_custkey, c_custkey % 4 AS r, ['oauth', 'payg', 'oauth', 'subscription'][c_custkey % 4 + 1] AS mode FROM customer)
 SELECT c_custkey, mode, array_to_string(list_sort(list_filter(['accept', CASE WHEN mode <> 'payg' THEN 'Accept-Encoding' END, CASE WHEN mode <> 'subscription' THEN CASE WHEN c_custkey % 3 = 0 THEN 'x-forwarded-for' ELSE 'X-Forwarded-For' END END,
  CASE WHEN r < 2 THEN 'x-api-key' WHEN r = 2 THEN 'authorization' END], lambda x: x IS NOT NULL)), ',') AS forwarded, CASE WHEN mode <> 'subscription' AND c_custkey % 3 = 0 THEN '10.0.0.1' END AS client,
  ['sk-ant-oat01...', 'sk-live-y...', 'Bearer ya29....', ''][r + 1] AS shown FROM m""",
    "pooled_embeddings": """WITH e AS (SELECT label, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
 SELECT label, dim, round(CASE WHEN norm > 0 THEN m / norm ELSE m END, 6) AS value FROM m JOIN n USING (label)""",
    "jsonl_memories": "SELECT conv_id * 1000 + turn AS ord, text AS content, CASE WHEN turn % 2 = 0 THEN role ELSE 'unknown' END AS source, 'unknown' AS context FROM conversations WHERE turn % 5 <> 4 AND conv_id % 7 <> 0",
    "cache_key_member": f"WITH {_BODY} SELECT request_id, '{{\"prompt_cache_key\":\"k\",' || substr(body, 2) AS body FROM jb",
    "sorted_keys": f"""WITH s AS (SELECT conv_id AS request_id, turn, CASE WHEN turn % 4 = 0 THEN '{{"content":[{{"content":' || to_json(text) || CASE WHEN turn > 0 THEN ',"tool_use_id":"t' || (turn - 1) || '"' ELSE '' END || ',"type":' || CASE WHEN conv_id % 2 = 0 THEN '"tool_result"' ELSE '"image"' END || '}}],"role":' || to_json(role) || '}}'
  WHEN turn % 4 = 3 THEN '{{"content":[{{"text":' || to_json(text) || ',"type":"text"}},{{"id":"t' || turn || '","input":{{"q":' || to_json(role) || '}},"name":"search","type":"tool_use"}}],"role":' || to_json(role) || '}}'
  ELSE '{{' || CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN '"cache_control":{{"type":"ephemeral"}},' ELSE '' END || '"content":' || to_json(text) || ',"role":' || to_json(role) || '}}' END AS j FROM conversations)
 SELECT request_id, '{{"messages":[' || string_agg(j, ',' ORDER BY turn) || '],"model":"' || {_SQL_PICK(MODELS, "request_id")} || '","system":"' || {_SQL_PICK(SYSTEM, "request_id")}
  || '","tools":[{{"input":{{"a":[2.0],"z":1}},"name":"write"}},{{"name":"read","turn_count":7}},{{"a":2,"b":1,"name":"read"}}]}}' AS body FROM s GROUP BY 1""",
    "structure_hash": f"""WITH {BLOCKS_SQL}, t AS (SELECT block_id, CASE WHEN starts_with(block_id, 'json-') THEN '[{{id:#,priority:s,status:s,}}]' ELSE regexp_extract(block_id, '^[a-z]+') END AS s FROM blocks),
 h AS (SELECT s, list_reduce(list_prepend({FNV_BASIS}::HUGEINT, list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * {FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT s FROM t))
 SELECT block_id, lower(lpad(to_hex(h::UBIGINT), 16, '0')) AS shape FROM t JOIN h USING (s)""",
}
