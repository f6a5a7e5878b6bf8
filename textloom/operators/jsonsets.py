"""JSON documents: record sets out of arrays, the pattern a document shows, long strings in its leaves.

Numbers keep the literals they were written with, which no built-in reader offers; documents are parsed in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .records import _ANC, _OUT, _PLAN, _R, _ROLE, order_records, record_digest, record_json

# When a document is heavy with text or wide, and how deep its shape is looked at.
SCALAR_HEAVY, WIDE, DEPTH = 1024, 12, 64
#: Strings of more bytes than this are looked at as texts of their own.
LEAF_BYTES = 5120


class Literal(float):
    """A number that remembers how it was written."""

    text = "0"

    @classmethod
    def of(cls, text: str) -> Literal:
        n = cls(0)
        n.text = text
        return n


def parse(text: str):
    """The document, numbers as Literal; None if it is no JSON."""
    try:
        return json.loads(text, parse_int=Literal.of, parse_float=Literal.of, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _refuse(name: str):
    raise ValueError(name)


def show(v, sort: bool = False) -> str:
    """Compact JSON of a parsed document, numbers as written; sort: keys of every object in order."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(v[k], sort)}" for k in (sorted(v) if sort else v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(show(x, sort) for x in v) + "]"
    return v.text if isinstance(v, Literal) else json.dumps(v, ensure_ascii=False)


def _number(v) -> float | None:
    try:
        return float(v.text) if isinstance(v, Literal) else None
    except (ValueError, OverflowError):
        return None


#: Rows that are given on at once, however many records a batch of contents holds.
ROWS_A_BATCH = 10_000
RECORDS = "doc_id string, rec_idx long, field_ord int, field string, value string, num double"


def records_of(b: DataFrame, key: str = "block_id") -> DataFrame:
    """Records (doc_id, rec_idx, field_ord, field, value, num) of contents that are JSON arrays of objects, two at least.

    doc_id is the key as text; value the compact literal; num its number. Other contents, and null ones, give no rows;
    repeated keys would mix, so keys must be unique.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time becomes Python's
                doc, text = doc.as_py(), text.as_py()
                v = parse(text) if text and text.lstrip()[:1] == "[" else None
                if isinstance(v, list) and len(v) >= 2 and all(isinstance(x, dict) for x in v):
                    for i, rec in enumerate(v):
                        for k, (name, x) in enumerate(rec.items()):
                            yield doc, i, k, name, show(x), _number(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        while own := list(islice(rows, ROWS_A_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.string()), ("rec_idx", pa.int64()), ("field_ord", pa.int32()), ("field", pa.string()), ("value", pa.string()), ("num", pa.float64())])
    return b.select(F.col(key).cast("string").alias("doc_id"), F.col("content")).mapInArrow(run, RECORDS)


def shape(v, depth: int = 1):
    """Structure of a value: n, b, #, (s, bytes), [length, common shape or None], {field: shape}; … beyond DEPTH."""
    if depth > DEPTH:
        return "…"
    if isinstance(v, dict):
        return {k: shape(x, depth + 1) for k, x in v.items()}
    if isinstance(v, list):
        own = [shape(x, depth + 1) for x in v]
        return [len(v), own[0] if own and all(x == own[0] and (not isinstance(x, dict) or list(x) == list(own[0])) for x in own) else None]
    if isinstance(v, str):
        return ("s", len(v.encode("utf-8", "surrogatepass")))
    return "n" if v is None else "b" if isinstance(v, bool) else "#"


def measures(s) -> tuple[int, int, int]:
    """(depth, bytes of strings, leaves) of a shape; an array counts its common shape once for each element."""
    if isinstance(s, dict):
        parts = [measures(x) for x in s.values()]
        return 1 + max((p[0] for p in parts), default=0), sum(p[1] for p in parts), sum(p[2] for p in parts)
    if isinstance(s, list):
        n, common = s
        d, b, k = measures(common) if common is not None else (0, 0, 1)
        return 1 + d, n * b, n * k
    return (1, s[1], 1) if isinstance(s, tuple) else (1, 0, 1)


def pattern(text: str | None) -> tuple[str, int, int, int, int] | None:
    """(pattern, its size, depth, string bytes, leaves) of a JSON document; None if it is none.

    record_set (of so many objects of one shape), scalar_heavy (so many bytes of strings), wide_object (so many fields),
    deep_nest (so deep, with fewer leaves), else unremarkable.
    """
    v = parse(text) if text else None
    if v is None and (text or "").strip() != "null":
        return None
    s = shape(v)
    depth, size, leaves = measures(s)
    if isinstance(s, list) and s[0] >= 2 and isinstance(s[1], dict):
        return "record_set", s[0], depth, size, leaves
    if size >= SCALAR_HEAVY:
        return "scalar_heavy", size, depth, size, leaves
    if isinstance(s, dict) and len(s) >= WIDE:
        return "wide_object", len(s), depth, size, leaves
    if depth >= 4 and depth > leaves:
        return "deep_nest", depth, depth, size, leaves
    return "unremarkable", 0, depth, size, leaves


PATTERN = "struct<pattern:string,amount:long,depth:int,string_bytes:long,leaves:long>"


def json_pattern(c: Column) -> Column:
    """The pattern of each document and its measures; null fields where it is no JSON."""

    @F.pandas_udf(PATTERN)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pattern(t) or (None,) * 5 for t in texts], columns=["pattern", "amount", "depth", "string_bytes", "leaves"])

    return run(c)


def _strings(v, path: tuple = ()):
    """(path, text) of the strings of a document, in order; keys are no leaves."""
    if isinstance(v, str):
        yield path, v
    elif isinstance(v, (dict, list)):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from _strings(x, (*path, k))


def long_leaves(b: DataFrame, least: int = LEAF_BYTES) -> DataFrame:
    """block_id, leaf (number of the string in its document), content: strings of more than `least` bytes of JSON contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (_, t) in enumerate(_strings(parse(text)) if text else ()):
                    if len(t.encode("utf-8", "surrogatepass")) > least:
                        rows.append({"block_id": key, "leaf": i, "content": t})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("block_id", pa.string()), ("leaf", pa.int32()), ("content", pa.string())]))

    return b.select(F.col("block_id").cast("string"), "content").mapInArrow(run, "block_id string, leaf int, content string")


def replace_leaves(text: str | None, new: dict[int, str]) -> str | None:
    """The document with some of its strings, by number, replaced; compact, all other literals as written."""
    v = parse(text) if text else None
    if v is None or not new:
        return text
    for i, (path, _) in enumerate(list(_strings(v))):
        if i in new:
            if not path:
                return show(new[i])
            at = v
            for k in path[:-1]:
                at = at[k]
            at[path[-1]] = new[i]
    return show(v)


def with_leaves(b: DataFrame, leaves: DataFrame) -> DataFrame:
    """block_id, content of the blocks that have a new leaf. leaves: block_id, leaf, text."""
    edits = leaves.groupBy("block_id").agg(F.to_json(F.collect_list(F.struct("leaf", "text"))).alias("edits"))

    @F.pandas_udf("string")
    def run(text: pd.Series, edit: pd.Series) -> pd.Series:
        return pd.Series([replace_leaves(t, {x["leaf"]: x["text"] for x in json.loads(e)}) for t, e in zip(text, edit, strict=True)])

    return b.select("block_id", "content").join(edits, "block_id").select("block_id", run("content", "edits").alias("content"))


def order_lists(spark: SparkSession, d: str) -> DataFrame:
    """block_id (the customer), content: the records of each customer's orders as a JSON array."""
    j = record_json(order_records(spark, d))
    from ..sources.tables import in_order

    return j.groupBy("doc_id").agg(in_order(F.col("json"), F.col("rec_idx"), by=",").alias("j")).select(F.col("doc_id").alias("block_id"), F.concat(F.lit("["), "j", F.lit("]")).alias("content"))


LISTS_SQL = """jr AS (SELECT doc_id, rec_idx, '{' || string_agg('"' || field || '":' || value, ',' ORDER BY field_ord) || '}' AS j FROM r GROUP BY 1, 2),
 lists AS (SELECT doc_id, '[' || string_agg(j, ',' ORDER BY rec_idx) || ']' AS content FROM jr GROUP BY 1)"""
DIGEST_SQL = f"""{_ROLE}, {_OUT}, {_ANC}, {_PLAN}, v AS (SELECT doc_id, field, string_agg(value, ' | ' ORDER BY fst) AS vals FROM (SELECT doc_id, field, value, min(rec_idx) AS fst FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
 fl AS (SELECT doc_id, string_agg(CASE fs.kind WHEN 'constant' THEN 'all: ' || field || '=' || vals ELSE field || ' one of: ' || vals END, chr(10) ORDER BY field_ord) AS fields
  FROM fs JOIN v USING (doc_id, field) WHERE present = records AND fs.kind IN ('constant', 'low_cardinality') GROUP BY 1),
 sh AS (SELECT doc_id, string_agg(rec_idx || ': ' || j, chr(10) ORDER BY rec_idx) AS rows_ FROM jr JOIN an USING (doc_id, rec_idx) GROUP BY 1),
 recd AS (SELECT doc_id, CASE WHEN ok THEN '[' || records || ' records, ' || shown || ' shown, ' || (records - shown) || ' elided]' || chr(10) || coalesce(fields || chr(10), '') || rows_ END AS digest FROM k LEFT JOIN fl USING (doc_id) JOIN sh USING (doc_id))"""


def q_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records read back out of the JSON lists."""
    return records_of(order_lists(spark, d)).select(F.col("doc_id").cast("long").alias("doc_id"), "rec_idx", "field", "value", "num")


def q_json_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of JSON contents; a list of one record is no record set."""
    return record_digest(records_of(order_lists(spark, d))).select(F.col("doc_id").cast("long").alias("doc_id"), "digest")


def q_json_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of events' properties, wide objects and nested ones made of parts."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content"))
    wide = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit('"f'), i.cast("string"), F.lit('":1'))), ","), F.lit("}"))
    deep = F.concat(F.repeat(F.lit('{"a":'), (F.col("p_size") % 7).cast("int")), F.lit('"'), F.repeat(F.lit("x"), F.col("p_size") * 40), F.lit('"'), F.repeat(F.lit("}"), (F.col("p_size") % 7).cast("int")))
    p = read(spark, d, "part")
    every = e.union(p.select(-F.col("p_partkey"), wide)).union(p.select(-1_000_000_000 - F.col("p_partkey"), deep))
    return every.select("id", json_pattern(F.col("content")).alias("p")).select("id", "p.*")


def q_json_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of documents wrapped as JSON, their long texts replaced by their lengths."""
    docs = read(spark, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("block_id"), F.to_json(F.struct(F.lit(1.5).alias("n"), F.array("text", "lang").alias("t"))).alias("content"))
    leaves = long_leaves(docs, 1000).select("block_id", "leaf", F.length("content").cast("string").alias("text"))
    return with_leaves(docs, leaves).select(F.col("block_id").cast("long").alias("doc_id"), F.col("content").alias("content"))


QUERIES = {"json_records": q_json_records, "json_digest": q_json_digest, "json_patterns": q_json_patterns, "json_leaves": q_json_leaves}
ORACLES = {
    "json_records": f"WITH {_R}, m AS (SELECT doc_id, max(rec_idx) AS last FROM r GROUP BY 1) SELECT doc_id, rec_idx, field, value, num FROM r JOIN m USING (doc_id) WHERE last > 0",
    "json_digest": f"WITH {_R}, {LISTS_SQL}, {DIGEST_SQL} SELECT doc_id, digest FROM recd JOIN n USING (doc_id) WHERE records >= 2",
    "json_patterns": """SELECT event_id AS id, 'unremarkable' AS pattern, 0 AS amount, 2 AS depth, 0 AS string_bytes, 1 AS leaves FROM events
 UNION ALL SELECT -p_partkey, CASE WHEN p_size >= 12 THEN 'wide_object' ELSE 'unremarkable' END, CASE WHEN p_size >= 12 THEN p_size ELSE 0 END, 2, 0, p_size FROM part
 UNION ALL SELECT -1000000000 - p_partkey, CASE WHEN p_size * 40 >= 1024 THEN 'scalar_heavy' WHEN p_size % 7 + 1 >= 4 THEN 'deep_nest' ELSE 'unremarkable' END,
  CASE WHEN p_size * 40 >= 1024 THEN p_size * 40 WHEN p_size % 7 + 1 >= 4 THEN p_size % 7 + 1 ELSE 0 END, p_size % 7 + 1, p_size * 40, 1 FROM part""",
    "json_leaves": """SELECT doc_id, '{"n":1.5,"t":["' || length(text) || '",' || coalesce(to_json(lang)::VARCHAR, 'null') || ']}' AS content FROM documents WHERE strlen(text) > 1000""",
}
