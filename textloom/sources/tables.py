"""Tables of lines, blocks, messages and records, made from the driver tables; every row and every whole text of them.

Groups follow keys whose number grows with the data (a user's log, a document's hits), so that no group does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lines


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(value: Column, *order: Column, by: str = "\n") -> Column:
    """Values of a group joined (by line feeds), in a total order."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["v"]), by)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: one log of each user, a line for each event."""
    e = read(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    text = lambda c: c.cast("string")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" worker "), text(F.col("event_id") % 7), F.lit(" handled "), "event_type",
        F.lit(" user="), text(F.col("user_id")), F.lit(" in "), text(F.col("event_id") % 900), F.lit("ms /api/"), "event_type", F.lit("/"), text(F.col("event_id")),
    )
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("doc_id"), "event_id", line.alias("line")).select("doc_id", no.alias("line_no"), "line")


LOG_SQL = """log_lines AS (
 SELECT user_id AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS line_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END
  || ' worker ' || (event_id % 7) || ' handled ' || event_type || ' user=' || user_id || ' in ' || (event_id % 900) || 'ms /api/' || event_type || '/' || event_id AS line
 FROM events)"""


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: search hits `path:line:text`, one for each line of a document, seven lines to a file."""
    d = read(spark, sf_dir, "documents").select("doc_id", _folder().alias("folder"), F.posexplode(lines(F.col("text"))).alias("pos", "hit"))
    return d.select("doc_id", F.col("pos").alias("line_no"), _hit(F.col("folder"), F.col("pos"), F.col("hit")).alias("line"))


def _folder() -> Column:
    return F.concat(F.lit("src/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"))


def _hit(folder: Column, pos: Column, hit: Column) -> Column:
    return F.concat(folder, F.floor(pos / 7).cast("string"), F.lit(".txt:"), (pos + 1).cast("string"), F.lit(":"), F.translate(hit, "\n\r:", "   "))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: the lines of `search_lines` of each document, made in its own row; of rows with one id together."""
    d = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", _folder().alias("folder"), lines(F.col("text")).alias("hits"))
    made = d.select("doc_id", F.array_join(F.transform("hits", lambda hit, pos: _hit(F.col("folder"), pos, hit)), "\n").alias("own"))
    one = made.groupBy("doc_id").agg(F.collect_list("own").alias("own"))
    numbered = lambda text: F.transform(F.split(text, "\n"), lambda line, pos: F.struct(pos.alias("line_no"), line.alias("line")))
    merged = F.array_join(F.transform(F.sort_array(F.flatten(F.transform("own", numbered))), lambda x: x["line"]), "\n")
    return one.select("doc_id", F.when(F.size("own") == 1, F.get("own", F.lit(0))).otherwise(merged).alias("content"))


LINES_SQL = r"CASE WHEN content = '' THEN [] ELSE regexp_split_to_array(regexp_replace(content, '\r?\n$', ''), '\r?\n') END"
SEARCH_SQL = rf"""search_lines AS (
 SELECT doc_id, pos::INT AS line_no, 'src/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || (pos // 7) || '.txt:' || (pos + 1) || ':' || regexp_replace(hit, '[\n\r:]', ' ', 'g') AS line
 FROM (SELECT doc_id, lang, source, unnest(range(0, len(a))) AS pos, unnest(a) AS hit FROM (SELECT doc_id, lang, source, {LINES_SQL.replace("content", "text")} AS a FROM documents)))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, kind, content: documents as text; pages, logs, search hits and order lists as tool results."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("block_id")
    tool = F.lit("tool_result").alias("kind")
    doc = read(spark, sf_dir, "documents").select(named("doc-", "doc_id"), F.lit("text").alias("kind"), F.col("text").alias("content"))
    page = read(spark, sf_dir, "pages").select(named("page-", "page_id"), tool, "html")
    logs = log_lines(spark, sf_dir).groupBy("doc_id").agg(in_order(F.col("line"), F.col("line_no")).alias("content"))
    hits = search_texts(spark, sf_dir)
    o = read(spark, sf_dir, "orders")
    item = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('","priority":"'), "o_orderpriority", F.lit('"}'))
    lists = o.groupBy("o_custkey").agg(in_order(item, F.col("o_orderkey"), by=",").alias("j"))
    json = lists.select(named("json-", "o_custkey"), tool, F.concat(F.lit("["), "j", F.lit("]")))
    return doc.union(page).union(logs.select(named("log-", "doc_id"), tool, "content")).union(hits.select(named("search-", "doc_id"), tool, "content")).union(json)


BLOCKS_SQL = f"""{LOG_SQL}, {SEARCH_SQL}, blocks AS (
 SELECT 'doc-' || doc_id AS block_id, 'text' AS kind, text AS content FROM documents
 UNION ALL SELECT 'page-' || page_id, 'tool_result', html FROM pages
 UNION ALL SELECT 'log-' || doc_id, 'tool_result', string_agg(line, chr(10) ORDER BY line_no) FROM log_lines GROUP BY doc_id
 UNION ALL SELECT 'search-' || doc_id, 'tool_result', string_agg(line, chr(10) ORDER BY line_no) FROM search_lines GROUP BY doc_id
 UNION ALL SELECT 'json-' || o_custkey, 'tool_result', '[' || string_agg('{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}', ',' ORDER BY o_orderkey) || ']'
  FROM orders GROUP BY o_custkey)"""


def block_lines(b: DataFrame) -> DataFrame:
    """block_id, n, line_no, line of each block; n: its number of lines."""
    # outer, as otherwise a filter by the number of lines is added below, for which a content is made and cut twice
    ln = b.select("block_id", lines(F.col("content")).alias("a")).select("block_id", F.size("a").alias("n"), F.posexplode_outer("a").alias("line_no", "line"))
    return ln.where("line_no IS NOT NULL")
