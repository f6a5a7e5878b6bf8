"""Record sets: field statistics, roles, robust outliers, anchors and the plan that shows only them.

Records are rows (doc_id, rec_idx, field, field_ord, value, num): the values of a record unpivoted, `value` the literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import settle
from ..sources.tables import in_order, read
from .selection import BIG, medians

# Scales and cuts of the ranking, and field-name hints.
SCALE, MAD_CUT, SIZE_CUT, LOW_CARDINALITY, MIN_RECORDS = 1000, 3.5, 3, 8, 5
ERROR_FIELDS = ("error", "err", "errors", "exception", "failure", "failed", "stderr", "traceback", "panic", "fault")
SCORE_HINTS = ("score", "rank", "relevance", "similarity", "confidence", "weight", "rating", "priority")
RELEVANT, RELEVANCE = 5, 0.5
ID_SUFFIX = "(id|uuid|guid|hash|seq)$"


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer as one record set; orders of price over 300,000 carry an extra error field."""
    o = read(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("rec_idx"),
        F.col("o_orderkey").cast("string").alias("order_id"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("status"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("priority"),
        F.floor("o_totalprice").cast("string").alias("total"), F.when(F.col("o_totalprice") > 300_000, F.lit('"limit"')).alias("error"), F.lit('"order"').alias("kind"),
    )
    names = ["order_id", "status", "priority", "total", "error", "kind"]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("field_ord"), F.lit(n).alias("field"), F.col(n).alias("value")) for i, n in enumerate(names)])).alias("p")
    return o.select("doc_id", "rec_idx", pairs).select("doc_id", "rec_idx", "p.*").where("value IS NOT NULL").withColumn("num", F.expr("try_cast(value AS double)"))


def field_stats(r: DataFrame) -> DataFrame:
    """doc_id, field, n_distinct, present, records, kind: constant, unique, low_cardinality or varied."""
    n = r.groupBy("doc_id").agg((F.max("rec_idx") + 1).alias("records"))
    s = r.groupBy("doc_id", "field").agg(F.countDistinct("value").alias("n_distinct"), F.count(F.lit(1)).alias("present"), F.min("field_ord").alias("field_ord"), F.min_by("value", "rec_idx").alias("first_value")).join(n, "doc_id")
    return s.withColumn("kind", _kind())


def _kind() -> Column:
    return F.when(F.col("n_distinct") == 1, "constant").when(F.col("n_distinct") == F.col("present"), "unique").when(F.col("n_distinct") <= LOW_CARDINALITY, "low_cardinality").otherwise("varied")


def field_roles(r: DataFrame) -> DataFrame:
    """doc_id, field, role: score, identifier or ordinary."""
    num = F.col("num")
    s = r.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("k"), F.count(num).alias("nums"), F.min(num).alias("lo"), F.max(num).alias("hi"), F.max(num != F.floor(num)).alias("frac"))
    return s.select("doc_id", "field", _role(F.col("n"), F.col("k")).alias("role"))


def _role(n: Column, k: Column) -> Column:
    """Of a field with nums, lo, hi and frac of its numbers; n: its values, k: distinct ones."""
    low = F.lower("field")
    votes = ((F.col("hi") - F.col("lo") > 0) & (F.col("hi") - F.col("lo") <= 1000)).cast("int") + F.coalesce(F.col("frac"), F.lit(False)).cast("int") + F.regexp_like(low, F.lit("|".join(SCORE_HINTS))).cast("int")
    is_score = (F.col("nums") == n) & (k >= 2) & (votes >= 2)
    return F.when(n < 8, "ordinary").when(F.regexp_like(low, F.lit(ID_SUFFIX)), "identifier").when(is_score, "score").when(10 * k >= 9 * n, "identifier").otherwise("ordinary")


def outliers(r: DataFrame, stats: DataFrame | None = None, big: int = BIG) -> DataFrame:
    """doc_id, rec_idx, weight, reasons: records that stand out by a rare value, a rare field, a number or their size.

    Constant and unique fields say nothing; a numeric outlier is over MAD_CUT median deviations from the median. stats: the
    field statistics of r, where they are at hand. big: values of a field from which its medians are narrowed down rather
    than sorted.
    """
    s = field_stats(r) if stats is None else stats
    error = F.lower("field").isin(*ERROR_FIELDS)
    usual = r.join(s.select("doc_id", "field", "kind", "records", "n_distinct", "present"), ["doc_id", "field"])
    by_value = Window.partitionBy("doc_id", "field", "value")
    telling = ~F.col("kind").isin("constant", "unique")
    share = F.count(F.lit(1)).over(by_value)
    rare = usual.where(telling).withColumn("c", share).where(F.col("c") * F.col("n_distinct") * 2 <= F.col("records"))
    weight = lambda c: F.floor((SCALE * (F.col("records") - c)) / F.col("records")).cast("long")
    parts = rare.select("doc_id", "rec_idx", weight(F.col("c")).alias("w"), F.lit("rare_value").alias("reason"))
    absent = usual.where(F.col("present") * 2 <= F.col("records"))
    parts = parts.union(absent.select("doc_id", "rec_idx", (weight(F.col("present")) * F.when(error, 2).otherwise(1)).alias("w"), F.when(error, "error_field").otherwise("rare_field").alias("reason")))
    numeric = usual.where(telling & F.col("num").isNotNull()).select("doc_id", "field", "rec_idx", "num")
    mid = medians(numeric, ["doc_id", "field"], "num", big).select("doc_id", "field", F.col("median").alias("m"), "n").where("n >= 4")
    dev = numeric.join(mid, ["doc_id", "field"]).withColumn("dev", F.abs(F.col("num") - F.col("m")))
    mad = medians(dev, ["doc_id", "field"], "dev", big).select("doc_id", "field", F.col("median").alias("mad"))
    far = dev.join(mad, ["doc_id", "field"]).where(F.when(F.col("mad") > 0, F.col("dev") > MAD_CUT * F.col("mad")).otherwise(F.col("dev") > 0))
    parts = parts.union(far.select("doc_id", "rec_idx", F.lit(SCALE).cast("long"), F.lit("numeric")))
    size = r.groupBy("doc_id", "rec_idx").agg(F.sum(F.octet_length("value") + F.length("field") + 4).alias("size"))
    wide = size.join(medians(size, ["doc_id"], "size", big).select("doc_id", F.col("median").alias("m")), "doc_id").where(F.col("size") > SIZE_CUT * F.col("m"))
    parts = parts.union(wide.select("doc_id", "rec_idx", F.lit(SCALE).cast("long"), F.lit("size")))
    return parts.groupBy("doc_id", "rec_idx").agg(F.sum("w").alias("weight"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def record_json(r: DataFrame) -> DataFrame:
    """doc_id, rec_idx, json: each record as a JSON object, fields in order, values as written."""
    member = F.concat(F.lit('"'), "field", F.lit('":'), "value")
    return r.groupBy("doc_id", "rec_idx").agg(F.concat(F.lit("{"), in_order(member, F.col("field_ord"), by=","), F.lit("}")).alias("json"))


def relevant_records(r: DataFrame, queries: DataFrame, k: int = RELEVANT, least: float = RELEVANCE) -> DataFrame:
    """doc_id, rec_idx of the records whose text answers their set's query best: at most k, of a score of `least` or more.

    queries: doc_id, query. A record is scored as its JSON, among the records of its own set."""
    from .relevance import bm25_within, top_k

    items = record_json(r).select(F.col("doc_id").alias("group_id"), F.col("rec_idx").alias("item_id"), F.col("json").alias("text"))
    scored = bm25_within(items, queries.select(F.col("doc_id").alias("group_id"), F.col("query").alias("text")))
    return top_k(scored.withColumnRenamed("group_id", "query_id"), k, least).select(F.col("query_id").alias("doc_id"), F.col("item_id").alias("rec_idx"))


def _with_median(df: DataFrame, value: str, over: list[str], name: str) -> DataFrame:
    """df with the median of a group's values that are not null, by their places: no group is held in memory."""
    w = Window.partitionBy(*over)
    df = df.withColumns({"__place": F.row_number().over(w.orderBy(F.asc_nulls_last(value))) - 1, "__n": F.count(value).over(w)})
    at = lambda half: F.max(F.when((F.col("__place") == F.floor(half / 2)) & F.col(value).isNotNull(), F.col(value))).over(w)
    return df.withColumn(name, 0.5 * at(F.col("__n") - 1) + 0.5 * at(F.col("__n")))


def judged(r: DataFrame, sample: int = 3, ranked: int = 5) -> DataFrame:
    """doc_id, rec_idx, records, weight, reasons, shown, facts, items: each record with what `outliers` and `anchors` say of it.

    facts: (ord, field, kind, value, at) of values that the record is the first to hold, in fields that every record has and
    that are constant or of few values; items: (ord, field, value) of the records shown. Rows are dealt by set once, and all
    else is sorted and gone through where they are; sets of more than BIG values go the longer way (see `wide_sets`).
    """
    f, v, own = Window.partitionBy("doc_id", "field"), Window.partitionBy("doc_id", "field", "value"), Window.partitionBy("doc_id")
    r = r.select("doc_id", "rec_idx", "field_ord", "field", "value", "num").repartition("doc_id")
    r = r.withColumns({"first": F.row_number().over(v.orderBy("rec_idx")) == 1, "c": F.count(F.lit(1)).over(v)})
    num = F.col("num")
    r = r.withColumns({
        "n_distinct": F.count(F.when(F.col("first"), 1)).over(f), "present": F.count(F.lit(1)).over(f), "ord": F.min("field_ord").over(f), "records": F.max("rec_idx").over(own) + 1,
        "nums": F.count(num).over(f), "lo": F.min(num).over(f), "hi": F.max(num).over(f), "frac": F.max(num != F.floor(num)).over(f),
    })
    r = r.withColumns({"kind": _kind(), "role": _role(F.col("present"), F.col("n_distinct"))})
    r = r.withColumn("best", F.min(F.when(F.col("role") == "score", F.struct("ord", "field"))).over(own)["field"])
    telling = ~F.col("kind").isin("constant", "unique")
    r = _with_median(r.withColumn("told", F.when(telling, num)), "told", ["doc_id", "field"], "m")
    r = _with_median(r.withColumn("dev", F.when(F.col("__n") >= 4, F.abs(F.col("told") - F.col("m")))), "dev", ["doc_id", "field"], "mad")

    error = F.lower("field").isin(*ERROR_FIELDS)
    weight = lambda c: F.floor((SCALE * (F.col("records") - c)) / F.col("records")).cast("long")
    rare, absent = telling & (F.col("c") * F.col("n_distinct") * 2 <= F.col("records")), F.col("present") * 2 <= F.col("records")
    far = F.coalesce(F.when(F.col("mad") > 0, F.col("dev") > MAD_CUT * F.col("mad")).otherwise(F.col("dev") > 0) & F.col("mad").isNotNull(), F.lit(False))
    w = F.when(rare, weight(F.col("c"))).otherwise(0) + F.when(absent, weight(F.col("present")) * F.when(error, 2).otherwise(1)).otherwise(0) + F.when(far, SCALE).otherwise(0)
    is_best = F.col("field") == F.col("best")
    told = (F.col("present") == F.col("records")) & F.col("kind").isin("constant", "low_cardinality")
    rec = r.groupBy("doc_id", "rec_idx").agg(
        F.max("records").alias("records"), F.sum(w).alias("w"), F.max(rare).alias("rare"), F.max(absent & error).alias("error"), F.max(absent & ~error).alias("absent"), F.max(far).alias("far"),
        F.sum(F.octet_length("value") + F.length("field") + 4).alias("size"), F.coalesce(F.max(is_best), F.lit(False)).alias("ranked"), F.max(F.when(is_best, num)).alias("score"),
        F.collect_list(F.when(told & F.col("first"), F.struct("ord", "field", "kind", "value", F.col("rec_idx").alias("at")))).alias("facts"), F.collect_list(F.struct(F.col("field_ord").alias("ord"), "field", "value")).alias("items"),
    )
    rec = _with_median(rec, "size", ["doc_id"], "usual")
    wide = F.col("size") > SIZE_CUT * F.col("usual")
    place = F.row_number().over(own.orderBy(F.desc("ranked"), F.desc("score"), "rec_idx"))
    reasons = F.concat_ws(",", F.when(F.col("error"), "error_field"), F.when(F.col("far"), "numeric"), F.when(F.col("absent"), "rare_field"), F.when(F.col("rare"), "rare_value"), F.when(wide, "size"))
    rec = rec.withColumns({"reasons": reasons, "weight": F.col("w") + F.when(wide, SCALE).otherwise(0), "place": place})
    shown = (F.col("rec_idx") < sample) | (F.col("reasons") != "") | (F.col("ranked") & (F.col("place") <= ranked))
    return rec.select("doc_id", "rec_idx", "records", "weight", "reasons", shown.alias("shown"), "facts", "items")


def wide_sets(r: DataFrame, big: int = BIG) -> bool:
    """Whether a set has more values than a task should go through; r is read once."""
    return bool(r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > big).limit(1).count())


def anchors(r: DataFrame, sample: int = 3, ranked: int = 5, stats: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """doc_id, rec_idx of the records a digest shows: the first ones, the outliers, the best by a score field, and those
    that answer the query, where there is one."""
    s = field_stats(r) if stats is None else stats
    head = r.select("doc_id", "rec_idx").where(F.col("rec_idx") < sample)
    score = field_roles(r).where("role = 'score'").join(s.select("doc_id", "field", "field_ord"), ["doc_id", "field"]).groupBy("doc_id").agg(F.min_by("field", "field_ord").alias("field"))
    top = r.join(score, ["doc_id", "field"]).withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("num"), "rec_idx"))).where(F.col("p") <= ranked)
    every = head.union(outliers(r, s).select("doc_id", "rec_idx")).union(top.select("doc_id", "rec_idx"))
    if queries is not None:
        every = every.union(relevant_records(r, queries))
    return every.distinct()


def _pays() -> Column:
    """Whether a digest of a set pays: of its number of records, of those shown, and of its constants (null: none)."""
    return (F.col("records") >= MIN_RECORDS) & (F.col("shown") < F.col("records")) & (F.col("constants").isNotNull() | (2 * F.col("shown") < F.col("records")))


def _sets(rec: DataFrame) -> DataFrame:
    """doc_id, records, shown, constants, fields, rows of judged records: what is told of a set, put together where it is."""
    member = lambda x: F.concat(F.lit('"'), x["field"], F.lit('":'), x["value"])
    json = F.concat(F.col("rec_idx").cast("string"), F.lit(": {"), F.array_join(F.transform(F.sort_array("items"), member), ","), F.lit("}"))
    j = rec.groupBy("doc_id").agg(
        F.max("records").alias("records"), F.count_if("shown").alias("shown"), F.flatten(F.collect_list("facts")).alias("facts"), F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("rec_idx", json.alias("json"))))).alias("rows")
    )
    constants = F.array_sort(F.transform(F.filter("facts", lambda x: x["kind"] == "constant"), lambda x: F.concat(x["field"], F.lit("="), x["value"])))
    names = F.sort_array(F.array_distinct(F.transform("facts", lambda x: F.struct(x["ord"].alias("ord"), x["field"].alias("field"), x["kind"].alias("kind")))))

    def line(n: Column) -> Column:
        held = F.sort_array(F.transform(F.filter("facts", lambda x: x["field"] == n["field"]), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))))
        values = F.array_join(F.transform(held, lambda x: x["value"]), " | ")
        return F.when(n["kind"] == "constant", F.concat(F.lit("all: "), n["field"], F.lit("="), values)).otherwise(F.concat(n["field"], F.lit(" one of: "), values))

    some = lambda a, by: F.when(F.size(a) > 0, F.array_join(a, by))
    rows = F.array_join(F.transform("rows", lambda x: x["json"]), "\n")
    return j.select("doc_id", "records", "shown", some(constants, ",").alias("constants"), some(F.transform(names, line), "\n").alias("fields"), rows.alias("rows"))


def plan(r: DataFrame, stats: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """doc_id, records, shown, elided, constants: null counts where a digest would not pay.

    stats, shown: field statistics and anchors of r, where they are at hand; else r is written once and both come from that.
    """
    if stats is None or shown is None:
        r = settle(r, "records")
        if not wide_sets(r):
            return _planned(_sets(judged(r)))
        stats = settle(field_stats(r), "stats")
        shown = anchors(r, stats=stats)
    n = stats.groupBy("doc_id").agg(F.max("records").alias("records"))
    a = shown.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shown"))
    const = stats.where("kind = 'constant' AND present = records").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "first_value"))), ",").alias("constants"))
    return _planned(n.join(a, "doc_id").join(const, "doc_id", "left"))


def _planned(j: DataFrame) -> DataFrame:
    ok = _pays()
    return j.select("doc_id", "records", F.when(ok, F.col("shown")).alias("shown"), F.when(ok, F.col("records") - F.col("shown")).alias("elided"), F.when(ok, F.col("constants")).alias("constants"))


def record_digest(r: DataFrame, queries: DataFrame | None = None, big: int = BIG) -> DataFrame:
    """doc_id, digest: counts, then fields that are constant or of few values in every record, then the anchors as JSON.

    Null where a digest would not pay. queries: doc_id, query, for anchors that answer it. big: values of a set from which
    its medians, statistics and records are each dealt anew rather than gone through in one task.
    """
    r = settle(r, "records")
    if wide_sets(r, big):
        return _written(_dealt(r, queries))
    rec = judged(r)
    if queries is not None:
        asked = relevant_records(r, queries).groupBy("doc_id").agg(F.collect_list("rec_idx").alias("asked"))  # a few a set
        rec = rec.join(asked, "doc_id", "left").withColumn("shown", F.col("shown") | F.coalesce(F.array_contains("asked", F.col("rec_idx")), F.lit(False)))
    j = _sets(rec)
    return _written(j.withColumns({"elided": F.when(_pays(), F.col("records") - F.col("shown"))}))


def _dealt(r: DataFrame, queries: DataFrame | None) -> DataFrame:
    """As `_sets`, of sets of any size."""
    stats = settle(field_stats(r), "stats")
    shown = settle(anchors(r, stats=stats, queries=queries), "anchors")
    first = r.groupBy("doc_id", "field", "value").agg(F.min("rec_idx").alias("at"))
    told = stats.where("present = records AND kind IN ('constant', 'low_cardinality')")
    values = first.join(told.select("doc_id", "field"), ["doc_id", "field"]).groupBy("doc_id", "field").agg(in_order(F.col("value"), F.col("at"), by=" | ").alias("values"))
    line = F.when(F.col("kind") == "constant", F.concat(F.lit("all: "), "field", F.lit("="), "values")).otherwise(F.concat("field", F.lit(" one of: "), "values"))
    fields = told.join(values, ["doc_id", "field"]).groupBy("doc_id").agg(in_order(line, F.col("field_ord")).alias("fields"))
    rows = record_json(r.join(shown, ["doc_id", "rec_idx"])).groupBy("doc_id").agg(in_order(F.concat(F.col("rec_idx").cast("string"), F.lit(": "), "json"), F.col("rec_idx")).alias("rows"))
    return plan(r, stats, shown).join(fields, "doc_id", "left").join(rows, "doc_id")


def _written(p: DataFrame) -> DataFrame:
    head = F.concat(F.lit("["), F.col("records").cast("string"), F.lit(" records, "), F.col("shown").cast("string"), F.lit(" shown, "), F.col("elided").cast("string"), F.lit(" elided]\n"))
    return p.select("doc_id", F.concat(head, F.coalesce(F.concat("fields", F.lit("\n")), F.lit("")), "rows").alias("digest"))


_R = """o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rec_idx, * FROM orders),
 r AS (SELECT *, try_cast(value AS DOUBLE) AS num FROM (SELECT doc_id, rec_idx, 0 AS field_ord, 'order_id' AS field, o_orderkey::VARCHAR AS value FROM o UNION ALL SELECT doc_id, rec_idx, 1, 'status', '"' || o_orderstatus || '"' FROM o UNION ALL SELECT doc_id, rec_idx, 2, 'priority', '"' || o_orderpriority || '"' FROM o
 UNION ALL SELECT doc_id, rec_idx, 3, 'total', floor(o_totalprice)::BIGINT::VARCHAR FROM o UNION ALL SELECT doc_id, rec_idx, 4, 'error', '"limit"' FROM o WHERE o_totalprice > 300000 UNION ALL SELECT doc_id, rec_idx, 5, 'kind', '"order"' FROM o)),
 n AS (SELECT doc_id, max(rec_idx) + 1 AS records FROM r GROUP BY 1),
 fs AS (SELECT *, CASE WHEN n_distinct = 1 THEN 'constant' WHEN n_distinct = present THEN 'unique' WHEN n_distinct <= 8 THEN 'low_cardinality' ELSE 'varied' END AS kind FROM (SELECT doc_id, field, count(DISTINCT value) AS n_distinct, count(*) AS present, min(field_ord) AS field_ord, min_by(value, rec_idx) AS first_value FROM r GROUP BY 1, 2) JOIN n USING (doc_id))"""
_ROLE = f"""ro AS (SELECT doc_id, field, CASE WHEN n < 8 THEN 'ordinary' WHEN regexp_matches(lower(field), '{ID_SUFFIX}') THEN 'identifier'
 WHEN nums = n AND k >= 2 AND (hi - lo > 0 AND hi - lo <= 1000)::INT + coalesce(frac, false)::INT + regexp_matches(lower(field), '{"|".join(SCORE_HINTS)}')::INT >= 2 THEN 'score' WHEN 10 * k >= 9 * n THEN 'identifier' ELSE 'ordinary' END AS role
 FROM (SELECT doc_id, field, count(*) AS n, count(DISTINCT value) AS k, count(num) AS nums, min(num) AS lo, max(num) AS hi, bool_or(num <> floor(num)) AS frac FROM r GROUP BY 1, 2))"""
_ERR = "field IN (" + ", ".join(f"'{e}'" for e in ERROR_FIELDS) + ")"
_OUT = f"""u AS (SELECT r.*, fs.kind AS fkind, records, n_distinct, present FROM r JOIN fs USING (doc_id, field)), tl AS (SELECT * FROM u WHERE fkind NOT IN ('constant', 'unique')),
 rv AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, field, value) AS c FROM tl) WHERE c * n_distinct * 2 <= records),
 md AS (SELECT doc_id, field, median(num) AS m FROM tl WHERE num IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4), dv AS (SELECT tl.doc_id, tl.field, rec_idx, abs(num - m) AS dev FROM tl JOIN md USING (doc_id, field) WHERE num IS NOT NULL), mm AS (SELECT doc_id, field, median(dev) AS mad FROM dv GROUP BY 1, 2),
 sz AS (SELECT doc_id, rec_idx, sum(strlen(value) + length(field) + 4) AS size FROM r GROUP BY 1, 2), sm AS (SELECT doc_id, median(size) AS m FROM sz GROUP BY 1),
 pa AS (SELECT doc_id, rec_idx, floor(1000 * (records - c) / records)::BIGINT AS w, 'rare_value' AS reason FROM rv
 UNION ALL SELECT doc_id, rec_idx, floor(1000 * (records - present) / records)::BIGINT * CASE WHEN {_ERR} THEN 2 ELSE 1 END, CASE WHEN {_ERR} THEN 'error_field' ELSE 'rare_field' END FROM u WHERE present * 2 <= records
 UNION ALL SELECT doc_id, rec_idx, 1000, 'numeric' FROM dv JOIN mm USING (doc_id, field) WHERE CASE WHEN mad > 0 THEN dev > 3.5 * mad ELSE dev > 0 END UNION ALL SELECT doc_id, rec_idx, 1000, 'size' FROM sz JOIN sm USING (doc_id) WHERE size > 3 * m),
 ou AS (SELECT doc_id, rec_idx, sum(w)::BIGINT AS weight, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM pa GROUP BY 1, 2)"""
_ANC = """sf AS (SELECT doc_id, min_by(field, field_ord) AS field FROM ro JOIN fs USING (doc_id, field) WHERE role = 'score' GROUP BY 1),
 an AS (SELECT doc_id, rec_idx FROM r WHERE rec_idx < 3 UNION SELECT doc_id, rec_idx FROM ou UNION SELECT doc_id, rec_idx FROM (SELECT r.doc_id, rec_idx, row_number() OVER (PARTITION BY r.doc_id ORDER BY num DESC, rec_idx) AS p FROM r JOIN sf USING (doc_id, field)) WHERE p <= 5)"""


def q_field_stats(spark: SparkSession, d: str) -> DataFrame:
    return field_stats(order_records(spark, d)).select("doc_id", "field", "n_distinct", "present", "records", "kind")


def q_field_roles(spark: SparkSession, d: str) -> DataFrame:
    return field_roles(order_records(spark, d))


def q_record_outliers(spark: SparkSession, d: str) -> DataFrame:
    r = settle(order_records(spark, d), "records")
    if wide_sets(r):
        return outliers(r, settle(field_stats(r), "stats"))
    return judged(r).where("reasons <> ''").select("doc_id", "rec_idx", "weight", "reasons")


def q_relevant_records(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer that answer a question about urgent ones over the limit."""
    r = settle(order_records(spark, d), "records")
    return relevant_records(r, r.select("doc_id").distinct().withColumn("query", F.lit("which URGENT order broke the limit")))


def q_record_anchors(spark: SparkSession, d: str) -> DataFrame:
    r = settle(order_records(spark, d), "records")
    if wide_sets(r):
        return anchors(r, stats=settle(field_stats(r), "stats"))
    return judged(r).where("shown").select("doc_id", "rec_idx")


def q_record_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan(order_records(spark, d))


def q_record_digest(spark: SparkSession, d: str) -> DataFrame:
    return record_digest(order_records(spark, d))


_PLAN = """c AS (SELECT doc_id, array_to_string(list_sort(list(field || '=' || first_value)), ',') AS constants FROM fs WHERE kind = 'constant' AND present = records GROUP BY 1),
 j AS (SELECT * FROM n JOIN (SELECT doc_id, count(*) AS shown FROM an GROUP BY 1) USING (doc_id) LEFT JOIN c USING (doc_id)), k AS (SELECT *, records >= 5 AND shown < records AND (constants IS NOT NULL OR 2 * shown < records) AS ok FROM j)"""
QUERIES = {"record_digest": q_record_digest, "field_stats": q_field_stats, "field_roles": q_field_roles, "record_outliers": q_record_outliers, "relevant_records": q_relevant_records, "record_anchors": q_record_anchors, "record_plan": q_record_plan}
ORACLES = {
    "field_stats": f"WITH {_R} SELECT doc_id, field, n_distinct, present, records, kind FROM fs",
    "field_roles": f"WITH {_R}, {_ROLE} SELECT * FROM ro",
    "relevant_records": rf"""WITH {_R}, js AS (SELECT doc_id, rec_idx, '{{' || string_agg('"' || field || '":' || value, ',' ORDER BY field_ord) || '}}' AS j FROM r GROUP BY 1, 2),
 it AS (SELECT doc_id, rec_idx, list_filter(regexp_split_to_array(lower(j), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM js), tot AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS a FROM it GROUP BY 1),
 tf AS (SELECT doc_id, rec_idx, len(t) AS l, w.term, len(list_filter(t, lambda x: x = w.term)) AS tf FROM it, (VALUES ('which'), ('urgent'), ('order'), ('broke'), ('the'), ('limit')) w(term)),
 dfr AS (SELECT doc_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1, 2),
 sc AS (SELECT doc_id, rec_idx, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN dfr USING (doc_id, term) JOIN tot USING (doc_id) WHERE tf > 0 GROUP BY 1, 2)
 SELECT doc_id, rec_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, rec_idx) AS p FROM sc WHERE score >= 0.5) WHERE p <= 5""",
    "record_outliers": f"WITH {_R}, {_OUT} SELECT * FROM ou",
    "record_anchors": f"WITH {_R}, {_ROLE}, {_OUT}, {_ANC} SELECT * FROM an",
    "record_digest": f"""WITH {_R}, {_ROLE}, {_OUT}, {_ANC}, {_PLAN}, v AS (SELECT doc_id, field, string_agg(value, ' | ' ORDER BY fst) AS vals FROM (SELECT doc_id, field, value, min(rec_idx) AS fst FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
 fl AS (SELECT doc_id, string_agg(CASE fs.kind WHEN 'constant' THEN 'all: ' || field || '=' || vals ELSE field || ' one of: ' || vals END, chr(10) ORDER BY field_ord) AS fields FROM fs JOIN v USING (doc_id, field) WHERE present = records AND fs.kind IN ('constant', 'low_cardinality') GROUP BY 1),
 js AS (SELECT doc_id, rec_idx, string_agg('"' || field || '":' || value, ',' ORDER BY field_ord) AS j FROM r GROUP BY 1, 2), sh AS (SELECT doc_id, string_agg(rec_idx || ': {{' || j || '}}', chr(10) ORDER BY rec_idx) AS rows_ FROM js JOIN an USING (doc_id, rec_idx) GROUP BY 1)
 SELECT doc_id, CASE WHEN ok THEN '[' || records || ' records, ' || shown || ' shown, ' || (records - shown) || ' elided]' || chr(10) || coalesce(fields || chr(10), '') || rows_ END AS digest FROM k LEFT JOIN fl USING (doc_id) JOIN sh USING (doc_id)""",
    "record_plan": f"""WITH {_R}, {_ROLE}, {_OUT}, {_ANC}, {_PLAN}
 SELECT doc_id, records, CASE WHEN ok THEN shown END AS shown, CASE WHEN ok THEN records - shown END AS elided, CASE WHEN ok THEN constants END AS constants FROM k""",
}
