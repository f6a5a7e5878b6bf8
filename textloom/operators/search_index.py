"""BM25 search on a kept inverted index: postings in blocks with bounds, added to by and by, and read only where a block can
still hold one of the best.

Items are dealt into segments of bounded size by length, so that the items of a segment have like lengths and the bound of a
term's block (its most frequent occurrence in its shortest item) is close to what the block holds. A query's bound for a
segment is the sum of its terms' bounds; the best segments are scored first, and of the others only those whose bound reaches
the k-th best score so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import folders, new_folder, remove_folder, settle
from ..sources.tables import read
from .relevance import _BM, B, BROADCAST_QUERY_TERMS, K1, _part, terms, top_k

#: Folders that postings are dealt into by their term, items of a segment, and segments of a query that are scored first.
SLOTS, SEGMENT_ITEMS, FIRST = 32, 1_000, 4


def _slot(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


class SearchIndex:
    """An index in a folder: `postings/add=N/slot=S` (a row for each term and segment) and `segments/add=N`.

    An add counts once both are complete; the same number again replaces it. Ids are of one type and name one item.
    """

    def __init__(self, spark: SparkSession, path: str, segment_items: int = SEGMENT_ITEMS):
        self.spark, self.path, self.segment_items = spark, path, segment_items

    def adds(self) -> list[int]:
        return sorted({int(n.split("=")[1]) for n in folders(self.spark, f"{self.path}/segments")})

    def add(self, items: DataFrame, number: int | None = None) -> int:
        """Index items (item_id, text; null and empty texts count as items without terms); returns the add's number."""
        number = max(self.adds(), default=-1) + 1 if number is None else number
        text = F.coalesce("text", F.lit(""))
        own = items.select("item_id", text.alias("text"), F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+")).alias("len"))
        lengths = settle(own.groupBy("len").agg(F.count(F.lit(1)).alias("n")), "lengths")  # a row for each length
        to = F.sum("n").over(Window.orderBy("len"))
        cell = lambda place: F.floor(place / self.segment_items).cast("long")
        first = lengths.select("len", cell(to - F.col("n")).alias("from"), cell(to - 1).alias("to"))
        segment = F.lit(number << 32).cast("long") + F.col("from") + F.pmod(F.xxhash64("item_id"), F.col("to") - F.col("from") + 1)
        dealt = own.join(F.broadcast(first), "len").select(segment.alias("segment"), "item_id", "len", "text")
        remove_folder(self.spark, f"{self.path}/segments/add={number}")
        # texts are dealt by segment once; their terms are counted and put together where they are
        held = dealt.repartition("segment").select("segment", "item_id", "len", F.explode(terms(F.col("text"))).alias("term")).groupBy("segment", "term", "item_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        block = held.groupBy("segment", "term").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"), F.collect_list(F.struct("item_id", "tf", "len")).alias("items")
        )  # some segment_items at most
        block.withColumn("slot", _slot("term")).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings/add={number}")
        dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("items"), F.sum("len").alias("words")).write.mode("overwrite").parquet(f"{self.path}/segments/add={number}")
        return number

    def postings(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/add={n}" for n in self.adds()])

    def totals(self) -> tuple[float, float]:
        """(items, mean words of an item)."""
        row = self.spark.read.parquet(*[f"{self.path}/segments/add={n}" for n in self.adds()]).agg(F.sum("items").alias("n"), F.sum("words").alias("w")).first()
        return float(row["n"] or 0), float(row["w"] or 0) / row["n"] if row["n"] else 1.0

    def bounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, qf, df) and (query_id, segment, bound, postings) of every segment that holds a term of a query.
        Only the blocks' bounds are read, of the folders that the queries' terms can be in."""
        q = settle(queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")), "terms")
        wanted = q.select("term").distinct()
        slots = [r["slot"] for r in wanted.select(_slot("term").alias("slot")).distinct().collect()]  # at most SLOTS
        few = wanted.count() <= BROADCAST_QUERY_TERMS
        block = self.postings().where(F.col("slot").isin(slots)).select("term", "segment", "n", "most_tf", "least_len").join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
        block = settle(block, "bounds")
        q = settle(q.join(block.groupBy("term").agg(F.sum("n").alias("df")), "term"), "weights")
        n, avg = self.totals()
        most = _part(F.lit(n), F.col("df"), F.col("qf"), F.col("most_tf"), F.col("least_len"), F.lit(avg or 1.0))
        return q, block.join(F.broadcast(q) if few else q, "term").groupBy("query_id", "segment").agg(F.sum(most).alias("bound"), F.sum("n").alias("postings"))

    def _scored(self, q: DataFrame, pairs: DataFrame) -> DataFrame:
        """query_id, item_id, score of all items in some (query_id, segment) that hold a term of the query."""
        n, avg = self.totals()
        slots = [r["slot"] for r in q.select(_slot("term").alias("slot")).distinct().collect()]
        held = self.postings().where(F.col("slot").isin(slots)).select("segment", "term", "items")
        by = ["query_id", "item_id"]
        if q.count() <= BROADCAST_QUERY_TERMS:  # blocks are dealt by segment, and an item's scores are added up where it is
            wanted = pairs.groupBy("segment").agg(F.collect_set("query_id").alias("wanted"))
            held = held.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").repartition("segment").join(wanted.hint("shuffle_merge"), "segment")
            held, by = held.join(F.broadcast(q), "term").where(F.array_contains("wanted", F.col("query_id"))), ["segment", *by]
        else:
            held = held.join(pairs.select("query_id", "segment").join(q, "query_id"), ["segment", "term"])
        row = held.select("segment", "query_id", "qf", "df", F.explode("items").alias("i")).select("segment", "query_id", "qf", "df", "i.*")
        part = _part(F.lit(n), F.col("df"), F.col("qf"), F.col("tf"), F.col("len"), F.lit(avg or 1.0))
        return row.groupBy(*by).agg(F.sum(part).alias("score")).drop("segment")

    def plan(self, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(terms, scores of the first segments, all (query_id, segment, bound, postings, turn)): turn is 1 for the segments
        scored first, 2 for those that can still hold one of the k best, 3 for those that cannot and are not read."""
        q, pairs = self.bounds(queries)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")
        pairs = settle(pairs.withColumn("r", F.row_number().over(order)), "pairs")
        early = settle(self._scored(q, pairs.where(F.col("r") <= first)), "early")
        best = early.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("p") == k).select("query_id", F.col("score").alias("kth"))
        # a little below the k-th score: sums in another order, and ties that go by the id
        reach = F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-6)
        turn = F.when(F.col("r") <= first, 1).when(reach, 2).otherwise(3)
        return q, early, settle(pairs.join(best, "query_id", "left").select("query_id", "segment", "bound", "postings", turn.alias("turn")), "turns")

    def search(self, queries: DataFrame, k: int = 10, least: float = 0.5, first: int = FIRST) -> DataFrame:
        """query_id, item_id, score, rank of the k best items of each query, exactly as relevance.bm25 and top_k rank them.

        queries: query_id, text; those without a known term have no rows. An index without an add has none for any.
        """
        if not self.adds():
            return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, item_id long, score double, rank int")
        q, early, pairs = self.plan(queries, k, first)
        return top_k(early.unionByName(self._scored(q, pairs.where(F.col("turn") == 2))), k, least)


def q_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for each benchmark text, on an index that the documents were added to in two parts."""
    index = SearchIndex(spark, new_folder(spark, "index"))
    items = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    for part in (0, 1):
        index.add(items.where(F.pmod("item_id", F.lit(2)) == part))
    found = index.search(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


QUERIES = {"indexed_search": q_indexed_search}
ORACLES = {"indexed_search": f"WITH {_BM} SELECT query_id, item_id, rank::INT AS rank, round(score, 6) AS score FROM rk WHERE rank <= 5"}
