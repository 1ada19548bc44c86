"""A full-text index of impact-ordered postings with block maxima, and BM25 searches that stop early.

What a posting adds to a score is its term's rarity times its impact, and the impact (term frequency against length) doesn't depend on
the query. Postings of a term are stored in blocks of like impact, highest first, with each block's greatest impact. So a search
knows what a block can add before it reads it:

1. Seeds: from each query's most promising blocks, some SEEDS postings. Their documents are scored in full; the score of the last
   place, `least`, is a bound that all results reach.
2. Terms that together can't reach `least` needn't bring documents in. Of the others only blocks are read whose postings reach it with
   all that the query's other terms can add.
3. A document that these brought in is scored in full only if what it has, and what the terms that are still unknown can add,
   reaches `least`.

No result is lost: each step drops what is below the bound alone. The index is written once and kept on disk: postings in folders by
hash of the term and sorted by term, blocks, terms, and documents with their impacts.

Nulls and edges: a null text has no terms but counts as a document; a query without known terms has no results; one
with fewer than `top` matching documents has them all; ties go to the newer turn, then the smaller id; rows of one id are
one document of all their texts and the newest turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from credence.functions import text as X
from credence.operators.retrieval import B, K1, MOST_TERMS

#: Steps of impact, folders of postings, postings read for the first bound.
LEVELS, BUCKETS, SEEDS = 32, 16, 64
#: Scores are rounded to nine places; bounds give way by more.
SLACK = 1e-7


_TABLES = {
    "lengths": "doc_id long, turn long, len long, tokens array<array<string>>",
    "postings": "term string, level int, doc_id long, impact double, bucket int",
    "blocks": "term string, level int, n long, most double",
    "terms": "term string, df long, most double, idf double",
    "documents": "doc_id long, turn long, weights map<string, double>",
}


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    @classmethod
    def create(cls, docs: DataFrame, path: str) -> TextIndex:
        """An index of docs (doc_id, turn, text)."""
        index = cls(docs.sparkSession, path)
        tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(X.TOKEN), F.lit(0))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("turn").cast("long").alias("turn"), tokens.alias("tokens"))
        whole = rows.groupBy("doc_id").agg(F.max("turn").alias("turn"), F.sum(F.size("tokens")).alias("len"), F.collect_list("tokens").alias("tokens"))
        whole.write.parquet(f"{index.path}/lengths")
        rows = index.table("lengths")
        n, length = rows.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(1.0))).first()  # one row
        counted = rows.select("doc_id", "len", F.explode(F.flatten("tokens")).alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(length)))
        level = F.least(F.floor(impact / (K1 + 1) * LEVELS), F.lit(LEVELS - 1)).cast("int")
        postings = counted.select("term", level.alias("level"), "doc_id", impact.alias("impact"), _bucket().alias("bucket"))
        postings.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("term", F.desc("level")).write.partitionBy("bucket").parquet(f"{index.path}/postings")
        postings = index.table("postings")
        postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("most")).write.parquet(f"{index.path}/blocks")
        df = F.sum("n").alias("df")
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        index.table("blocks").groupBy("term").agg(df, F.max("most").alias("most")).withColumn("idf", idf).write.parquet(f"{index.path}/terms")
        weights = postings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "impact"))).alias("weights"))
        rows.select("doc_id", "turn").join(weights, "doc_id").write.parquet(f"{index.path}/documents")
        return index

    def _postings(self, wanted: DataFrame) -> DataFrame:
        """query_id, term, doc_id, gain of the postings in the blocks of `wanted` (query_id, term, level, idf)."""
        return self.table("postings").join(wanted.withColumn("bucket", _bucket()), ["bucket", "term", "level"]).select("query_id", "term", "doc_id", (F.col("idf") * F.col("impact")).alias("gain"))

    def _scored(self, candidates: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, doc_id, turn, score of each candidate (query_id, doc_id) with all the query's terms."""
        sent = F.broadcast if asked.count() <= MOST_TERMS else (lambda df: df)
        rows = candidates.join(self.table("documents"), "doc_id").select("query_id", "doc_id", "turn", F.explode("weights").alias("term", "impact"))
        rows = rows.join(sent(asked.select("query_id", "term", "idf")), ["query_id", "term"])
        return rows.groupBy("query_id", "doc_id", "turn").agg(F.round(F.sum(F.col("idf") * F.col("impact")), 9).alias("score"))

    def plan(self, queries: DataFrame, top: int = 6) -> tuple[DataFrame, DataFrame]:
        """The known terms of each query (with their greatest gains, and `least`), and the blocks to be read."""
        from credence.operators.graph import cut

        wanted = queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term"))
        asked = cut(wanted.join(self.table("terms"), "term").select("query_id", "term", "idf", (F.col("idf") * F.col("most")).alias("can")), "asked")
        blocks = cut(asked.join(self.table("blocks").withColumnRenamed("most", "top"), "term").withColumn("gain", F.col("idf") * F.col("top")), "asked-blocks")
        best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
        seeds = blocks.withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))).filter(F.col("before") < SEEDS)
        scored = self._scored(self._postings(seeds.select("query_id", "term", "level", "idf")).select("query_id", "doc_id").distinct(), asked)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = scored.withColumn("place", place).filter(F.col("place") == top).select("query_id", (F.col("score") - SLACK).alias("least"))
        whole = Window.partitionBy("query_id")
        up = whole.orderBy("can", "term").rowsBetween(Window.unboundedPreceding, 0)
        terms = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        terms = terms.withColumn("all", F.sum("can").over(whole)).withColumn("brings", F.sum("can").over(up) >= F.col("least"))
        terms = cut(terms, "terms")
        needed = blocks.select("query_id", "term", "level", "n", "gain", "top").join(terms, ["query_id", "term"])
        needed = needed.withColumn("read", F.col("brings") & (F.col("gain") + F.col("all") - F.col("can") >= F.col("least")))
        return terms, cut(needed, "needed")

    def search(self, queries: DataFrame, top: int = 6) -> DataFrame:
        """query_id, doc_id, turn, score, rank: the best `top` of each query (query_id, text)."""
        terms, needed = self.plan(queries, top)
        found = self._postings(needed.filter("read").select("query_id", "term", "level", "idf"))
        # what a term can add to a document that its blocks read haven't brought in
        unknown = F.when(F.col("brings"), F.coalesce(F.max(F.when(~F.col("read"), F.col("gain"))), F.lit(0.0))).otherwise(F.first("can"))
        caps = needed.groupBy("query_id", "term", "brings").agg(unknown.alias("cap"))
        totals = caps.groupBy("query_id").agg(F.sum("cap").alias("caps")).join(terms.groupBy("query_id").agg(F.first("least").alias("least")), "query_id")
        known = found.join(caps.select("query_id", "term", "cap"), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("gain") - F.col("cap")).alias("more"))
        candidates = known.join(totals, "query_id").filter(F.col("more") + F.col("caps") >= F.col("least")).select("query_id", "doc_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("turn"), "doc_id"))
        return self._scored(candidates, terms).withColumn("rank", place).filter(F.col("rank") <= top)

    def share_read(self, queries: DataFrame, top: int = 6) -> float:
        """The postings that a search reads, the seeds besides, as a share of all postings of the queries' terms."""
        _, needed = self.plan(queries, top)
        read, whole = needed.agg(F.sum(F.when(F.col("read"), F.col("n"))), F.sum("n")).first()
        return (read or 0) / whole if whole else 0.0
