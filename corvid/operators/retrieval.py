"""Lexical and vector retrieval over sets of questions, as joins, aggregates and ranked windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions.text import provision, tokens
from corvid.functions.vectors import cosine, squared_l2

#: BM25 parameters; tables of at most so many rows and, in all, bytes are broadcast.
K1, B, EPSILON = 1.5, 0.75, 0.25
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
DISTANCE_LIMIT = 1.35
NO_DISTANCE = 999.0
#: The files that Articles and Sections are looked up in.
ARTICLE_SOURCE, SECTION_SOURCE = "constitution_of_india.pdf", "consumer_protection_act_2019.pdf"
#: Phrases in a page's first 500 characters that mark tables of contents and schedules.
NOT_PROVISIONS = ["contents", "seventh schedule", "eighth schedule", "ninth schedule", "tenth schedule", "eleventh schedule", "twelfth schedule", "appendix"]


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows and, as JSON, bytes; else Spark chooses the join."""
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if max(n, rows or 0) <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rk") -> DataFrame:
    """The first k rows of each `by` in order, numbered from 1. The limit is pushed below the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


# Vector search ---------------------------------------------------------------------------------


def dense_search(questions: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """questions (qid, qvec), vectors (cid, vec) -> qid, cid, distance, rk, min_distance: the k nearest by squared L2.

    A stated set of questions against all vectors: questions go to the vectors, block by block of a
    checked size, and each task keeps its k nearest before the shuffle.
    """
    pairs = vectors.join(checked_broadcast(questions), how="cross").select("qid", "cid", squared_l2(F.col("qvec"), F.col("vec")).alias("distance"))
    top = ranked(pairs, ["qid"], [F.col("distance"), F.col("cid")], k)
    return top.withColumn("min_distance", F.min("distance").over(W.partitionBy("qid")))


def search_uploaded(questions: DataFrame, chunks: DataFrame, top_n: int = 2) -> DataFrame:
    """questions (qid, qvec), chunks (cid, vec) -> qid, cid, similarity, rk by cosine; of equals the later chunk first."""
    pairs = chunks.join(checked_broadcast(questions), how="cross").select("qid", "cid", cosine(F.col("qvec"), F.col("vec")).alias("similarity"))
    return ranked(pairs, ["qid"], [F.col("similarity").desc(), F.col("cid").desc()], top_n)


# BM25 ------------------------------------------------------------------------------------------


class Bm25:
    """The index as tables: tf (cid, dl, term, tf), idf (term, idf), and avgdl."""

    def __init__(self, tf: DataFrame, idf: DataFrame, avgdl: float):
        self.tf, self.idf, self.avgdl = tf, idf, avgdl

    @classmethod
    def build(cls, chunks: DataFrame) -> Bm25:
        """chunks (cid, text). Texts are dealt by cid and tokenised once; counts, and later scores, need no further shuffle. The counts are kept, since df and search both read them."""
        toks = chunks.select("cid", "text").repartition("cid").select("cid", tokens(F.col("text")).alias("t"))
        tf = toks.select("cid", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("cid", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).persist()
        n = chunks.count()
        avgdl = (tf.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
        raw = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        idf = raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
        return cls(tf, idf, avgdl or 1.0)

    def write(self, path: str) -> None:
        """As Parquet, the postings sorted by term within files so that a term's row groups are skipped to."""
        self.tf.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/tf")
        self.idf.withColumn("avgdl", F.lit(self.avgdl)).write.mode("overwrite").parquet(f"{path}/idf")

    @classmethod
    def read(cls, spark, path: str) -> Bm25:
        idf = spark.read.parquet(f"{path}/idf")
        first = idf.select("avgdl").first()
        return cls(spark.read.parquet(f"{path}/tf"), idf.drop("avgdl"), first[0] if first else 1.0)

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """questions (qid, text) -> qid, cid, score, rk. A repeated question token counts each time; documents without any don't appear."""
        terms = questions.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
        weights = terms.join(self.idf, "term").withColumn("w", F.col("idf") * F.col("qn"))
        hits = self.tf.join(checked_broadcast(weights.select("qid", "term", "w")), "term")
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / self.avgdl))
        scores = hits.groupBy("cid", "qid").agg(F.sum(part).alias("score"))
        return ranked(scores, ["qid"], [F.round("score", 9).desc(), F.col("cid")], k)


# Fusion and reranking --------------------------------------------------------------------------


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, top_n: int = 4, key: str = "cid") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, rk): qid, key, rrf, rk; ties go to the dense list, then to the better rank."""
    lists = dense.select("qid", key, "rk", F.lit(0).alias("src")).unionByName(sparse.select("qid", key, "rk", F.lit(1).alias("src")))
    both = lists.groupBy("qid", key).agg(F.sum(F.lit(1.0) / (k + F.col("rk"))).alias("rrf"), F.min(F.struct("src", "rk")).alias("first"))
    return ranked(both, ["qid"], [F.round("rrf", 12).desc(), F.col("first")], top_n).select("qid", key, "rrf", "rk")


def containment(question: Column, text: Column) -> Column:
    """The share of a question's distinct tokens that the text has: the default scorer."""
    q = F.array_distinct(tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, top_n: int = 4, scorer: Callable[[Column, Column], Column] = containment) -> DataFrame:
    """candidates (qid, cid, question, text, rk) -> the best top_n by scorer, then by their rank before; scorer may wrap a pandas UDF."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("text"))).withColumnRenamed("rk", "fused_rk")
    return ranked(scored, ["qid"], [F.round("rerank_score", 12).desc(), F.col("fused_rk")], top_n)


def exact_provisions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (qid, kind, number, domain), chunks (cid, source, text) -> qid, cid, text of explicitly named provisions.

    An Article gives the slice up to the next heading of pages that aren't contents or schedules; a
    Section gives the whole chunk. Headings are taken out once a chunk, and joined by number.
    """
    first = F.lower(F.substring("text", 1, 500))
    listed = F.lit(False)
    for phrase in NOT_PROVISIONS:
        listed = listed | F.contains(first, F.lit(phrase))
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit("(?m)^\\s*(\\d+[A-Za-z]?)\\.\\s+[A-Za-z]"), F.lit(1)))
    rows = chunks.select("cid", "source", "text", listed.alias("listed"), F.explode(numbers).alias("number"))
    article = (F.col("kind") == "article") & (F.col("domain") == "constitution") & (F.lower("source") == ARTICLE_SOURCE) & ~F.col("listed")
    section = (F.col("kind") == "section") & (F.col("domain") == "consumer_protection") & (F.lower("source") == SECTION_SOURCE)
    hits = rows.join(questions.select("qid", "kind", "number", "domain"), "number").where(article | section)
    return hits.select("qid", "cid", F.when(F.col("kind") == "article", provision(F.col("text"), F.col("number"))).otherwise(F.col("text")).alias("text"))


def prepend(exact: DataFrame, rest: DataFrame, limit: int = 4, key: str = "text") -> DataFrame:
    """exact (qid, key) before rest (qid, key, rk) without what exact already has; the first `limit`, numbered."""
    unique = exact.select("qid", key).distinct()
    left = rest.join(unique, ["qid", key], "left_anti").select("qid", key, F.lit(1).alias("prio"), "rk")
    lead = exact.groupBy("qid", key).agg(F.min("cid").alias("rk")) if "cid" in exact.columns else exact.select("qid", key, F.lit(0).alias("rk"))
    both = lead.select("qid", key, F.lit(0).alias("prio"), F.col("rk").cast("long").alias("rk")).unionByName(left.withColumn("rk", F.col("rk").cast("long")))
    return ranked(both.withColumnRenamed("rk", "own_rk"), ["qid"], [F.col("prio"), F.col("own_rk"), F.col(key)], limit)


def gate(hits: DataFrame, limit: float = DISTANCE_LIMIT) -> DataFrame:
    """Hits with allowed: whether the question's nearest distance is within the limit, and NO_DISTANCE for none."""
    d = F.coalesce("min_distance", F.lit(NO_DISTANCE))
    return hits.withColumn("min_distance", d).withColumn("allowed", d <= limit)
