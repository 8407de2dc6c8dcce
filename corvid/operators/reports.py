"""Comparisons of runs, review state, candidates and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hygiene import keep_first, numbered, order_hash


def keyword_hit(text: Column, source: Column, keyword: Column) -> Column:
    low = F.lower(keyword)
    return F.contains(F.lower(text), low) | F.contains(F.lower(source), low)


def correctness(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (qid, difficulty, must_reject, keyword, allowed), hits (qid, text, source) -> qid, difficulty, correct.

    A case that must be rejected is right if it isn't allowed; another if any hit has its keyword.
    """
    found = hits.join(cases.select("qid", "keyword"), "qid").groupBy("qid").agg(F.max(keyword_hit(F.col("text"), F.col("source"), F.col("keyword"))).alias("found"))
    right = F.when(F.col("must_reject"), ~F.col("allowed")).otherwise(F.coalesce("found", F.lit(False)))
    return cases.join(found, "qid", "left").select("qid", "difficulty", right.alias("correct"))


def by_difficulty(rows: DataFrame, order: Sequence[str] = ("easy", "medium", "hard")) -> DataFrame:
    """difficulty, place, n, share right; levels without cases are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("difficulty"))
    return rows.groupBy("difficulty", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("share"))


def arms(results: DataFrame, threshold: float = 70.0) -> DataFrame:
    """results (model, arm, question, right 0/1, groundedness, seconds) -> a row a model and arm."""
    return results.groupBy("model", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("right"), 6).alias("accuracy"), F.round(F.avg("seconds"), 6).alias("seconds"),
        F.round(F.avg((F.col("groundedness") >= threshold).cast("int")), 6).alias("sensitivity_proxy"),
    )


def grid(summaries: DataFrame, arm_names: Sequence[str] = ("norag", "rag")) -> DataFrame:
    """model and the accuracy of each arm side by side, and the gain of the last over the first."""
    wide = summaries.groupBy("model").pivot("arm", list(arm_names)).agg(F.first("accuracy"))
    return wide.withColumn("gain", F.round(F.col(arm_names[-1]) - F.col(arm_names[0]), 6))


def agreement(results: DataFrame, truth: str = "rag", other: str = "norag") -> DataFrame:
    """model, tp, fp, fn, tn with one arm taken for the truth. This measures agreement of the arms, not correctness."""
    side = lambda name: results.where(F.col("arm") == name).select("model", "question", F.col("right").alias(name))
    both = side(truth).join(side(other), ["model", "question"])
    cell = lambda a, b: F.sum(((F.col(truth) == a) & (F.col(other) == b)).cast("long"))
    return both.groupBy("model").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def learning_curve(rows: DataFrame, key: Column, value: Column, sizes: Sequence[int], seed: str = "42") -> DataFrame:
    """size, n, mean of value over the first `size` rows of a fixed order."""
    placed = numbered(rows.withColumn("__v", value), key, seed)
    first = F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("__n"))
    spread = placed.where(F.col("__n") <= max(sizes)).select(F.explode(first).alias("size"), "__v")
    return spread.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("__v"), 6).alias("mean"))


def variation(text: Column, key: Column, prefixes: Sequence[str], suffixes: Sequence[str], seed: str = "42") -> Column:
    """The text between a prefix and a suffix that a hash of the key chooses."""
    digit = lambda i: F.conv(F.substring(order_hash(seed, key), i, 2), 16, 10).cast("int")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), digit(i) % len(names))
    return F.concat(pick(prefixes, 1), text, pick(suffixes, 3))


def pending(rows: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """The rows without a decision of yes or no."""
    done = decisions.where(F.lower(F.trim(F.coalesce("decision", F.lit("")))).isin("yes", "no"))
    return rows.join(done.select(key), key, "left_anti")


def reviewed(queue: DataFrame, commands: DataFrame) -> DataFrame:
    """queue (id, place from 1), commands (no from 1, key) -> id, decision: the n-th command is for the n-th item: yes, no, or null for a skip; nothing after a quit counts."""
    stop = commands.where(F.lower(F.trim("key")) == "q").agg(F.min("no").alias("stop"))
    said = commands.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("no") < F.col("stop")))  # one row
    decision = F.when(F.lower(F.trim("key")) == "y", "yes").when(F.lower(F.trim("key")) == "n", "no")
    return queue.join(said, F.col("place") == F.col("no"), "left").select("id", decision.alias("decision"))


def capped_candidates(rows: DataFrame, reserved: DataFrame, key: Column, group: str, cap: int, order: Column, least_chars: int = 0) -> DataFrame:
    """New rows (id, text, group): no reserved key, each key once, at most cap a group in the given order."""
    from .retrieval import ranked

    keyed = rows.where(F.length("text") >= least_chars).withColumn("key", key)
    fresh = keyed.join(reserved.select("key").distinct(), "key", "left_anti")
    return ranked(keep_first(fresh, F.col("key"), [F.col("id")]), [group], [order], cap, "place").drop("key")


def projection(rows: DataFrame, vec: str = "embedding", k: int = 2) -> DataFrame:
    """rows with point: the first k principal components."""
    data = rows.withColumn("__v", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(data)
    return model.transform(data).withColumn("point", vector_to_array("__p")).drop("__v", "__p")


__all__ = ["agreement", "arms", "by_difficulty", "capped_candidates", "correctness", "grid", "keyword_hit", "learning_curve", "pending", "projection", "reviewed", "variation"]
