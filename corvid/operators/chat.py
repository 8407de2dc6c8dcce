"""Conversation and log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, n: int = 4) -> DataFrame:
    """conv_id, history: the last n turns of each conversation in order, as lines."""
    no = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = messages.withColumn("no", no).where(F.col("no") <= n)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("history"))


def asked_before(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text, question of assistant turns: the last user turn before each."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    user = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return messages.withColumn("question", user).where("role = 'assistant'").select("conv_id", "turn", "text", "question")


def dashboard(log: DataFrame) -> DataFrame:
    """event_type, n, share, mean_value, and a row with a null type for all."""
    rows = log.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return rows.select("event_type", "n", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 6).alias("share"), F.round("mean_value", 6).alias("mean_value"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str, group: str) -> DataFrame:
    """The candidates that aren't seen; a group all of which is seen comes back whole."""
    left = candidates.join(seen.select(key).distinct(), key, "left_anti")
    open_ = left.select(group).distinct()
    return left.unionByName(candidates.join(open_, group, "left_anti"))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """node, depth of what a start node reaches over edges (src, dst), by rounds of joins on the frontier."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    frontier, depth = seen, 0
    while True:
        depth += 1
        new = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        rows = new.withColumn("depth", F.lit(depth)).persist()
        if rows.isEmpty():
            return seen
        seen, frontier = seen.unionByName(rows), rows
