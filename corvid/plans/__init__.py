"""Whole plans: retrieval for sets of questions, and its ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import legal_reference
from corvid.operators import retrieval as r
from corvid.operators.routing import route


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str = "constitution", depth: int = 10, fused: int = 8, final: int = 4, limit: float = r.DISTANCE_LIMIT) -> DataFrame:
    """questions (qid, text, qvec), chunks (cid, source, text), vectors (cid, vec) -> qid, domain, allowed, min_distance, rk, cid, text.

    Route, gate by distance before the lexical search (its hits would be thrown away), fuse, rerank,
    put explicitly named provisions first. A question without hits has one row with a null rk.
    """
    ref = legal_reference(F.col("text"))
    q = questions.select("qid", F.col("text").alias("question"), "qvec", route(F.col("text"), F.lit(model)).alias("domain"), ref["kind"].alias("kind"), ref["number"].alias("number"))
    dense = r.dense_search(q.select("qid", "qvec"), vectors, depth)
    nearest = dense.groupBy("qid").agg(F.min("min_distance").alias("min_distance"))
    state = q.join(nearest, "qid", "left").withColumn("min_distance", F.coalesce("min_distance", F.lit(r.NO_DISTANCE)))
    state = state.withColumn("allowed", (F.col("domain") != "out_of_domain") & (F.col("min_distance") <= limit))
    go = state.where("allowed")
    sparse = r.Bm25.build(chunks.select("cid", "text")).search(go.select("qid", F.col("question").alias("text")), depth)
    best = r.fuse(dense.join(go.select("qid"), "qid", "left_semi"), sparse, top_n=fused)
    candidates = best.join(go.select("qid", "question"), "qid").join(chunks.select("cid", "text"), "cid")
    top = r.rerank(candidates, final).select("qid", "text", "rk")
    exact = r.exact_provisions(go.where("number is not null"), chunks)
    hits = r.prepend(exact, top, final)
    return state.select("qid", "domain", "allowed", "min_distance").join(hits.select("qid", "rk", "text"), "qid", "left")


def variants(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, depth: int = 10) -> DataFrame:
    """variant, qid, cid, rk of dense, bm25, rrf and rerank: the ablation's long table."""
    dense = r.dense_search(questions.select("qid", "qvec"), vectors, depth)
    sparse = r.Bm25.build(chunks.select("cid", "text")).search(questions.select("qid", "text"), depth)
    fused = r.fuse(dense, sparse, top_n=8)
    again = r.rerank(fused.join(questions.select("qid", F.col("text").alias("question")), "qid").join(chunks.select("cid", "text"), "cid"), 4)
    parts = {"dense": dense, "bm25": sparse, "rrf": fused, "rerank": again}
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("variant"), "qid", "cid", "rk")
        out = rows if out is None else out.unionByName(rows)
    return out


def bypass(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, depth: int = 10, fused: int = 10, final: int = 6) -> DataFrame:
    """questions (qid, text, qvec) -> qid, cid, rk: fused and reranked without routing, gate or exact provisions."""
    dense = r.dense_search(questions.select("qid", "qvec"), vectors, depth)
    sparse = r.Bm25.build(chunks.select("cid", "text")).search(questions.select("qid", "text"), depth)
    best = r.fuse(dense, sparse, top_n=fused).join(questions.select("qid", F.col("text").alias("question")), "qid")
    return r.rerank(best.join(chunks.select("cid", "text"), "cid"), final).select("qid", "cid", "rk")
