"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code point order (null last) weigh 5, 2, 1,
repeating; their targets are shares of the total size, capped at 3 times the source's size, the
excess reshared by weight among the others. In each source the target is fitted thus:

1. of the target less DP_WORDS words, but of half the target at least, each exact length gives its
   share of copies, rounded down;
2. what then remains is filled from the longest length down to DP_WORDS words;
3. a bounded-knapsack dynamic program over the copies that each length has left, of MOST_COPIES a
   document, fills those last words as nearly as it can, by even copies if these reach the target.

That yields how many copies all documents of a length get, and how many of them one more; these are
those with the least seeded hash. The threshold, the k-th least hash of a (source, length) group, is
found in slices of the hash's range of about SLICE_ROWS rows, so that a group that holds a third of all rows is ranked by many tasks.

Defined results: null or empty text: size 0, taken 0. A null source is a source of its own.
Rows that repeat a doc_id with the same source and size are taken together. A source of size 0
has target 0. Empty table: empty result.

The plan has a row for each source and length; fit() holds one source's distinct lengths, at most
the square root of twice its words. The per-source totals pass through one task: a row a source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, columns_of, cut, fresh, maybe_broadcast

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DP_WORDS = 1 << 15
SLICE_ROWS = 1 << 16
SEED = 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """totals (source, source_size) with target: the fixed point of capping and resharing.

    In order of cap per weight, the capped sources come first; the first source whose share of
    what is left by weight doesn't exceed its cap ends them.
    """
    by_name = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rows = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", (MOST_COPIES * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    )
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def filled(lengths: list[int], counts: list[int], rest: int) -> list[int]:
    """How many of each length make up the greatest sum of at most rest: bounded knapsack, counts in powers of two."""
    out = [0] * len(lengths)
    rest = min(rest, sum(a * n for a, n in zip(lengths, counts, strict=True)))
    # Bit s of reach is set if s words can be filled.
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        left, power = min(counts[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            n = min(power, left)
            steps.append((i, n, reach))
            reach |= (reach << (n * lengths[i])) & mask
            left, power = left - n, power * 2
    s = reach.bit_length() - 1
    for i, n, had in reversed(steps):
        if not had >> s & 1:
            out[i] += n
            s -= n * lengths[i]
    return out


def fit(lengths: list[int], counts: list[int], target: float) -> tuple[list[int], list[int]]:
    """For each length how often all its documents are taken, and how many get one more copy; lengths ascend, from 1."""
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    if not total or target <= 0:
        return [0] * len(lengths), [0] * len(lengths)
    budget = min(round(target), MOST_COPIES * total)
    share = max(budget - DP_WORDS, budget // 2)
    taken = [share * n // total for n in counts]
    rest = budget - sum(a * x for a, x in zip(lengths, taken, strict=True))
    even = min(MOST_COPIES, budget // total + 1)  # copies of a document if all get as many, rounded up
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= DP_WORDS:
            break
        x = min(even * counts[i] - taken[i], (rest - DP_WORDS // 2) // lengths[i])
        taken[i] += x
        rest -= x * lengths[i]
    # Copies beyond the even ones stand first, so that they are only taken where the others can't fill the rest.
    last = filled([*lengths, *lengths], [(MOST_COPIES - even) * n for n in counts] + [even * n - x for n, x in zip(counts, taken, strict=True)], rest)
    taken = [x + y + z for x, y, z in zip(taken, last, last[len(lengths) :], strict=False)]
    return [x // n for x, n in zip(taken, counts, strict=True)], [x % n for x, n in zip(taken, counts, strict=True)]


def plan(slim: DataFrame) -> DataFrame:
    """slim (doc_id, source, size, h) -> source, size, source_size, target, every, more, h_most, id_most.

    A document is taken `every` times, and once more if (h, doc_id) is at most (h_most, id_most).
    """
    hist = cut(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    goals = goals.withColumnRenamed("source", "s")
    rows = hist.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        some = pdf["size"] > 0
        every, more = fit([int(a) for a in pdf.loc[some, "size"]], [int(n) for n in pdf.loc[some, "n"]], float(pdf["target"].iloc[0]))
        pdf["every"], pdf["more"] = 0, 0
        pdf.loc[some, "every"], pdf.loc[some, "more"] = every, more
        return pdf.astype({"every": "int64", "more": "int64"})

    fitted = cut(rows.groupBy("source").applyInPandas(one, "source string, size long, n long, source_size long, target double, every long, more long"))
    # The k-th least (h, doc_id) of the groups of which some but not all get one more copy.
    some = fitted.where("more > 0 and more < n").select("source", "size", "more")
    some = maybe_broadcast(some, some.count())
    most = fitted.agg(F.max("n")).first()[0] or 1
    slices = F.shiftright(F.col("h"), 64 - max(1, (most // SLICE_ROWS).bit_length()))  # signed, in the order of h
    ranked = slim.join(some.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("source", "size", "more", "h", "doc_id", slices.alias("slice"))
    per = ranked.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("in_slice"), F.first("more").alias("more"))
    up_to = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_slice").over(up_to), F.lit(0))).where("before < more and more <= before + in_slice")
    per = per.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("slice").alias("at"), (F.col("more") - F.col("before")).alias("k"))
    within = ranked.join(maybe_broadcast(per, per.count()), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("slice") == F.col("at")))
    nth = F.row_number().over(W.partitionBy("source", "size").orderBy("h", "doc_id"))
    edge = within.withColumn("nth", nth).where("nth = k").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("h").alias("h_most"), F.col("doc_id").alias("id_most"))
    out = fitted.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    return cut(out)


def copies(docs: DataFrame, rows: DataFrame, size: Column, h: Column, names: tuple[str, ...]) -> DataFrame:
    """rows of docs with what names has: size, source_size, target, copies. size and h: a row's size and hash."""
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))
    p = plan(cut(slim))
    name = fresh(rows, "__mix_plan")
    p = maybe_broadcast(p.select(F.col("source").alias(f"{name}s"), F.col("size").alias(f"{name}z"), F.struct("*").alias(name)), p.count())
    joined = rows.join(p, F.col("source").eqNullSafe(F.col(f"{name}s")) & (size == F.col(f"{name}z")))
    of = F.col(name)
    tie = (h == of["h_most"]) & (F.col("doc_id").isNull() | (F.col("doc_id") <= of["id_most"]))
    extra = (of["more"] > 0) & ((h < of["h_most"]) | tie)
    times = F.when(size > 0, of["every"] + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
    return joined.select(*columns_of(rows), *[c.alias(n) for c, n in zip((size, of["source_size"], of["target"], times), names, strict=True)])


def hash_of(doc_id: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("words"))
    out = copies(docs, rows, F.col("words"), hash_of(F.col("doc_id")), ("size", "source_size", "target", "copies"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    words, times = fresh(docs, "__mix_words"), fresh(docs, "__mix_times")
    rows = docs.withColumn(words, size_of(F.col("text")))
    out = copies(docs, rows, F.col(words), hash_of(F.col("doc_id")), (f"{words}a", f"{words}b", f"{words}c", times))
    again = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return out.where(F.col(times) > 0).select(*columns_of(docs), again.alias(times)).drop(times)
