"""Keeping datasets clean: duplicates, leaks, splits, audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions.text import fingerprint, space_key, words
from corvid.operators.lineage import cut


def order_hash(seed: str, key: Column) -> Column:
    """A fixed order that doesn't depend on the rows' order."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def keep_first(rows: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def keep_longest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and the longest text of each key, the least of equals; an aggregate, no sort."""
    best = F.max_by(F.struct(text), F.struct(F.length(text).alias("n"), F.xxhash64(text).alias("h")))
    return rows.groupBy(key).agg(best[text].alias(text))


def without_leaks(rows: DataFrame, key: Column, split: str = "split", order: Sequence[str] = ("test", "validation", "train")) -> DataFrame:
    """Each key stays in the first split of `order` that has it, once."""
    prio = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    return keep_first(rows, key, [prio, F.col("id")])


def numbered(rows: DataFrame, key: Column, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with __n, the place (from 1) of each row in the fixed order of its `by` group, and __all, the group's rows.

    Places are counted in 4096 slices of the order, so that no task ranks a whole table or a large group.
    """
    h = order_hash(seed, key)
    out = rows.withColumn("__h", h).withColumn("__s", F.substring(h, 1, 3))
    per = out.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy("__s"))
    per = per.select(*by, "__s", (upto - F.col("__c")).alias("__before"), F.sum("__c").over(W.partitionBy(*by)).alias("__all"))
    if by:
        same = [F.col(f"__p.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*by, "__s"]]
        out = out.alias("__r").join(per.alias("__p"), same).select("__r.*", "__p.__before", "__p.__all")
    else:
        out = out.join(F.broadcast(per), "__s")  # at most 4096 rows
    nth = F.row_number().over(W.partitionBy(*by, "__s").orderBy("__h", key))
    return out.withColumn("__n", nth + F.col("__before")).drop("__h", "__s", "__before")


def ratio_split(rows: DataFrame, key: Column, shares: Sequence[tuple[str, float]], seed: str = "42") -> DataFrame:
    """rows with split by cumulative shares of a fixed order."""
    out, test, upto = numbered(rows, key, seed), None, 0.0
    for name, share in shares[:-1]:
        upto += share
        cond = F.col("__n") <= F.floor(F.col("__all") * F.lit(round(upto, 9)))
        test = F.when(cond, name) if test is None else test.when(cond, name)
    return out.withColumn("split", test.otherwise(shares[-1][0])).drop("__all", "__n")


def group_split(rows: DataFrame, group: Sequence[str], shares: Sequence[tuple[str, float]], seed: str = "42") -> DataFrame:
    """Whole groups go to one split."""
    groups = rows.select(*group).distinct()
    split = ratio_split(groups, F.concat_ws("|", *group), shares, seed)
    return rows.join(split, list(group))


def stratified(rows: DataFrame, label: str, key: Column, share: float, seed: str = "42") -> DataFrame:
    """rows with split: the first `share` of each label in a fixed order is test."""
    out = numbered(rows, key, seed, [label])
    return out.withColumn("split", F.when(F.col("__n") <= F.floor(F.col("__all") * F.lit(share)), "test").otherwise("train")).drop("__n", "__all")


def folds(rows: DataFrame, label: str, key: Column, k: int = 5, seed: str = "42") -> DataFrame:
    """rows with fold, 0 to k - 1, even within each label."""
    return numbered(rows, key, seed, [label]).withColumn("fold", ((F.col("__n") - 1) % k).cast("int")).drop("__n", "__all")


def near_duplicates(rows: DataFrame, text: str = "text", threshold: float = 0.92) -> DataFrame:
    """Pairs a < b of rows (id, text) whose fingerprints' word sets overlap by `threshold` of the larger set.

    Candidates share a word among the rarest of a row: two sets that overlap by t of the larger share
    one of their first n - ceil(t * n) + 1 words in any common order, here by rising frequency.
    Equal sets are compared once: rows of one set are represented by the least id.
    """
    sets = rows.select("id", F.array_sort(F.array_distinct(words(fingerprint(F.col(text))))).alias("w")).where(F.size("w") > 0)
    reps = sets.groupBy("w").agg(F.min("id").alias("rep"))
    freq = reps.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = reps.select("rep", F.explode("w").alias("t")).join(freq, "t").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: F.xxhash64(x["t"])).alias("w"))
    ranked = cut(ranked.withColumn("n", F.size("w")))
    lead = F.slice("w", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1).cast("int"))
    keys = ranked.select("rep", "n", F.posexplode(lead).alias("i", "k"))
    a, b = keys.alias("a"), keys.alias("b")
    # What is left of either row from the shared word on has to hold the whole overlap.
    most, left = F.greatest("a.n", "b.n"), F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.rep") < F.col("b.rep")) & (F.least("a.n", "b.n") >= threshold * most - 1e-9) & (left >= threshold * most - 1e-9)
    met = a.join(b, on).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    side = lambda k: ranked.select(F.col("rep").alias(k), F.col("w").alias(f"w{k}"))
    near = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", near.alias("similarity")).where(F.col("similarity") >= threshold)
    same = sets.join(reps, "w").where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(same)


def reject_near_duplicates(rows: DataFrame, text: str = "text", threshold: float = 0.92) -> DataFrame:
    """rows (id, text) with accepted: in the order of id, a row is rejected if one accepted before it is a near duplicate.

    Each round accepts the rows whose earlier near duplicates are all rejected, and rejects those with an accepted one;
    there are as many rounds as the longest chain of such decisions.
    """
    found = cut(near_duplicates(rows, text, threshold))
    copies = found.where("similarity = 1").select(F.col("b").alias("node"))  # either the row they equal is accepted, or what rejects it rejects them
    pairs = found.where("similarity < 1").select("a", "b")
    state = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("accepted", F.lit(None).cast("boolean")))
    while not state.where("accepted is null").isEmpty():
        first = pairs.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.coalesce("accepted", F.lit(False))).alias("beaten"), F.min(F.when(F.col("accepted").isNull(), False).otherwise(True)).alias("known"))
        now = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("beaten"), False).when(F.coalesce("known", F.lit(True)), True)
        state = cut(state.join(first, "node", "left").select("node", now.alias("accepted")))
    gone = state.where("not accepted").select("node").unionByName(copies).distinct()
    out = rows.join(gone.select(F.col("node").alias("id"), F.lit(False).alias("accepted")), "id", "left")
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def resumed(questions: DataFrame, done: DataFrame, evaluate: Callable[[DataFrame], DataFrame], key: str = "question_id") -> DataFrame:
    """done with the evaluation of the questions whose key it hasn't; a key that comes twice is evaluated once."""
    new = questions.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return done.unionByName(evaluate(new).select(*done.columns))


def validation(rows: DataFrame, n: int, per_label: dict[str, int], types: Sequence[str]) -> DataFrame:
    """rows (id, text, label, type) -> rule, found, ok: the number of rows and of each label, unique ids, duplicate questions, unknown types."""
    by = [F.sum((F.col("label") == k).cast("long")).alias(f"label {k}") for k in per_label]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.coalesce(F.col("type").isin(*types), F.lit(False))).cast("long")).alias("unknown types"), *by)
    repeated = lambda key, name: rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(name))
    one = sums.crossJoin(repeated(F.col("id"), "repeated ids")).crossJoin(repeated(space_key(F.col("text")), "repeated questions"))  # a row each
    want = {"rows": n, "unknown types": 0, "repeated ids": 0, "repeated questions": 0} | {f"label {k}": v for k, v in per_label.items()}
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias("found"), F.lit(v).alias("want")) for k, v in want.items()])
    return one.select(F.explode(rules).alias("r")).select("r.rule", "r.found", (F.col("r.found") == F.col("r.want")).alias("ok"))


def label_conflicts(rows: DataFrame, cosine_of: Column, threshold: float = 0.75) -> DataFrame:
    """rows: pairs (a_id, b_id, a_label, b_label, vectors) -> those with different labels above the threshold."""
    return rows.where((F.col("a_label") != F.col("b_label")) & (cosine_of > threshold))


def cross_split_keys(rows: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """key, splits of keys that stand in more than one split."""
    out = rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return out.where(F.size("splits") > 1)


def overlap_audit(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (id, text), old (text, file) -> id, text, file, matched text of equal normalised questions."""
    known = old.select(space_key(F.col("text")).alias("key"), F.col("text").alias("matched"), "file").distinct()
    return new.withColumn("key", space_key(F.col("text"))).join(known, "key").select("id", "text", "file", "matched")


def audit(rows: DataFrame, labels: Sequence[str], least: int = 15) -> DataFrame:
    """rows (id, text, label, split) -> id, issue: one row for each rule that a row breaks."""
    key = space_key(F.col("text"))
    base = rows.withColumn("key", key)
    marked = base.join(base.groupBy("split", "key").agg(F.min("id").alias("first")), ["split", "key"], "left")
    leaks = base.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").select("key", F.lit(True).alias("leak"))
    marked = marked.join(leaks, "key", "left")
    rules = {
        "unknown label": ~F.coalesce(F.col("label").isin(*labels), F.lit(False)),
        "empty text": F.coalesce(F.trim("text") == "", F.lit(True)),
        "short text": F.length(F.trim("text")) < least,
        "duplicate in split": F.col("id") != F.col("first"),
        "in several splits": F.coalesce("leak", F.lit(False)),
    }
    issues = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return marked.select("id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def templates(rows: DataFrame, n: int = 4, top: int = 15) -> DataFrame:
    """template (the first n small-letter words), n_rows: the most frequent ones."""
    t = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, n), " ")
    return rows.groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("n_rows").desc(), "template").limit(top)
