"""Scores of answers and rankings, and the metrics of classifications, as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions.text import dot_sentences, sentences, tokens
from corvid.functions.vectors import cosine


def guarded(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(default))


def f1_of(p: Column, r: Column) -> Column:
    return guarded(2 * p * r, p + r)


# Answers ---------------------------------------------------------------------------------------


def overlap(pairs: DataFrame, a: Column, b: Column, key: str = "id") -> DataFrame:
    """key, precision, recall, f1 of the multisets of array columns a (answer) and b (reference); 0 where one is empty.

    Tokens of both sides are counted by (key, token) with partial sums before the shuffle.
    """
    side = lambda col, first: pairs.select(key, F.explode(col).alias("t")).select(key, "t", F.lit(first).alias("in_a"))
    both = side(a, 1).unionByName(side(b, 0)).groupBy(key, "t").agg(F.sum("in_a").alias("na"), F.sum(1 - F.col("in_a")).alias("nb"))
    sums = both.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("common"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    out = pairs.select(key).join(sums, key, "left")
    p, r = guarded(F.col("common"), F.col("na")), guarded(F.col("common"), F.col("nb"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.select(key, "precision", "recall", f1_of(F.col("precision"), F.col("recall")).alias("f1"))


def answer_metrics(pairs: DataFrame, key: str = "id", answer: str = "answer", reference: str = "reference", threshold: float = 0.3) -> DataFrame:
    """Token overlap in per cent with one decimal, and accuracy: f1 of at least threshold."""
    out = overlap(pairs, tokens(F.col(answer)), tokens(F.col(reference)), key)
    pct = lambda c: F.round(100 * F.col(c), 1).alias(c)
    return out.select(key, pct("precision"), pct("recall"), pct("f1"), F.when(F.col("f1") >= threshold, 100.0).otherwise(0.0).alias("accuracy"))


def token_share(sentence: Column, chunk: Column) -> Column:
    """The share of a sentence's distinct tokens that a chunk has: stands in for an entailment probability."""
    s = F.array_distinct(tokens(sentence))
    return guarded(F.size(F.array_intersect(s, tokens(chunk))), F.size(s))


def groundedness(answers: DataFrame, contexts: DataFrame, scorer: Callable[[Column, Column], Column] = token_share) -> DataFrame:
    """answers (id, answer), contexts (id, text) -> id, groundedness: mean over sentences of the best context, in per cent.

    Contexts of an answer are the few it was given; a sentence meets those only. 0 without sentences or contexts.
    Shares are added in the order of the sentences: at half a tenth another order may round to the other side.
    """
    sents = answers.select("id", F.posexplode(dot_sentences(F.col("answer"))).alias("no", "s"))
    pairs = sents.join(contexts.where(F.trim("text") != "").select("id", "text"), "id")
    best = pairs.groupBy("id", "no").agg(F.max(scorer(F.col("s"), F.col("text"))).alias("p"))
    shares = best.where("p IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "p"))).alias("ps"))
    mean = shares.select("id", (F.aggregate("ps", F.lit(0.0), lambda total, x: total + x["p"]) / F.size("ps")).alias("p"))
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.coalesce("p", F.lit(0.0))))
    # Tenths are rounded as whole numbers: Spark's round(x, 1) goes by the printed digits, and 1.8499999999999999 would be 1.8.
    return answers.select("id").join(mean, "id", "left").select("id", (F.round(10 * pct) / 10).alias("groundedness"))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Counts of tokens hashed into dim places: a deterministic stand-in for a sentence embedding."""
    places = F.transform(tokens(text), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def soft_f1(pairs: DataFrame, key: str = "id", longer_than: int = 0, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """key, precision, recall, f1: means of each sentence's best cosine among the other side's; null without sentences."""
    side = lambda c, name: pairs.select(key, F.posexplode(sentences(F.col(c), longer_than)).alias(f"{name}_no", "s")).select(key, f"{name}_no", embed(F.col("s")).alias(f"{name}_v"))
    sim = side("answer", "a").join(side("reference", "b"), key).select(key, "a_no", "b_no", cosine(F.col("a_v"), F.col("b_v")).alias("c"))
    mean_best = lambda no, name: sim.groupBy(key, no).agg(F.max("c").alias("c")).groupBy(key).agg(F.avg("c").alias(name))
    out = pairs.select(key).join(mean_best("a_no", "precision"), key, "left").join(mean_best("b_no", "recall"), key, "left")
    return out.select(key, "precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)).alias("f1"))


# Rankings --------------------------------------------------------------------------------------


def ranking_rows(hits: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """hits (qid, rk, source), gold (qid, expected) -> qid, expected, rank of the first right hit, rr, success, hit<k>."""
    first = hits.join(gold, "qid").where(F.col("source") == F.col("expected")).groupBy("qid").agg(F.min("rk").alias("rank"))
    any_ = hits.select("qid").distinct().withColumn("success", F.lit(True))
    out = gold.join(first, "qid", "left").join(any_, "qid", "left")
    cols = [F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit{k}") for k in ks]
    return out.select("qid", "expected", "rank", guarded(F.lit(1.0), F.col("rank")).alias("rr"), F.coalesce("success", F.lit(False)).alias("success"), *cols)


def ranking_summary(rows: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Counts, Hit@k in per cent and MRR for each grouping set of `by` and for all; denominators hold every row."""
    pct = [F.round(100 * F.avg(F.col(f"hit{k}").cast("int")), 6).alias(f"hit{k}") for k in ks]
    cube = rows.rollup(*by) if by else rows.groupBy()
    return cube.agg(F.count(F.lit(1)).alias("n"), *pct, F.round(F.avg("rr"), 6).alias("mrr"), F.round(100 * F.avg(F.col("success").cast("int")), 6).alias("success"))


def k_sweep(hits: DataFrame, gold: DataFrame, ks: Sequence[int] = (2, 4, 6, 8, 10)) -> DataFrame:
    """k, hit rate in per cent at each k of one ranked table."""
    rows = ranking_rows(hits, gold, ks)
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").cast("int").alias("hit")) for k in ks])).alias("x")).select("x.*")
    return stacked.groupBy("k").agg(F.round(100 * F.avg("hit"), 6).alias("hit_rate"))


# Classifications -------------------------------------------------------------------------------


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """actual, predicted, n for every pair of labels that either column has, zeros included; share of the actual's rows."""
    counts = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).distinct().where("l is not null")
    spine = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))  # labels are few by nature
    out = spine.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])
    return out.withColumn("share", F.round(guarded(F.col("n"), F.sum("n").over(W.partitionBy("actual"))), 6))


def one_vs_rest(matrix: DataFrame) -> DataFrame:
    """label, tp, fp, fn, tn from confusion()."""
    total = W.partitionBy()
    rows = matrix.withColumn("total", F.sum("n").over(total)).withColumn("rows", F.sum("n").over(W.partitionBy("actual"))).withColumn("cols", F.sum("n").over(W.partitionBy("predicted")))
    out = rows.where("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("tp"), (F.col("cols") - F.col("n")).alias("fp"), (F.col("rows") - F.col("n")).alias("fn"), "total")
    return out.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).drop("total")


def class_report(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; and the rows `macro avg`, `weighted avg`, `accuracy`."""
    per = one_vs_rest(matrix).withColumn("support", F.col("tp") + F.col("fn"))
    per = per.withColumn("precision", guarded(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", guarded(F.col("tp"), F.col("support")))
    per = per.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    names = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per.agg(*[guarded(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    acc = per.agg(guarded(F.sum("tp"), F.sum("support")).alias("precision"), F.sum("support").alias("support")).withColumn("recall", F.col("precision")).withColumn("f1", F.col("precision")).withColumn("label", F.lit("accuracy"))
    cols = ["label", *[F.round(c, 6).alias(c) for c in names], "support"]
    out = per.select(F.col("label").cast("string").alias("label"), *names, "support")
    for extra in (macro, weighted, acc):
        out = out.unionByName(extra.select("label", *names, "support"))
    return out.select(*cols)


def diagnostics(counts: DataFrame) -> DataFrame:
    """label and sensitivity, specificity, ppv, npv, lr_plus, lr_minus of rows with tp, fp, fn, tn; 0 or infinity where undefined."""
    c = F.col
    out = counts.withColumn("sensitivity", guarded(c("tp"), c("tp") + c("fn"))).withColumn("specificity", guarded(c("tn"), c("tn") + c("fp")))
    out = out.withColumn("ppv", guarded(c("tp"), c("tp") + c("fp"))).withColumn("npv", guarded(c("tn"), c("tn") + c("fn")))
    inf = F.lit(float("inf"))
    return out.withColumn("lr_plus", F.when(c("specificity") < 1, c("sensitivity") / (1 - c("specificity"))).otherwise(inf)).withColumn("lr_minus", F.when(c("specificity") > 0, (1 - c("sensitivity")) / c("specificity")).otherwise(inf))


def threshold_sweep(scores: DataFrame, steps: int = 60, margin: float = 0.1) -> DataFrame:
    """scores (distance, actual 0/1) -> no, threshold, accuracy, precision, recall, f1 where distance <= threshold predicts 1.

    Distances are first counted by the step they fall into, so each row is read once and `steps` rows are summed.
    """
    lo, hi = scores.agg(F.min("distance"), F.max("distance")).first()
    if lo is None:
        lo = hi = 0.0
    lo, hi = max(0.0, lo - margin), hi + margin
    width = (hi - lo) / (steps - 1)
    at = lambda i: F.lit(lo) + i * F.lit(width)
    guess = F.greatest(F.lit(0), F.ceil((F.col("distance") - lo) / width).cast("int") - 1)
    first = F.when(F.col("distance") <= at(guess), guess).when(F.col("distance") <= at(guess + 1), guess + 1).otherwise(guess + 2)
    binned = scores.select(first.alias("no"), F.col("actual").cast("long").alias("y")).groupBy("no").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    spine = scores.sparkSession.range(steps).select(F.col("id").cast("int").alias("no"))
    up = W.orderBy("no").rowsBetween(W.unboundedPreceding, 0)  # over `steps` rows
    cum = spine.join(binned, "no", "left").fillna(0).withColumn("tp", F.sum("p").over(up)).withColumn("said", F.sum("n").over(up))
    all_p, all_n = scores.agg(F.sum(F.col("actual").cast("long")), F.count(F.lit(1))).first()
    all_p = all_p or 0
    p, r = guarded(F.col("tp"), F.col("said")), guarded(F.col("tp"), F.lit(all_p))
    right = F.col("tp") + (F.lit(all_n) - all_p - (F.col("said") - F.col("tp")))
    out = cum.select("no", at(F.col("no")).alias("threshold"), guarded(right, F.lit(all_n)).alias("accuracy"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def curve(scores: DataFrame, slices: int = 256) -> DataFrame:
    """scores (score, actual 0/1) -> score, y, c, tp, fp, p, n: cumulative counts by descending distinct score.

    Counts are combined by score first. The running sums then go slice by slice: quantiles cut the
    scores into slices, the slices' totals (a few hundred rows) give each its start, and tasks sum
    their slices on their own.
    """
    per = scores.groupBy("score").agg(F.sum(F.col("actual").cast("long")).alias("y"), F.count(F.lit(1)).alias("c"))
    cuts = sorted(set(per.approxQuantile("score", [i / slices for i in range(1, slices)], 0.001) or []))
    at = F.array_position(F.transform(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda x: F.col("score") <= x), True).cast("int")
    per = per.withColumn("slice", F.when(at == 0, F.lit(len(cuts) + 1)).otherwise(at))
    total = per.groupBy("slice").agg(F.sum("y").alias("sy"), F.sum("c").alias("sc"))
    above = W.orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    zero, whole = F.lit(0).cast("long"), W.partitionBy()
    start = total.select("slice", F.coalesce(F.sum("sy").over(above), zero).alias("y0"), F.coalesce(F.sum("sc").over(above), zero).alias("c0"), F.sum("sy").over(whole).alias("p"), F.sum("sc").over(whole).alias("all"))
    down = W.partitionBy("slice").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = per.join(F.broadcast(start), "slice").withColumn("tp", F.sum("y").over(down) + F.col("y0")).withColumn("said", F.sum("c").over(down) + F.col("c0"))
    return out.select("score", "y", "c", "tp", (F.col("said") - F.col("tp")).alias("fp"), "p", (F.col("all") - F.col("p")).alias("n"))


def roc(scores: DataFrame) -> DataFrame:
    """score, fpr, tpr."""
    return curve(scores).select("score", guarded(F.col("fp"), F.col("n")).alias("fpr"), guarded(F.col("tp"), F.col("p")).alias("tpr"))


def areas(scores: DataFrame) -> DataFrame:
    """auc (trapezoids) and average_precision; a point's predecessor follows from its own counts."""
    c = F.col
    rows = curve(scores).withColumn("t1", guarded(c("tp"), c("p"))).withColumn("f1", guarded(c("fp"), c("n"))).withColumn("prec", guarded(c("tp"), c("tp") + c("fp")))
    rows = rows.withColumn("t0", guarded(c("tp") - c("y"), c("p"))).withColumn("f0", guarded(c("fp") - c("c") + c("y"), c("n")))
    return rows.agg(F.round(F.sum((c("f1") - c("f0")) * (c("t1") + c("t0")) / 2), 6).alias("auc"), F.round(F.sum((c("t1") - c("t0")) * c("prec")), 6).alias("average_precision"))


# Columns of figures ----------------------------------------------------------------------------


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean (0 if empty), true and upper median, min, max, quartiles."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("mean"), F.median(v).alias("median"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias("upper_median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3"),
    )


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """bin (1 to bins), n; the last bin is closed; empty bins included; values outside aren't counted."""
    inside = rows.where(F.col(value).between(lo, hi))
    no = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins))
    counts = inside.groupBy(no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)


def rank_band(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank.between(2, 3), "2-3").when(rank.between(4, 5), "4-5").otherwise("miss")
