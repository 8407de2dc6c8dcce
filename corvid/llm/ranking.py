"""Quality classifier: Bradley-Terry ranking from preference pairs.

Documents are described by the rule statistics of rules.py, each split into bins. A pair prefers a
document labelled 1 to one labelled 0; the weights minimise the logistic loss of the difference of
the pair's features. The threshold is a quantile of the scores of all labelled rows that aren't held
out: of the quantiles in steps of a half per cent, the one with the best balanced accuracy on them. The returned score is a
logistic function of the ranking score that puts the threshold at 0.3.

The weights are learned from at most about TRAIN_ROWS labelled rows, chosen by a hash of doc_id, whose
crc32(doc_id) mod 5 is not 0, and PAIRS pairs of them.

Defined results: null or empty text has zero counts and gets a score like any other. A null doc_id
joins no label and is not held out. Without both labels every score is 0.5. Repeated rows: equal
results. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_fold, unit_hash
from .rules import COUNTS, counted_table, shares

TRAIN_ROWS, PAIRS, SEED = 20_000, 100_000, 5
BINS, L2, ROUNDS = 12, 1e-3, 30
#: Steps of a score; at most 60 * STEPS + 1 of them are counted.
STEPS = 1000
CUT = 0.3


def describe(c: pd.DataFrame) -> np.ndarray:
    """The statistics of rules.py and what depends on the length."""
    n = np.maximum(c["n_words"], 1)
    return np.column_stack([shares(c), np.log1p(c["n_words"]), c["n_distinct"] / n, np.log1p(c["n_bytes"] / np.maximum(c["n_lines"], 1)), c["n_symbols"] / n])


class BradleyTerry:
    def __init__(self, counts: pd.DataFrame, good: np.ndarray):
        self.w = None
        if len(set(good.tolist())) < 2:
            return
        x, rng = describe(counts), np.random.default_rng(SEED)
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
        z, up, down = self.bins(x), np.flatnonzero(good), np.flatnonzero(~good)
        diff = z[rng.choice(up, PAIRS)] - z[rng.choice(down, PAIRS)]
        w = np.zeros(z.shape[1])
        for _ in range(ROUNDS):  # Newton's method
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff.T @ p) / PAIRS + L2 * w
            step = np.linalg.solve((diff.T * (p * (1 - p))) @ diff / PAIRS + L2 * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.scale = 2.0 / max(float(np.std(z @ w)), 1e-9)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """One column a bin of each statistic, 1 from the bin's lower edge up."""
        return np.column_stack([(col[:, None] > edges[None, :]).astype(np.float64) for col, edges in zip(x.T, self.edges, strict=True)])

    def score(self, counts: pd.DataFrame) -> np.ndarray:
        """The ranking score in steps of 1 / STEPS of a half standard deviation of the learned rows."""
        if self.w is None:
            return np.zeros(len(counts))
        return np.round(np.clip(self.scale * (self.bins(describe(counts)) @ self.w), -30, 30) * STEPS) / STEPS


def quantile_cut(rows: list[tuple[float, int, int]]) -> float:
    """rows: (score, rows labelled 1, rows labelled 0). Of the quantiles in steps of a half per cent, the one below which the balanced accuracy is best."""
    rows = sorted(rows)
    good, bad, n = sum(r[1] for r in rows), sum(r[2] for r in rows), sum(r[1] + r[2] for r in rows)
    best, at, lost, caught, step = -1.0, 0.0, 0, 0, 1
    for s, g, b in rows:
        # The quantiles step / 200 that this score is, before its own rows count as below it.
        if lost + g + caught + b > step * n / 200:
            merit = (good - lost) / good + caught / bad
            if merit > best + 1e-12:
                best, at = merit, s
        lost, caught = lost + g, caught + b
        while step * n / 200 < lost + caught:
            step += 1
    return at


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    table = counted_table(docs)
    marks = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(~in_fold(F.col("doc_id"), 5, 0))
    n = marks.count()
    some = marks.where(unit_hash(SEED, F.col("doc_id")) < min(1.0, TRAIN_ROWS / max(n, 1)))
    rows = table.join(some, "doc_id").toPandas().sort_values(["doc_id", *COUNTS])
    model = BradleyTerry(rows[COUNTS].reset_index(drop=True), (rows["quality"] == 1).to_numpy())

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(model.score(pd.DataFrame(dict(zip(COUNTS, cols, strict=True)))))

    scored = cut(table.select("doc_id", score(*[F.col(c) for c in COUNTS]).alias("s")))
    if model.w is None:
        logistic = F.lit(0.5)
    else:
        per = scored.join(marks, "doc_id").groupBy("s").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        at = quantile_cut([(r["s"], r["good"], r["bad"]) for r in per.collect()])
        logistic = 1 / (1 + F.exp(-(F.col("s") - at + float(np.log(CUT / (1 - CUT))))))
    # A score of exactly the threshold is predicted 1, whatever the logistic function's rounding.
    out = scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), F.when(F.abs(logistic - CUT) < 1e-12, CUT).otherwise(logistic).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
