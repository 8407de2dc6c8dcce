"""Quality rules: base rules, and an isolation forest on rule statistics.

Every tree splits a subsample of SUBSAMPLE documents' statistics at random values of random
statistics; a document's mean path length over TREES trees says how hard it is to isolate. Short
paths are anomalies. The path length below which a document goes is calibrated on all labelled
rows (quality 1 or 0): of the thresholds that keep at least KEEP_GOOD of those labelled 1, the one
with the best balanced accuracy; without both labels, that of the forest's PRIOR share.

The forest is fitted on about TREES * SUBSAMPLE rows chosen by a hash of doc_id, whatever the
corpus; statistics, calibration and verdicts cover every row.

Defined results: null or empty text: all counts 0, base_failed (under 50 words), not kept. Repeated
rows: equal results. A null doc_id joins no label. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, unit_hash

TREES, SUBSAMPLE, SEED = 100, 256, 1
KEEP_GOOD, PRIOR, BINS = 0.98, 0.05, 2000
#: White space, and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct", "n_bytes", "n_same"]
DROP = {name: bytes(range(ord(a), ord(b) + 1)) for name, a, b in (("upper", "A", "Z"), ("digits", "0", "9"))}


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, each position once."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k == n:
        return 0
    pair = a[:-1] * k + a[1:]
    if k > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * k + a[2:]
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = sorted_[1:] == sorted_[:-1]
    again = np.zeros(len(code), bool)
    again[order] = same[1:] | same[:-1]
    at = np.zeros(n, bool)
    for i in range(3):
        at[i : n - 2 + i] |= again
    return int(at.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    gone = {name: len(raw) - len(raw.translate(None, chars)) for name, chars in DROP.items()}
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), gone["upper"], gone["digits"],
        text.count("!") + text.count("?"), len(lines), len(set(words)), len(raw), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def counted(text: Column) -> Column:
    """A struct of COUNTS."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([counts(t) for t in s], columns=COUNTS, dtype="int64")

    return of(text)


def shares(c: pd.DataFrame) -> np.ndarray:
    """Statistics that don't depend on the length of the text, a row a document."""
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([c["n_symbols"] / chars, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / n, c["n_repeat_words"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_same"] / n, c["word_chars"] / n]).astype(np.float64)


#: The forest sees five shares in whole grades of this size, so that it isolates rule breaks and not the noise of short texts.
GRADES = {0: 0.02, 1: 0.1, 2: 0.1, 3: 0.05, 6: 0.05}


def graded(c: pd.DataFrame) -> np.ndarray:
    """Grades of the shares of symbols, capitals, digits, exclamations and words that repeat the word before."""
    return np.floor(shares(c)[:, list(GRADES)] / np.array(list(GRADES.values())))


def counted_table(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS, written once."""
    small_batches(docs)
    return cut(docs.select("doc_id", counted(F.col("text")).alias("c")).select("doc_id", "c.*"))


class Forest:
    """Arrays of the trees' nodes: split column, value, and the path length at a leaf (node i has the children 2i+1, 2i+2)."""

    def __init__(self, x: np.ndarray, seed: int = SEED, trees: int = TREES, subsample: int = SUBSAMPLE):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(subsample))))
        nodes = (1 << (self.depth + 1)) - 1
        self.column = np.full((trees, nodes), -1, np.int16)
        self.value, self.length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            rows = x[rng.permutation(len(x))[:subsample]]
            todo = [(0, np.arange(len(rows)), 0)]
            while todo:
                node, own, depth = todo.pop()
                wide = np.flatnonzero(np.ptp(rows[own], axis=0) > 0) if len(own) > 1 else []
                if depth == self.depth or len(wide) == 0:
                    self.length[t, node] = depth + average_path(len(own))
                    continue
                f = int(rng.choice(wide))
                lo, hi = rows[own, f].min(), rows[own, f].max()
                self.column[t, node], self.value[t, node] = f, rng.uniform(lo, hi)
                left = rows[own, f] <= self.value[t, node]
                todo += [(2 * node + 1, own[left], depth + 1), (2 * node + 2, own[~left], depth + 1)]

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of x."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.column)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.column[t, node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.value[t, node], 2 * node + 1, 2 * node + 2)
                node = np.where(f >= 0, down, node)
            out += self.length[t, node]
        return out / len(self.column)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def threshold(bins: list[tuple[int, int, int]]) -> int:
    """bins: (bin of the path length, rows labelled 1, rows labelled 0). The first bin that is kept."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best, at, lost, caught = 0.5, 0, 0, 0
    for b, g, w in sorted(bins):
        lost, caught = lost + g, caught + w
        if lost <= (1 - KEEP_GOOD) * good and (merit := (caught / bad + 1 - lost / good) / 2) > best:
            best, at = merit, b + 1
    return at


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, path_length, kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = counted_table(docs).withColumn("base_failed", base)
    able = table.where(~F.col("base_failed"))
    n = able.count()
    sample = able.where(unit_hash(SEED, F.col("doc_id")) < min(1.0, TREES * SUBSAMPLE / max(n, 1))).select(*COUNTS).toPandas()
    x = graded(sample)
    forest = Forest(x[np.lexsort(x.T)]) if len(x) else None
    step = (forest.depth + average_path(SUBSAMPLE)) / BINS if forest else 1.0

    @F.pandas_udf("int")
    def path_bin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            c = pd.DataFrame(dict(zip(COUNTS, cols, strict=True)))
            yield pd.Series(np.floor(forest.path(graded(c)) / step) if forest else np.zeros(len(c))).astype("int32")

    scored = cut(table.withColumn("bin", path_bin(*[F.col(c) for c in COUNTS])))
    marks = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null")
    bins = scored.where(~F.col("base_failed")).select("doc_id", "bin").join(marks, "doc_id").groupBy("bin").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    bins = [(r["bin"], r["good"], r["bad"]) for r in bins]
    if sum(b[1] for b in bins) and sum(b[2] for b in bins):
        first = threshold(bins)
    else:
        first = int(np.floor(np.quantile(forest.path(x), PRIOR) / step)) if forest else 0
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("bin") * step).alias("path_length"), (~F.col("base_failed") & (F.col("bin") >= first)).alias("kept"))
