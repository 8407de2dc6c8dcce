"""Models on vectors, and the places where outside models plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of the recursive splitter, from the coarsest.
SEPARATORS = ("\n\n", "\n", "Art.", "Article", ". ", " ")


def fit_logistic(rows: DataFrame, vec: str = "embedding", label: str = "label", c: float = 1.0) -> LogisticRegressionModel:
    """Multinomial logistic regression; c is the inverse of the penalty over all rows."""
    data = rows.select(array_to_vector(F.col(vec)).alias("features"), F.col(label).cast("double").alias("label"))
    n = data.count()
    return LogisticRegression(regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=100).fit(data)


def predict(model: LogisticRegressionModel, rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """rows with predicted and confidence."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(vec))))
    out = out.withColumn("predicted", F.col("prediction").cast("int")).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, k: int = 5, vec: str = "embedding", label: str = "label", c: float = 1.0) -> DataFrame:
    """rows (with fold) predicted by models that didn't learn from their fold."""
    out = None
    for i in range(k):
        part = predict(fit_logistic(rows.where(F.col("fold") != i), vec, label, c), rows.where(F.col("fold") == i), vec)
        out = part if out is None else out.unionByName(part)
    return out


def grid(rows: DataFrame, cs: Sequence[float] = (0.1, 0.5, 1, 2, 5, 10), k: int = 5, vec: str = "embedding", label: str = "label") -> DataFrame:
    """c, accuracy by cross-validation over the rows' folds."""
    parts = [out_of_fold(rows, k, vec, label, c).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy")).select(F.lit(float(c)).alias("c"), "accuracy") for c in cs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_column(load: Callable[[], Callable[[Sequence[str]], Sequence]], text: Column, returns: str) -> Column:
    """An outside model over batches of a column; load runs once in each worker, failures give nulls."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            try:
                yield pd.Series(model(list(s)))
            except Exception:  # a model's own failure must not stop the evaluation; the row keeps a null
                yield pd.Series([None] * len(s))

    return run(text)


def with_retries(call: Callable[[str], object], tries: int = 3, wait: float = 1.0) -> Callable[[str], object]:
    """call, tried again after a growing wait; the last failure is raised."""
    import time

    def tried(text: str) -> object:
        for left in range(tries - 1, -1, -1):
            try:
                return call(text)
            except Exception:
                if not left:
                    raise
                time.sleep(wait * (tries - left))
        return None

    return tried


def isolated(load: Callable[[], Callable[[str], object]], text: Column, returns: str) -> Column:
    """A struct of value and error: an outside model row by row; a row's failure gives its text and stops no other."""

    @F.pandas_udf(f"value {returns}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(text: str) -> tuple:
            try:
                return model(text), None
            except Exception as e:  # isolated: it becomes the row's result
                return None, f"{type(e).__name__}: {e}"

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["value", "error"])

    return run(text)


def status(result: Column) -> Column:
    """OK, MISS (no value) or ERROR of a struct of isolated()."""
    return F.when(result["error"].isNotNull(), "ERROR").when(result["value"].isNull(), "MISS").otherwise("OK")


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Chunks of up to `size` characters: cut at the coarsest separator there is, finer ones where a part is too long."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        parts = list(text)
    else:
        sep = separators[at]
        first, *rest = text.split(sep)
        parts = [p for p in [first, *[sep + r for r in rest]] if p]
    finer = separators[at + 1 :] if at is not None else ()
    out: list[str] = []
    fitting: list[str] = []

    def emit() -> None:
        now: list[str] = []
        total = 0
        for p in fitting:
            if total + len(p) > size and now:
                out.append("".join(now).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(now.pop(0))
            now.append(p)
            total += len(p)
        if now:
            out.append("".join(now).strip())
        fitting.clear()

    for p in parts:
        if len(p) <= size:
            fitting.append(p)
        else:
            emit()
            out.extend(split_recursively(p, size, overlap, finer))
    emit()
    return [c for c in out if c]


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 150, separators: Sequence[str] = SEPARATORS) -> Column:
    """Array of a text's chunks. Greedy merging with overlap has no expression form, so this is a pandas UDF."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([split_recursively(t or "", size, overlap, tuple(separators)) for t in s])

    return split(text)


__all__ = ["fit_logistic", "grid", "isolated", "model_column", "out_of_fold", "predict", "recursive_chunks", "split_recursively", "status", "with_retries"]
