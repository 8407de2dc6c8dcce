"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for every bit a binary logistic classifier over hashed byte
n-grams predicts it. Decoding is loss-weighted: the language whose codeword has the least sum of
logistic losses wins. The score is the softmax of the negative losses. A text is ambiguous where
the two best scores are closer than MARGIN.

Defined results: null text, or one without a letter: `und`, score 0. Texts with letters always get
a learned language, `und` only where no row is labelled. Repeated rows get equal results; a null doc_id is in no fold, so
its row may be learned from. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_fold, small_batches, unit_hash

#: About so many rows of each language, and in all, are learned from, chosen by a hash of doc_id: 16 KB a row.
TRAIN_ROWS_PER_LANG, TRAIN_ROWS = 500, 6000
DIM = 1 << 12
MARGIN = 0.1
ROUNDS, RATE, L2 = 150, 20.0, 1e-4
#: Bytes of a text that are worked on at once.
PIECE = 1 << 20
#: Letters and, to be sorted out, other number characters.
LETTER = re.compile(r"[^\W\d_]")
FIELDS = "lang_pred string, score double, ambiguous boolean"


def has_letter(text: str | None) -> bool:
    """A character of Unicode's letter categories."""
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def features(text: str | None) -> np.ndarray:
    """Unit vector of the square roots of the counts of hashed byte 1- to 3-grams of the whole lower-cased text."""
    out = np.zeros(DIM, np.int64)
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    for start in range(0, len(raw), PIECE):  # bounded memory; the two bytes before a piece belong to its n-grams
        part = raw[max(0, start - 2) : start + PIECE].astype(np.uint32)
        lead = min(start, 2)
        for n in (1, 2, 3):
            if len(part) < n:
                continue
            code = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + part[k : len(part) - n + 1 + k]
            code = code[max(0, lead - n + 1) :]
            out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(out).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-12)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all splits in two for up to 7 classes, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        code = np.array([[1] * bits] + [[1 if (j >> (n - 1 - i)) & 1 else -1 for j in range(bits)] for i in range(1, n)], np.float32)
        return code
    rng, width, best, found = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), -1, None
    for _ in range(50):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1).astype(np.float32)
        apart = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if apart > best:
            best, found = apart, code
    return found


def fit_bits(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (a row more than x has columns, for the intercept) of a logistic classifier for each column of y (+1, -1)."""
    w, v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32), 0.0
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(ROUNDS):
        ahead = w + 0.9 * v
        z = y * (x @ ahead[:-1] + ahead[-1])
        g = -y * weight / (1 + np.exp(np.clip(z, -30, 30)))
        v = 0.9 * v - RATE * 0.1 * (np.vstack([x.T @ g, 0.1 * g.sum(axis=0, keepdims=True)]) + L2 * ahead)
        w = w + v
    return w


class Ecoc:
    """langs in code point order, their codewords, and the classifiers' weights: 16 KB a codeword bit, whatever the corpus."""

    def __init__(self, langs: list[str], rows: list[tuple[str, bytes]]):
        self.langs, self.code, self.w = langs, codewords(len(langs)), None
        if len(langs) > 1:
            x = np.stack([np.frombuffer(b, np.float32) for _, b in rows])
            of = np.array([langs.index(a) for a, _ in rows])
            self.w = fit_bits(x, self.code[of], 1.0 / np.bincount(of, minlength=len(langs))[of])

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text) or not self.langs:
            return "und", 0.0, True
        if self.w is None:
            return self.langs[0], 1.0, False
        z = features(text) @ self.w[:-1] + self.w[-1]
        loss = np.logaddexp(0, -self.code * z).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        second = float(np.partition(p, -2)[-2])
        return self.langs[best], float(p[best]), bool(p[best] - second < MARGIN)


def learn(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS_PER_LANG, seed: int = 10) -> Ecoc:
    """Learns from text and non-null lang of rows whose crc32(doc_id) mod 3 is not 1, about rows_per_lang of each and TRAIN_ROWS in all."""
    small_batches(docs)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Ecoc([], [])
    rows_per_lang = min(rows_per_lang, max(1, TRAIN_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_lang / n))])
    as_features = F.pandas_udf(lambda s: pd.Series([features(t).tobytes() for t in s]), "binary")
    sample = rows.where(unit_hash(seed, F.col("doc_id")) < share[F.col("lang")]).select("lang", as_features(F.col("text")).alias("x")).toArrow()
    sample = sorted(zip(sample["lang"].to_pylist(), sample["x"].to_pylist(), strict=True))
    return Ecoc(sorted({a for a, _ in sample}), sample)


def decoder(model: Ecoc, text: Column) -> Column:
    """A struct of FIELDS for each text."""

    @F.pandas_udf(FIELDS)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([model.decode(t) for t in s], columns=["lang_pred", "score", "ambiguous"])

    return decode.asNondeterministic()(text)  # so that a filter on it doesn't run it twice


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    out = docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), decoder(learn(docs), F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that are `und` or ambiguous."""
    mark = fresh(docs, "__language_id")
    return docs.withColumn(mark, decoder(learn(docs), F.col("text"))).where(~F.col(mark)["ambiguous"]).drop(mark)
