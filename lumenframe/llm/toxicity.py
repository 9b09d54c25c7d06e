"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A document is the set of hashed character 3- to 6-grams of its lower-cased text. From labelled
documents each feature gets the log of the ratio of its smoothed document frequencies in the two classes, shrunk
towards 0 by SHRINK of its standard errors, so that features that tell nothing have no scale. A logistic
regression with an L2 penalty is then fitted on the features scaled by those ratios. Scoring adds one table
entry for each distinct feature of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import bounded, tidy, unit_hash, written

BITS = 20
SIZES = (3, 4, 5, 6)
#: Labelled documents that a fit uses at most (those with the smallest hash of their id).
MAX_FIT = 5_000
#: Standard errors by which a log-count ratio is shrunk.
SHRINK = 2.5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def ngram_buckets(text: str | None) -> np.ndarray:
    """Hashed buckets of all n-grams of the text, with repeats; empty for null and for texts under 3 characters."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < SIZES[0]:
        return np.empty(0, np.int64)
    out, state = [], points
    for n in range(2, SIZES[-1] + 1):
        if len(points) < n:
            break
        state = state[:-1] * _STEP + points[n - 1 :]
        if n in SIZES:
            out.append(((state + np.uint64(n)) * _MULTIPLIER) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weight of each hashed feature (regression weight times log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        buckets = ngram_buckets(text)
        held = self.weights[buckets]
        hit = np.unique(buckets[held != 0])
        z = self.intercept + float(self.weights[hit].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """log P(feature | 1) / P(feature | 0) from document frequencies, each smoothed in proportion to its class.

    Shrunk towards 0 by SHRINK times the standard error of that difference of logs.
    """
    share = n1 / (n1 + n0)
    ratio = np.log((df1 + share) / (n1 + share)) - np.log((df0 + 1 - share) / (n0 + 1 - share))
    error = np.sqrt(np.maximum(0.0, 1 / (df1 + share) - 1 / (n1 + share) + 1 / (df0 + 1 - share) - 1 / (n0 + 1 - share)))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - SHRINK * error)


class Sparse:
    """A sparse matrix by rows; its products take a bounded number of entries at a time."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, n_cols: int, block: int = 500_000):
        self.cols, self.values, self.n, self.n_cols = cols.astype(np.int32), values.astype(np.float32), n, n_cols
        self.ends = np.cumsum(np.bincount(rows, minlength=n)) if n else np.zeros(0, np.int64)
        # rows in blocks of about that many entries
        self.blocks, first = [], 0
        while first < n:
            begin = int(self.ends[first - 1]) if first else 0
            past = max(first + 1, int(np.searchsorted(self.ends, begin + block, side="right")))
            self.blocks.append((first, past, begin, int(self.ends[past - 1])))
            first = past

    def _parts(self):
        for first, past, begin, end in self.blocks:
            counts = np.diff(self.ends[first:past], prepend=begin)
            yield slice(first, past), np.repeat(np.arange(past - first), counts), self.cols[begin:end], self.values[begin:end]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, of, cols, values in self._parts():
            out[rows] = np.bincount(of, values * w[cols], rows.stop - rows.start)
        return out

    def transposed_times(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_cols)
        for rows, of, cols, values in self._parts():
            out += np.bincount(cols, values * u[rows][of], self.n_cols)
        return out


def logistic(x: Sparse, y: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression, by accelerated gradient steps: (weights, intercept)."""
    w, b = np.zeros(x.n_cols), float(np.log((y.sum() + 0.5) / (x.n - y.sum() + 0.5)))
    bound = 0.25 * _top_eigenvalue(x) + penalty
    at_w, at_b, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(x.times(at_w) + at_b, -40, 40))) - y
        new_w, new_b = at_w - (x.transposed_times(err) + penalty * at_w) / bound, at_b - err.sum() / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w = new_w + (t - 1) / t_new * (new_w - w)
        at_b = new_b + (t - 1) / t_new * (new_b - b)
        moved = np.abs(new_w - w).max(initial=0.0)
        w, b, t = new_w, new_b, t_new
        if moved < 1e-6:
            break
    return w, b


def _top_eigenvalue(x: Sparse) -> float:
    """Of X'X with a column of ones added, by power iteration, with a margin."""
    v, one, top = np.ones(x.n_cols), 1.0, 1.0
    for _ in range(25):
        norm = np.sqrt(v @ v + one * one)
        u = x.times(v / norm) + one / norm
        v, one = x.transposed_times(u), u.sum()
        top = np.sqrt(v @ v + one * one)
    return 1.1 * float(top)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_FIT) -> Model:
    """Fit on the labelled documents: those of `labels` (id, label 0 or 1; null labels are left out).

    Several labels of one id count as their maximum, and every document with that id is learned from. Ids of any
    type are compared as text; null ids have no label. At most max_rows labelled ids are used, those with the
    smallest hash. With no labelled rows every score is 0, with one class only every score is nearly that class.
    """
    spark = docs.sparkSession
    bounded(spark)
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("string").alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_y"))
        .orderBy(unit_hash("_id"), "_id")
        .limit(max_rows)
    )
    # at most max_rows pairs of two numbers: a bounded set, sent to all
    chosen = {r["_id"]: int(r["_y"]) for r in sample.collect()}
    if not chosen:
        return Model(np.zeros(1 << BITS, np.float32), -40.0)
    pairs = spark.createDataFrame(pd.DataFrame({"_id": list(chosen), "_y": list(chosen.values())}), "_id string, _y int")
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(pairs), "_id")

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        docs_of = np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"]):
                seen[y, np.unique(ngram_buckets(text))] += 1
                docs_of[y] += 1
        if docs_of.any():
            used = np.flatnonzero(seen.any(0))
            yield pd.DataFrame({"f": np.append(used, -1), "d0": np.append(seen[0, used], docs_of[0]), "d1": np.append(seen[1, used], docs_of[1])})

    summed = rows.select("_text", "_y").mapInPandas(count, "f long, d0 long, d1 long").groupBy("f").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    summed = written(summed, "toxicity-counts")
    total = summed.where("f = -1").collect()
    n0, n1 = (int(total[0]["d0"]), int(total[0]["d1"])) if total else (0, 0)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((n1 + 0.01) / (n0 + 0.01))))
    # one row for each hashed feature that tells something, at most 2 ** BITS
    share = n1 / (n1 + n0)
    p1, p0 = F.col("d1") + F.lit(share), F.col("d0") + F.lit(1 - share)
    gap = F.abs(F.log(p1 / (n1 + share)) - F.log(p0 / (n0 + 1 - share)))
    error = F.sqrt(F.greatest(F.lit(0.0), 1 / p1 - 1 / (n1 + share) + 1 / p0 - 1 / (n0 + 1 - share)))
    counted = summed.where("f >= 0").where(gap > SHRINK * error).toPandas().sort_values("f")
    f, d0, d1 = (counted[c].to_numpy() for c in ("f", "d0", "d1"))
    ratio = log_count_ratios(d1, d0, n1, n0)
    column_of = np.full(1 << BITS, -1, np.int64)
    column_of[f] = np.arange(len(f))
    shared = spark.sparkContext.broadcast(column_of.astype(np.int32))

    @tidy
    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value[np.unique(ngram_buckets(text))] for text in batch["_text"]]
            yield pd.DataFrame({"id": batch["_id"], "y": batch["_y"], "cols": [c[c >= 0].astype(np.int32).tobytes() for c in found]})

    picked = rows.mapInPandas(pick, "id string, y int, cols binary").toPandas().sort_values("id", kind="stable")
    lists = [np.frombuffer(c, np.int32) for c in picked["cols"]]
    at = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
    cols = np.concatenate(lists) if len(lists) else np.empty(0, np.int32)
    x = Sparse(at, cols, ratio[cols], len(lists), len(f))
    del at, cols, lists
    w, b = logistic(x, picked["y"].to_numpy(float))
    weights = np.zeros(1 << BITS, np.float32)
    weights[f] = w * ratio
    return Model(weights, b)


def score(df: DataFrame, model: Model, text: str | Column = "text") -> Column:
    """Column with the probability that the text is toxic; null and empty texts get the intercept's."""
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return scored(F.col(text) if isinstance(text, str) else text)


def reject_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    return df.where(score(df, model, text_col) < threshold)
