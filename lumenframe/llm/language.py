"""Language identification by words first: known words score by their relative frequency in each language,
unseen words by progressively shorter character n-grams.

Every word costs each language -log10 of its relative frequency there, or a penalty where the language lacks
it. A word that no language knows is padded with spaces and split into n-grams of the greatest length at
which any language knows one; its cost is the mean over those n-grams. The language with the lowest mean
cost over all words of the whole text wins, ties go to the first in alphabetical order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import bounded, discard, tidy, unit_hash, written

#: Labelled documents of each language that a fit uses, about (chosen by a hash of their id), and characters of all of
#: them together: with many languages each has its equal part of those.
MAX_FIT = 1_000
MAX_CHARS = 8_000_000
LENGTHS = (5, 4, 3, 2, 1)
PENALTY = 7.0
UNKNOWN = "und"
#: Costs that a worker keeps for the words it has met, and up to which it lays out all entries' costs.
_CELLS = 1_600_000
_LAID_OUT = 16_000_000


_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Runs of letters (characters of a Unicode letter category) of the lower-cased text, with their counts."""
    out = Counter(_RUNS.findall(text.lower()))
    for run in [w for w in out if not w.isalpha()]:  # the pattern lets numbers pass that are no digits
        n = out.pop(run)
        for w in "".join(c if c.isalpha() else " " for c in run).split():
            out[w] += n
    return out


@dataclass
class Model:
    """Costs of known entries by language; entries that a language lacks cost PENALTY there."""

    languages: list[str]
    #: length (0: whole words) -> entry -> row
    entries: dict[int, dict[str, int]]
    #: the languages and costs of row i are at[i] to at[i + 1]
    at: np.ndarray
    of: np.ndarray
    costs: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._most = max(1_000, _CELLS // max(1, len(self.languages)))
        self._rows = np.zeros((min(1024, self._most), max(1, len(self.languages))), np.float32)
        n = len(self.at) - 1
        self._all = None
        if n * len(self.languages) <= _LAID_OUT:
            self._all = np.full((n, len(self.languages)), PENALTY, np.float32)
            self._all[np.repeat(np.arange(n), np.diff(self.at)), self.of] = self.costs

    def cost(self, row: int) -> np.ndarray:
        if self._all is not None:
            return self._all[row]
        out = np.full(len(self.languages), PENALTY, np.float32)
        span = slice(self.at[row], self.at[row + 1])
        out[self.of[span]] = self.costs[span]
        return out

    def word_cost(self, word: str) -> np.ndarray:
        known = self.entries.get(0, {}).get(word)
        if known is not None:
            return self.cost(known)
        padded = f" {word} "
        for n in LENGTHS:
            get = self.entries.get(n, {}).get
            found = [r for i in range(len(padded) - n + 1) if (r := get(padded[i : i + n])) is not None]
            if found:
                every = self._all[found].sum(0) if self._all is not None else sum(self.cost(r) for r in found)
                return every / np.float32(len(found))
        return np.full(len(self.languages), PENALTY, np.float32)

    def _row(self, word: str) -> int:
        at = len(self.cache)
        if at >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[at] = self.word_cost(word)
        self.cache[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least mean cost, and its probability if the words count as independent."""
        words = words_of(text) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total, n, items = np.zeros(len(self.languages)), sum(words.values()), list(words.items())
        for i in range(0, len(items), self._most // 2):
            part = items[i : i + self._most // 2]
            if len(self.cache) + len(part) > self._most:
                self.cache.clear()
            get = self.cache.get
            rows = [r if (r := get(w)) is not None else self._row(w) for w, _ in part]
            total += np.array([c for _, c in part], np.float64) @ self._rows[rows]
        mean = total / n
        best = int(np.argmin(np.round(mean, 9)))
        odds = np.exp(-np.maximum(0.0, mean - mean[best]) * n * np.log(10))
        return self.languages[best], float(odds[best] / odds.sum())


def count_entries(texts: list[str | None]) -> Counter:
    """Words and padded n-grams (their length in front) with their counts."""
    words: Counter = Counter()
    for text in texts:
        if text:
            words.update(words_of(text))
    out = Counter(words)
    for word, c in words.items():
        padded = f" {word} "
        for n in LENGTHS:
            for i in range(len(padded) - n + 1):
                out[f"{n}{padded[i : i + n]}"] += c
    return out


def build(counts: dict[str, dict[str, int]]) -> Model:
    """counts: language -> entry -> count; an entry costs -log10 of its share of the language's entries of that length."""
    languages = sorted(counts)
    kind = lambda e: int(e[0]) if e[0] in "12345" else 0
    entries: dict[int, dict[str, int]] = {n: {} for n in (0, *LENGTHS)}
    rows, of, costs = [], [], []
    n_rows = 0
    for i, lang in enumerate(languages):
        total: Counter = Counter()
        for e, c in counts[lang].items():
            total[kind(e)] += c
        for e, c in counts[lang].items():
            own = entries[kind(e)]
            name = e[1:] if kind(e) else e
            if (row := own.get(name)) is None:
                row = own[name] = n_rows
                n_rows += 1
            rows.append(row)
            of.append(i)
            costs.append(min(PENALTY, -np.log10(c / total[kind(e)])))
    order = np.argsort(np.array(rows, np.int64), kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(np.array(rows, np.int64), minlength=n_rows))]).astype(np.int64)
    return Model(languages, entries, at, np.array(of, np.int32)[order], np.array(costs, np.float32)[order])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_FIT, max_chars: int = MAX_CHARS) -> Model:
    """Fit on the rows with a language: about max_rows of each, chosen by a hash of the id, whole texts.

    Of a language's chosen rows, in the order of that hash, the first is learned from and as many more as stay
    within max_chars divided by the number of languages. All entries of those rows are the model's, any number of
    languages can be told apart. Without labelled rows the model knows no language and predicts `und`.
    """
    bounded(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = written(labelled.groupBy(F.col(lang_col).alias("of_lang")).agg(F.count("*").alias("of_n")), "language-sizes")
    n_languages = sizes.count()
    if not n_languages:
        return Model([], {}, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), unit_hash(id_col).alias("h"))
    rows = rows.join(sizes, F.col("lang") == F.col("of_lang")).where(F.col("h") * F.col("of_n") < max_rows).drop("of_lang", "of_n")
    rows = written(rows.withColumn("size", F.length("text").cast("long")), "language-sample")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = rows.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= max_chars // n_languages))

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                found = count_entries(list(part["text"]))
                yield pd.DataFrame({"lang": lang, "entry": list(found), "n": list(found.values())})

    summed = within.select("lang", "text").mapInPandas(count, "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    summed = written(summed, "language-entries").toPandas()  # at most a few entries for each of max_chars characters
    discard(sizes, rows)
    counts: dict[str, dict[str, int]] = {}
    for lang, entry, c in zip(summed["lang"], summed["entry"], summed["n"]):
        counts.setdefault(lang, {})[entry] = int(c)
    return build(counts)


def predict(df: DataFrame, model: Model, text: str | Column = "text") -> Column:
    """Struct column (lang_pred string, score double): the best language and its probability.

    `und` with score 0 for null texts and texts without a letter (a character of a Unicode letter category).
    """
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.entries, model.at, model.of, model.costs))

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predicted(F.col(text) if isinstance(text, str) else text)
