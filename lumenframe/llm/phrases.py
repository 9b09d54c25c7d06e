"""Frequent phrases and how firmly their words hold together, by Apriori passes over the levels of length.

Every language's words are counted; frequent ones get numbers, and texts become runs of them. A phrase of k words is
two overlapping ones of k - 1: each pass is sent the frequent phrases of the level below, as sorted numbers, marks
where they begin, and counts k-grams only where both of their parts are frequent. A phrase's number pair names it
exactly. Numbers are sent in blocks of bounded size, one after the other where a level has more. Levels are tables,
from which the counts of all cuts of a phrase are joined.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import bounded, discard, tidy, written

MIN_COUNT = 30
LONGEST = 4
#: A phrase goes if a longer one holds it and has so many hundredths of its occurrences.
COVERED = 80
TOP = 2000
#: Words, and numbers of phrases, that are sent to workers at a time: 16 and 32 MB or so.
WORDS = 400_000
KEYS = 4_000_000
#: Entries that a counting task holds before it sends them on.
HELD = 300_000
POSITIONS = 4_000_000
#: Shares of a language, at least, in which its best phrases are found first.
PARTS = 32

#: Pieces end at these.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(ENDS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(ENDS) + b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    """The words in lower case (A to Z); a full stop stands for the end of a piece."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): parts of the words' counts."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(Counter)

        def send():
            for lang, n in found.items():
                n.pop(b".", None)
                items = list(n.items())
                for at in range(0, len(items), 50_000):
                    some = items[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([w for w, _ in some], pa.binary()).cast(pa.string()), pa.array([k for _, k in some])], ["lang", "word", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[lang].update(words_of(text))
                if sum(map(len, found.values())) > HELD:
                    yield from send()
        yield from send()

    return texts.mapInArrow(count, "lang string, word string, n long")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df as a table with the column id, from 1 on in that order, without gaps."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id()), f"{name}-rows")
    part = F.expr("shiftright(spot, 33)")  # the partition; below it the place there
    counts = rows.groupBy(part.alias("of_part")).agg(F.count("*").alias("n_part"))
    first = F.coalesce(F.sum("n_part").over(Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    bases = written(counts.select("of_part", first.alias("first")), f"{name}-parts")
    out = written(rows.join(bases, part == F.col("of_part")).withColumn("id", F.expr(f"first + spot - shiftleft(of_part, 33) + 1")).drop("spot", "of_part", "first"), name)
    discard(rows, bases)
    return out


def _blocks(table: DataFrame, size: int) -> Iterator[tuple[int, DataFrame]]:
    """(first id, rows) of the blocks of a numbered table."""
    most = table.agg(F.max("id")).collect()[0][0] or 0
    for first in range(1, max(most, 1) + 1, size):
        yield first, table.where((F.col("id") >= first) & (F.col("id") < first + size))


def encoded(texts: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """A table (ids): each text's words by number, 0 where a word is not frequent and where pieces end."""
    spark, frame = texts.sparkSession, texts.withColumn("ids", F.lit(None).cast("binary"))
    blocks = list(_blocks(words, block))
    for nth, (_, some) in enumerate(blocks):
        of = defaultdict(dict)
        for lang, word, n in zip(*(c.to_pylist() for c in some.select("lang", F.col("word").cast("binary"), "id").toArrow().columns)):  # at most `block` rows
            of[lang][word] = n
        sent, last = spark.sparkContext.broadcast(dict(of)), nth == len(blocks) - 1

        @tidy
        def encode(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for lang, text, before in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    found = words_of(text)
                    ids = np.fromiter(map(sent.value.get(lang, {}).get, found, repeat(0)), np.int32, len(found))
                    if before is not None:
                        ids |= np.frombuffer(before, np.int32)
                    out.append(ids.tobytes())
                ids = pa.array(out, pa.binary())
                yield pa.RecordBatch.from_arrays([ids] if last else [batch.column(0), batch.column(1), ids], ["ids"] if last else ["lang", "text", "ids"])

        more = written(frame.mapInArrow(encode, "ids binary" if last else "lang string, text binary, ids binary"), "phrase-ids")
        discard(frame)
        sent.unpersist()
        frame = more
    return frame


def _joined(column: pa.Array) -> np.ndarray:
    """The runs of a batch as one, with a 0 after each."""
    return np.concatenate([np.zeros(1, np.int32)] + [y for x in column for y in (np.frombuffer(x.as_buffer(), np.int32), np.zeros(1, np.int32))])


def _keys(ids: np.ndarray) -> np.ndarray:
    """Of each place the pair of numbers there and at the next one, or 0 where one of them is missing."""
    both = (ids[:-1] > 0) & (ids[1:] > 0)
    return np.where(both, ids[:-1].astype(np.int64) << 32 | ids[1:], 0)


def pair_counts(state: DataFrame) -> DataFrame:
    """(key, n): parts of the counts of neighbours that are both frequent."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, raw, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            more, k = np.unique(np.concatenate(raw), return_counts=True) if raw else (np.empty(0, np.int64), np.empty(0, np.int64))
            every, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            out = np.zeros(len(every), np.int64)
            np.add.at(out, at, np.concatenate([n, k]))
            raw.clear()
            return every, out

        def send():
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["key", "n"])

        for batch in batches:
            found = _keys(_joined(batch.column(0)))
            raw.append(found[found > 0])
            held += len(raw[-1])
            if held > POSITIONS:
                (keys, n), held = merged(), 0
                if len(keys) > POSITIONS:
                    yield from send()
                    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        keys, n = merged()
        yield from send()

    return state.mapInArrow(count, "key long, n long")


def marked(state: DataFrame, level: DataFrame, block: int) -> DataFrame:
    """A table (ids): the number of the level's phrase that begins at each place, 0 where none does."""
    spark, frame = state.sparkSession, state.select("ids", F.lit(None).cast("binary").alias("found"))
    blocks = list(_blocks(level, block))
    for nth, (first, some) in enumerate(blocks):
        keys = np.sort(some.select("key").toArrow().column(0).to_numpy())  # at most `block`, numbered in their order
        sent, last = spark.sparkContext.broadcast(keys), nth == len(blocks) - 1

        @tidy
        def mark(batches: Iterator[pa.RecordBatch], sent=sent, last=last, first=first) -> Iterator[pa.RecordBatch]:
            keys = sent.value
            for batch in batches:
                here = _keys(_joined(batch.column(0)))
                at = np.minimum(np.searchsorted(keys, here), max(len(keys) - 1, 0))
                hit = (keys[at] == here) & (here > 0) if len(keys) else np.zeros(len(here), bool)
                ids = np.where(hit, at + first, 0).astype(np.int32)
                ends = np.cumsum([len(x.as_buffer()) // 4 + 1 for x in batch.column(0)]) if len(batch) else []
                out, before = [], 1
                for end, had in zip(ends, batch.column(1)):
                    own = ids[before:end + 1]
                    out.append((own | np.frombuffer(had.as_buffer(), np.int32) if had.is_valid else own).tobytes())
                    before = end + 1
                found = pa.array(out, pa.binary())
                yield pa.RecordBatch.from_arrays([found] if last else [batch.column(0), found], ["ids"] if last else ["ids", "found"])

        more = written(frame.mapInArrow(mark, "ids binary" if last else "ids binary, found binary"), "phrase-marks")
        discard(frame)
        sent.unpersist()
        frame = more
    return frame


def longer(level: DataFrame, before: DataFrame) -> DataFrame:
    """(id, lang, phrase, last, n, heads, tails) of a level (id, key, n), from that of the one below.

    heads and tails hold the counts of the phrase's first and last 1, 2, ... words, its own included.
    """
    left = before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("left"), F.col("heads").alias("left_heads"))
    right = before.select(F.col("id").alias("b"), "last", F.col("tails").alias("right_tails"))
    rows = level.select("id", "n", F.shiftrightunsigned("key", 32).alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b"))
    own = F.array("n")
    return rows.join(left, "a").join(right, "b").select("id", "lang", F.concat_ws(" ", "left", "last").alias("phrase"), "last", "n", F.concat("left_heads", own).alias("heads"), F.concat("right_tails", own).alias("tails"), "a", "b")


def cut(k: int):
    """The lowest-scoring cut of a phrase of k words, (score, after, l, r); of equal ones the first."""
    each = [
        F.struct(F.expr(f"(cast(n as decimal(20, 0)) * 2000000) div (cast(heads[{j - 1}] as decimal(20, 0)) + tails[{k - j - 1}])").alias("score"), F.lit(j).alias("after"), F.expr(f"heads[{j - 1}]").alias("l"), F.expr(f"tails[{k - j - 1}]").alias("r"))
        for j in range(1, k)
    ]
    return F.array_min(F.array(*each))


def collocations(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, covered: int = COVERED, longest: int = LONGEST, top: int = TOP, word_block: int = WORDS, key_block: int = KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's firmest phrases of 2 to `longest` words.

    A null text is an empty one, a null language is `und`; equal rows count each. Phrases that occur less than
    min_count times are none. A language without any gives no rows, and so does an empty table. A level may hold
    2 ** 31 phrases; more are an error.
    """
    spark = df.sparkSession
    bounded(spark)
    texts = _texts(df, text_col, lang_col)
    counts = written(word_counts(texts).groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("words")), "phrase-totals")
    words = numbered(counts.where(F.col("n") >= min_count), "phrase-words", "lang", "word")
    state = encoded(texts, words, word_block)
    discard(counts)
    below = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = []
    for k in range(2, longest + 1):
        found = pair_counts(state).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        level = numbered(found, f"phrase-level-{k}", "key")
        if level.count() >= 1 << 31:
            raise ValueError("a level of more than 2 ** 31 phrases")
        if k < longest:
            more = marked(state, level, key_block)
            discard(state)
            state = more
        levels.append(written(longer(level, below), f"phrase-{k}"))
        discard(level)
        below = levels[-1].drop("a", "b")
    discard(state)
    kept = []
    for k, level in enumerate(levels, 2):
        each = level.select("lang", "id", "phrase", F.col("n").alias("a"), cut(k).alias("cut"))
        if k < longest:  # a phrase of two more words that holds this one holds one of one more that does, and is rarer
            over = levels[k - 1]
            over = over.select(F.col("a").alias("id"), F.col("n").alias("most")).unionByName(over.select(F.col("b").alias("id"), F.col("n").alias("most"))).groupBy("id").agg(F.max("most").alias("most"))
            each = each.join(over, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
        kept.append(each.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    every = written(every, "phrase-scored")
    discard(*levels)
    # first the best of each part of a language, so that no task sorts all of one
    parts = max(PARTS, every.count() // 100_000)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
