"""Packing documents into as few sequences as possible by minimum bin slack.

Lengths are whole numbers up to the sequence's, so bins are made from a histogram: the longest piece that is left
opens a bin, and a bitset subset-sum over the lengths that are left finds the combination that fills it most. The
same combination would be chosen again as long as its lengths last, so it is taken as often as they do. Of some length
fewer pieces are left than the pattern holds, so that it holds fewer of them the next time it stops a pattern: there
are at most sum(size // length) patterns, about size * ln(size), however many documents there are. Pieces then find
their places by their ranks among those of equal length, which are sums over partitions; only the histogram and the
patterns meet on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.packing import Encoder
from lumenframe.llm.shared import bounded, discard, tidy, written

SIZE = 2048


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how often each, whose sum comes nearest to room from below; counts tell how many there are.

    Bit s of a bitset tells whether some pieces have s tokens together. Longer pieces are preferred among sums that
    are equal, so that short ones stay for later bins.
    """
    steps, reach, past = [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & past
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths with how often each, number of such bins), that use up all pieces counted by length."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        bin_ = fullest({k: v for k, v in rest.items() if v}, size - longest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        out.append((bin_, times))
        left = {k: v for k, v in ((k, v - times * bin_.get(k, 0)) for k, v in left.items()) if v}
    return out


def places(found: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Where the pieces of a length go: a row for each pattern and length, by length and first rank.

    (length, rank: first of the ranks that go here, times: bins of the pattern, sequence: its first bin, offset)
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in found:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * bin_[length]
            offset += length * bin_[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "times", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"])


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of the size, what is over comes first."""
    first = n % size or size
    return [(0, min(n, first))] + [(s, size) for s in range(first, n, size)]


def pieces(df: DataFrame, encoder_args: tuple, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of that length in the partition."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen, part = Encoder(*encoder_args), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for begun in range(0, len(batch), 500):
                some, out = batch.iloc[begun : begun + 500], []
                for row, text in enumerate(some["text"]):
                    ids = encoder(text if isinstance(text, str) else None).astype("<u4", copy=False)
                    for k, (start, n) in enumerate(cuts(len(ids), size)):
                        out.append((row, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), int(seen[n])))
                        seen[n] += 1
                row, piece, start, length, crc, nth = map(np.array, zip(*out))
                yield pd.DataFrame({"id": some["id"].to_numpy()[row], "piece": piece, "start": start, "length": length, "ids_crc32": crc, "part": part, "nth": nth})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(df: DataFrame, encoder_args: tuple, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """A row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Documents of up to `size` tokens, the end token included, stay whole; longer ones are cut into pieces of that
    size, the first of which may be shorter. A null or empty text is the end token only; equal rows are documents of
    their own; a null id stays null. Sequences are numbered from 0, without gaps. An empty table gives no pieces.
    """
    spark = df.sparkSession
    bounded(spark)
    each = written(pieces(df, encoder_args, id_col=id_col, text_col=text_col, size=size), "slack-pieces")
    by_part = written(each.groupBy("length", "part").agg(F.count("*").alias("n")), "slack-parts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    table = places(patterns(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(by_part.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "slack-bases")
    ranked = each.join(bases, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    # at most size * ln(size) patterns times the distinct lengths of one, whose sum is the size: bounded whatever the input
    length, first, times, sequence, offset = (table[c].to_numpy() for c in table.columns)
    starts = np.searchsorted(length, np.arange(size + 2))

    @tidy
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = length * (1 << 48) + first
        for batch in batches:
            of, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            at = np.searchsorted(keys, of * (1 << 48) + rank, side="right") - 1
            if len(at) and (at < starts[of]).any():
                raise ValueError("a piece without a place")
            nth = rank - first[at]
            yield batch.assign(sequence_id=sequence[at] + nth % times[at], offset=offset[at] + nth // times[at] * of)

    kind = dict(ranked.dtypes)["id"]
    discard(by_part)
    return ranked.mapInPandas(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
