"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments and indexed by the value of each. A query searches all segment values at distance 0 of its
own, then at distance 1, and so on. By the pigeonhole principle all codes within m * a + j bits have been met once
distance a is done in segments 0 to j of m, so a query stops as soon as its k-th verified distance is within that. A
code is verified where it is met first, which its own segment distances tell. Equal codes are one entry with their
k smallest ids, so copies cost nothing.

Entries are dealt by hash to blocks of bounded size and queries to batches; a task holds the index of one block and
searches it for one batch. Where there are several blocks, each query's k-th distance in one of them bounds its
search in all. What a search meets stays inside its task: only the k best of each query come out. The width of
segments follows the logarithm of a block's size, so that a value has about one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import bounded, discard, tidy, written

WORD = 64
K = 10
#: Bits of a segment at most: an index has a place for each value.
WIDEST = 20
#: Codes of a block and queries of a batch at most.
BLOCK = 1 << 20
BATCH = 1 << 18
#: Queries that search together, and values and codes that they may hold at a time.
TOGETHER = 256
HELD = 2_000_000


def sign_code(embedding: str | Column, bits: int = WORD) -> Column:
    """Array of longs with a bit for each element: whether it is over 0 (null and NaN elements: no).

    Null for a null or empty array. bits, rounded up to words, is the length of all codes: missing elements give
    0 bits, more elements than bits are an error.
    """
    x = F.col(embedding) if isinstance(embedding, str) else embedding
    words = -(-bits // WORD)
    bit = lambda v, i: F.when((v > 0) & ~F.isnan(v), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda i: F.aggregate(F.transform(F.slice(x, i * WORD + 1, WORD), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    long = F.raise_error(F.concat(F.lit(f"sign_code: more than {words * WORD} elements: "), F.size(x).cast("string")))
    code = F.array(*[word(i) for i in range(words)])
    return F.when(F.size(x) > words * WORD, F.array(long.cast("long"))).when(F.size(x) > 0, code)


def longest(df: DataFrame, embedding: str) -> int:
    """The most elements of any of the arrays, at least 1."""
    return max(1, df.agg(F.max(F.size(embedding))).collect()[0][0] or 1)


@cache
def masks(width: int, distance: int) -> np.ndarray:
    """All values of a segment's width with so many bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), distance)], np.int64)


class Index:
    """A block's codes (n, words) by segments of the bits in which they differ."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        self.same = np.bitwise_and.reduce(codes, 0)
        differ = np.bitwise_or.reduce(codes, 0) ^ self.same
        bits = [(w, b) for w in range(codes.shape[1]) for b in range(WORD) if int(differ[w]) >> b & 1] or [(0, 0)]
        width = min(WIDEST, max(4, int(np.log2(max(n, 2)))))
        self.parts = [p.tolist() for p in np.array_split(np.array(bits), -(-len(bits) // width))]
        self.masks = np.zeros((len(self.parts), codes.shape[1]), np.uint64)
        for i, part in enumerate(self.parts):
            for w, b in part:
                self.masks[i, w] |= np.uint64(1 << b)
        self.fixed = ~np.bitwise_or.reduce(self.masks, 0)
        self.tables = []
        for part in self.parts:
            own = self.values(codes, part)
            starts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=1 << len(part)))])
            self.tables.append((np.argsort(own, kind="stable"), starts))

    @staticmethod
    def values(codes: np.ndarray, part: list) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        for i, (w, b) in enumerate(part):
            out |= ((codes[:, w] >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
        return out

    def met(self, queries: np.ndarray, own: np.ndarray, at: np.ndarray, segment: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the query, of the code, distance) of the codes that these queries meet here first.

        own: the queries' values of the segment; at: places of those that search.
        """
        flips = masks(len(self.parts[segment]), distance)
        order, starts = self.tables[segment]
        for first in range(0, len(at), step := max(1, HELD // max(1, len(flips)))):
            some = at[first : first + step]
            value = own[some, None] ^ flips
            begin, many = starts[value].ravel(), (starts[value + 1] - starts[value]).ravel()
            total, done = np.cumsum(many), 0
            while done < len(many):  # values in runs that meet a bounded number of codes, or one value
                end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HELD, side="right")))
                k = many[done:end]
                q = np.repeat(some[np.arange(done, end) // len(flips)], k)
                c = order[np.repeat(begin[done:end] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                apart = queries[q] ^ self.codes[c]
                each = [np.bitwise_count(apart & m).sum(1, dtype=np.int64) for m in self.masks]
                # met before: nearer in any segment, or as near in an earlier one
                new = np.ones(len(q), bool)
                for i, d in enumerate(each):
                    new &= d > distance if i < segment else d >= distance
                yield q[new], c[new], sum(each)[new] + np.bitwise_count(apart[new] & self.fixed).sum(1, dtype=np.int64)
                done = end

    def nearest(self, queries: np.ndarray, bound: np.ndarray, low: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, of the code, distance): the k best codes of each query within its bound, by distance and low.

        size: ids of each code; a query stops when codes with k ids are provably its nearest.
        """
        n = len(queries)
        q, c, d = (np.empty(0, np.int64) for _ in range(3))
        outside = np.bitwise_count((queries ^ self.same) & self.fixed).sum(1, dtype=np.int64)
        own = [self.values(queries, part) for part in self.parts]
        m, open_ = len(self.parts), np.ones(n, bool)
        for distance in range(max(map(len, self.parts)) + 1):
            for segment in range(m):
                if not open_.any():
                    return q, c, d
                if distance <= len(self.parts[segment]):
                    for mq, mc, md in self.met(queries, own[segment], np.flatnonzero(open_), segment, distance):
                        keep = md <= bound[mq]
                        q, c, d = (np.concatenate([x, y[keep]]) for x, y in ((q, mq), (c, mc), (d, md)))
                        order = np.lexsort((low[c], d, q))
                        q, c, d = q[order], c[order], d[order]
                        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                        q, c, d = q[kept], c[kept], d[kept]
                        # no more than what holds k ids can be asked for from now on
                        ids = np.cumsum(size[c])
                        enough = ids - np.where(np.searchsorted(q, q) > 0, ids[np.maximum(np.searchsorted(q, q) - 1, 0)], 0) >= k
                        np.minimum.at(bound, q[enough], d[enough])
                open_ &= bound > outside + m * distance + segment
        return q, c, d


def _packed(df: DataFrame, key: str, parts: int, columns: list[str]) -> DataFrame:
    """A row for each part with rows: (key, and of each column the bytes of its numbers one after the other)."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            flat = [np.array(batch.column(i + 1).flatten() if pa.types.is_list(batch.column(i + 1).type) else batch.column(i + 1)).reshape(len(keys), -1) for i in range(len(columns))]
            for name in np.unique(keys):
                held.setdefault(int(name), []).append([x[keys == name].tobytes() for x in flat])
        for name in list(held):
            found = held.pop(name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([b"".join(f[i] for f in found)], pa.binary()) for i in range(len(columns))]], [key, *columns])

    return df.select(key, *columns).repartition(parts, key).mapInArrow(pack, f"{key} long, " + ", ".join(f"{c} binary" for c in columns))


def _searched(blocks: DataFrame, batches: DataFrame, n_blocks: int, n_batches: int, words: int, k: int, home: bool) -> DataFrame:
    """(query, code, distance, low): the k best of each query in each block, or with home in one block only."""
    of_block = F.expr(f"sequence(0L, {n_batches - 1}L)") if not home else F.expr(f"filter(sequence(0L, {n_batches - 1}L), b -> b % {n_blocks} = block)")
    of_batch = F.expr(f"sequence(0L, {n_blocks - 1}L)") if not home else F.expr(f"array(batch % {n_blocks})")
    pairs = n_batches if home else n_blocks * n_batches
    left = blocks.withColumn("batch", F.explode(of_block)).repartition(pairs, "block", "batch")
    right = batches.withColumn("block", F.explode(of_batch)).repartition(pairs, "block", "batch")

    def search(key: tuple, block: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(batch):
            codes, low, size = (np.frombuffer(block[c].iat[0], t) for c, t in (("code", np.uint64), ("low", np.int64), ("size", np.int64)))
            index = Index(codes.reshape(-1, words))
            queries, bound = np.frombuffer(batch["query"].iat[0], np.uint64).reshape(-1, words), np.frombuffer(batch["bound"].iat[0], np.int64)
            for at in range(0, len(queries), TOGETHER):
                some = queries[at : at + TOGETHER]
                q, c, d = index.nearest(some, bound[at : at + TOGETHER].copy(), low, size, k)
                if len(q):
                    out.append(pd.DataFrame({"query": list(some[q].view(np.int64)), "code": list(index.codes[c].view(np.int64)), "distance": d, "low": low[c]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype=object) for c in ("query", "code")} | {"distance": pd.Series(dtype="int32"), "low": pd.Series(dtype="int64")})

    return left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInPandas(search, "query array<long>, code array<long>, distance int, low long")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, id, distance): the k codes nearest to each query, ties by id.

    codes and queries have columns (id, code), ids whole numbers, codes as `sign_code` makes them, all of one length.
    Rows with a null code or a null id are neither indexed nor searched. Fewer than k codes in all give fewer rows.
    Rows that are repeated count each, in any order.
    """
    spark = codes.sparkSession
    bounded(spark)
    codes = codes.where("code is not null and id is not null").select(F.col("id").cast("long").alias("id"), "code")
    asked = queries.where("code is not null and id is not null").select(F.col("id").cast("long").alias("query_id"), F.col("code").alias("query"))
    ranked = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = lambda keys: Window.partitionBy(*keys).orderBy("id")
    # the k smallest ids of each code, first inside salted shares of it, so no task holds all copies of one code
    few = ranked.withColumn("r", F.row_number().over(near(["code", "salt"]))).where(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(near(["code"]))).where(F.col("r") <= k)
    entries = written(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-entries")
    n, words = entries.agg(F.count("*"), F.max(F.size("code"))).collect()[0]
    wanted = written(asked.select("query").distinct(), "hamming-queries")
    n_queries = wanted.count()
    if not n or not n_queries:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"), F.lit(0).alias("distance")).limit(0)
    n_blocks = -(-n // block)
    # enough batches for all cores, however few queries there are
    n_batches = max(-(-n_queries // batch), min(n_queries, -(-3 * spark.sparkContext.defaultParallelism // n_blocks)))
    blocks = entries.select(F.pmod(F.xxhash64("code"), F.lit(n_blocks)).alias("block"), "code", F.col("ids")[0].alias("low"), F.size("ids").cast("long").alias("size"))
    blocks = written(_packed(blocks, "block", n_blocks, ["code", "low", "size"]), "hamming-blocks")
    dealt = wanted.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(n_batches)))

    def batches(bounds: Column) -> DataFrame:
        return _packed(dealt.withColumn("bound", bounds), "batch", n_batches, ["query", "bound"])

    most = F.lit(words * WORD).cast("long")
    best = Window.partitionBy("query").orderBy("distance", "low")
    if n_blocks > 1:
        first = _searched(blocks, batches(most), n_blocks, n_batches, words, k, True)
        bounds = first.groupBy(F.col("query").alias("of")).agg(F.count("*").alias("n"), F.max("distance").cast("long").alias("far"))
        known = written(bounds, "hamming-bounds")
        dealt = dealt.join(known, F.col("query") == F.col("of"), "left")
        found = _searched(blocks, batches(F.when(F.col("n") >= k, F.col("far")).otherwise(most)), n_blocks, n_batches, words, k, False)
    else:
        found = _searched(blocks, batches(most), n_blocks, n_batches, words, k, False)
    # a code with k others before it, by distance and smallest id, holds none of the k nearest ids
    found = written(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth"), "hamming-found")
    discard(blocks, wanted)
    each = found.join(entries, "code").select("query", "distance", F.explode("ids").alias("id"))
    top = Window.partitionBy("query").orderBy("distance", "id")
    each = each.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return asked.join(each, "query").select("query_id", "rank", "id", "distance")
