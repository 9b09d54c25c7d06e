"""Packing documents into sequences of fixed length by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round, one window long, a queue's deficit grows by its quantum,
its share of the window; it sends as many tokens as the deficit covers, cutting documents freely, and carries the
rest of it into the next round. What a queue has sent after R rounds is therefore the whole part of R quanta, or
all it has, so a token's round follows from its place in its queue, and its place in the stream from what all
queues have sent by then: deficits carry over every window and every partition, no task sees another's queue, and
nothing is sorted. Queues whose quantum is under LEAST tokens save up for that many, each from another start, so
that documents of small sources are not cut to bits. The windows are cut from that one stream, so only the last can need
padding, and each holds the targets but for a few tokens.
"""

from __future__ import annotations

import base64
import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import bounded, discard, tidy, written

WINDOW = 1024
#: Queues at most: a window cannot hold more sources than tokens. Beyond, sources share queues, by hash.
QUEUES = 1024
#: Tokens that a queue sends at least, and of which queues with smaller quanta send multiples.
LEAST = 32
#: Partitions whose counts are summed in one task.
RUN = 4096
END = 0


class Encoder:
    """Token ids of a text as the tokenizer file gives them, followed by the id that ends a document.

    With the file's ranks and pattern, and `tiktoken` installed, all texts without the string of a special token go
    through that library: the same ids, for every code point, in a fifth of the time.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(tokenizer_path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks_path and pattern:
            with contextlib.suppress(ImportError):
                import tiktoken

                with open(ranks_path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        ids: list[int] = []
        if text and self.fast is not None and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        elif text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = np.empty(len(ids) + 1, np.uint32)
        out[:-1] = ids
        out[-1] = END
        return out


def tokenized(df: DataFrame, encoder_args: tuple, *, id_col: str, text_col: str, source_col: str, shared: bool = False) -> DataFrame:
    """(id, source, queue, part, before, n, ids): a document's tokens, and those of its queue before it in its partition."""
    source = F.col(source_col).cast("string")
    queue = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(QUEUES)).cast("string")) if shared else source
    rows = df.select(F.col(id_col).alias("id"), source.alias("source"), queue.alias("queue"), F.col(text_col).alias("text"))

    @tidy
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, before, part = Encoder(*encoder_args), {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), 500):
                some, starts, ids = batch.iloc[at : at + 500], [], []
                for queue, text in zip(some["queue"], some["text"]):
                    got = encoder(text if isinstance(text, str) else None)
                    queue = queue if isinstance(queue, str) else None
                    starts.append(before.get(queue, 0))
                    before[queue] = starts[-1] + len(got)
                    ids.append(got)
                yield pd.DataFrame({"id": some["id"], "source": some["source"], "queue": some["queue"], "part": part, "before": starts, "n": [len(x) for x in ids], "ids": [_packed(x) for x in ids]})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(encode, f"id {kind}, source string, queue string, part int, before long, n long, ids binary")


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint16).tobytes() if ids.max() < 65536 else b"w" + ids.tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids[1:], np.uint32) if len(ids) % 2 else np.frombuffer(ids, np.uint16).astype(np.uint32)


class Schedule:
    """What queues have sent after any round: quantum and number of tokens of each, in the order of a round.

    Queues without a quantum send theirs after all others, one after the other.
    """

    def __init__(self, quantum: np.ndarray, total: np.ndarray):
        quantum, self.total = np.asarray(quantum, float), np.asarray(total, np.int64)
        self.paid = quantum > 0
        self.unit = np.where(quantum >= LEAST, 1, LEAST)
        self.rate = quantum / self.unit
        self.phase = np.where(self.unit > 1, np.arange(1, len(quantum) + 1) * 0.6180339887498949 % 1, 0.0)
        late = np.where(self.paid, 0, self.total)
        self.late = self.total[self.paid].sum() + np.cumsum(late) - late

    def _units(self, rounds: np.ndarray, queue) -> np.ndarray:
        return np.floor(rounds * self.rate[queue] + self.phase[queue]).astype(np.int64)

    def sent(self, rounds: np.ndarray, queue) -> np.ndarray:
        """Tokens that a queue has sent after so many rounds."""
        return np.where(self.paid[queue], np.minimum(self._units(rounds, queue) * self.unit[queue], self.total[queue]), 0)

    def round_of(self, queue: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The round, from 0, in which a queue with a quantum sends this unit of it."""
        r = np.maximum(np.ceil((unit + 1 - self.phase[queue]) / self.rate[queue]) - 1, 0).astype(np.int64)
        for _ in range(3):  # the estimate is a round off at most, but for the last bits of doubles
            r += self._units(r + 1, queue) <= unit
            r -= (self._units(r, queue) > unit) & (r > 0)
        return r

    def pieces(self, queue: np.ndarray, spot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first, length, place): the parts of documents (n tokens at a place of a queue) that a round sends, and where they go."""
        paid, unit = self.paid[queue], self.unit[queue]
        saves = paid & (unit > 1)
        first = spot // unit  # of queues that save up: units, each in a round of its own; of the others: rounds
        last = (spot + n - 1) // unit
        whole = paid & ~saves
        first[whole], last[whole] = self.round_of(queue[whole], first[whole]), self.round_of(queue[whole], last[whole])
        many = np.where(paid, last - first + 1, 1)
        doc = np.repeat(np.arange(len(queue)), many)
        r = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        q, on = queue[doc], paid[doc]
        low, high = spot[doc], (spot + n)[doc]
        some = saves[doc]
        low[some], high[some] = np.maximum(low[some], r[some] * unit[doc][some]), np.minimum(high[some], (r[some] + 1) * unit[doc][some])
        r[some] = self.round_of(q[some], r[some])
        some = whole[doc]
        low[some], high[some] = np.maximum(low[some], self.sent(r[some], q[some])), np.minimum(high[some], self.sent(r[some] + 1, q[some]))
        place = np.where(on, low, self.late[q] + low)
        step = max(1, 4_000_000 // len(self.total))
        each, which = np.unique(r[on], return_inverse=True)
        before = np.zeros(int(on.sum()), np.int64)
        for at in range(0, len(each), step):  # what all queues have sent by each of these rounds, and those before one in the next
            some = each[at : at + step, None]
            every = np.arange(len(self.total))[None]
            done, next_ = self.sent(some, every), self.sent(some + 1, every)
            here = (which >= at) & (which < at + step)
            ahead = np.cumsum(next_ - done, axis=1) - (next_ - done)
            row, own = which[here] - at, q[on][here]
            before[here] = done.sum(1)[row] + ahead[row, own] - done[row, own]
        place[on] += before
        kept = high > low
        return doc[kept], (low - spot[doc])[kept], (high - low)[kept], place[kept]


def _bases(by_part: DataFrame) -> DataFrame:
    """(named, of_part, base): the tokens of a queue in the partitions before one, summed in runs of RUN partitions."""
    run = F.expr(f"part div {RUN}")
    runs = by_part.groupBy("queue", run.alias("run")).agg(F.sum("n").alias("n"))
    past = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy("queue", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("queue").alias("of"), F.col("run").alias("of_run"), past("run").alias("before"))
    inside = by_part.withColumn("run", run).withColumn("inside", past("run", "part"))
    both = inside.join(runs, F.col("queue").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")))
    return both.select(F.col("queue").alias("named"), F.col("part").alias("of_part"), (F.col("before") + F.col("inside")).alias("base"))


def pack(df: DataFrame, encoder_args: tuple, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    weights: target share of each source in the windows as long as its queue lasts, not negative; unnamed sources
    weigh 1, and those without weight come after all others. Without weights the target is a source's share of all
    tokens, so that all queues end together. All tokens are packed, each once. A null text is an empty one and
    gives the end token only; a null source is a queue of its own; equal rows are documents of their own. Of more than
    QUEUES sources several share a queue, whose weight is the sum of theirs. An empty table gives no pieces.
    """
    spark = df.sparkSession
    bounded(spark)
    shared = df.select(F.col(source_col).cast("string")).distinct().count() > QUEUES
    tokens = written(tokenized(df, encoder_args, id_col=id_col, text_col=text_col, source_col=source_col, shared=shared), "pack-tokens")
    by_part = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-parts")
    totals = tokens.groupBy("source", "queue").agg(F.sum("n").alias("n"))
    if weights is None:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    else:
        # a map of the caller's own size
        named = F.create_map(*[F.lit(x) for s, w in weights.items() if s is not None for x in (s, float(w))]) if any(s is not None for s in weights) else None
        known = F.coalesce(named[F.col("source")], F.lit(1.0)) if named is not None else F.lit(1.0)
        totals = totals.withColumn("weight", F.when(F.col("source").isNull(), float(weights.get(None, 1.0))).otherwise(known))
    queues = totals.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).toPandas()  # QUEUES and one at most
    queues = queues.sort_values("queue", na_position="last", ignore_index=True)
    whole = queues["weight"].sum() or 1.0
    plan = Schedule(queues["weight"].to_numpy(float) * window / whole, queues["n"].to_numpy(np.int64))
    number = {q if isinstance(q, str) else None: i for i, q in enumerate(queues["queue"])}
    bases = written(_bases(by_part), "pack-bases")  # of known size: broadcast by the planner if it fits, else joined by key
    joined = tokens.join(bases, (tokens["part"] == bases["of_part"]) & tokens["queue"].eqNullSafe(bases["named"]))
    rows = joined.select("id", "queue", (F.col("base") + F.col("before")).alias("spot"), "n", "ids")
    kind = dict(rows.dtypes)["id"]

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1_000):
                some = batch.iloc[i : i + 1_000]
                n = some["n"].to_numpy(np.int64)
                queue = np.array([number[q if isinstance(q, str) else None] for q in some["queue"]])
                doc, first, length, place = plan.pieces(queue, some["spot"].to_numpy(np.int64), n)
                # a part that crosses the end of a window is two pieces
                many = (place + length - 1) // window - place // window + 1
                part = np.repeat(np.arange(len(doc)), many)
                w = (place // window)[part] + np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.maximum(place[part], w * window), np.minimum((place + length)[part], (w + 1) * window)
                start, doc = first[part] + low - place[part], doc[part]
                ids = [memoryview(np.ascontiguousarray(unpacked(x), "<u4")).cast("B") for x in some["ids"]]
                crc = [zlib.crc32(ids[d][4 * a : 4 * b]) for d, a, b in zip(doc.tolist(), start.tolist(), (start + high - low).tolist())]
                yield pd.DataFrame({"id": some["id"].to_numpy()[doc], "start": start, "length": high - low, "ids_crc32": crc, "doc_tokens": n[doc], "sequence_id": w, "offset": low - w * window})

    discard(by_part)
    return rows.mapInPandas(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
