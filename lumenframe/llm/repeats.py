"""Repeated byte strings across documents by common-prefix interval trees of sparse suffix arrays.

The suffix array holds the suffixes at anchors: positions whose 16 bytes have the smallest hash of any 35
neighbours, so that every 50-byte string holds an anchor and equal strings hold equal ones. Anchors that only
one document has cannot be part of a repeat and are dropped first. The suffixes of an anchor, cut where no
50-byte string reaches, are sorted together with the bytes before them; a stack scan over their common prefixes
gives the tree of common-prefix intervals, and inside an interval the left extensions are told apart where they
differ. This gives all groups of equal 50-byte strings with all their occurrences, and so for each whether a
smaller document has it too.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import bounded, discard, shared_dir, tidy, written
from lumenframe.llm.shingles import mix

LENGTH = 50
ANCHOR = 16
REACH = LENGTH - ANCHOR
#: Documents' bytes that a task looks at together, and bytes of text for each bucket of anchors.
FLUSH = 16_000_000
PER_BUCKET = 4_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST_ID = (1 << 63) - 1
#: Ids of copies that may be sent to all executors; beyond, they are joined by key.
MAX_SENT = 1_000_000


def _spread(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each window of that width."""
    f, s = (np.minimum if least else np.maximum), 1
    while s * 2 <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    rest = width - s
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def minimizers(h: np.ndarray, width: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions of the values that are the least of some (valid) window of that width; there is one in every window."""
    least = _spread(h, width, True)
    if valid is not None:
        least = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_spread(np.concatenate([pad, least, pad]), width, False)[: len(h)] == h)


def anchors(raw: bytes, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors of a text; none if it is shorter than length. size: a power of two."""
    if len(raw) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, s = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1
    while s < size:
        h = h[:-s] * np.uint64(pow(_BASE, s, 1 << 64)) + h[s:]
        s *= 2
    h = mix(h)
    chosen = minimizers(h, length - size + 1)
    return h[chosen], chosen


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, parent's depth, first, last) of each node of the common-prefix interval tree, by a stack scan.

    lcp[i] is the common prefix of suffixes i and i + 1 of a suffix array. Leaves are not listed.
    """
    depth, up, lo, hi = [], [], [], []
    stack: list[tuple[int, int]] = []  # depth, first
    for i, x in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > x:
            d, first = stack.pop()
            depth.append(d)
            up.append(max(x, stack[-1][0]) if stack else x)
            lo.append(first)
            hi.append(i)
        if x > 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))
    return tuple(np.array(v, np.int64) for v in (depth, up, lo, hi))


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, position), ...]) of every maximal repeat of at least that length, with all occurrences.

    A repeat is maximal if its occurrences differ both in what follows (a node of the tree) and in what comes
    before (left-extension diversity). In memory, for texts of one task.
    """
    data, owner, limit = bytearray(), [], []
    for i, t in enumerate(texts):
        owner += [i] * len(t)
        limit += [len(data) + len(t)] * len(t)
        data += t
    starts = np.cumsum([0, *map(len, texts)])
    order = sorted(range(len(data)), key=lambda p: data[p : limit[p]])
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    for i, (a, b) in enumerate(zip(order, order[1:])):
        n = 0
        while a + n < limit[a] and b + n < limit[b] and data[a + n] == data[b + n]:
            n += 1
        lcp[i] = n
    out = []
    for d, _, lo, hi in zip(*lcp_intervals(lcp)):
        if d >= length:
            at = [order[i] for i in range(lo, hi + 1)]
            before = {data[p - 1] if p > starts[owner[p]] else -1 - p for p in at}
            if len(before) > 1:
                out.append((int(d), sorted((owner[p], int(p - starts[owner[p]])) for p in at)))
    return sorted(out)


def covered_offsets(anchor: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each occurrence of an anchor, and each o up to REACH: whether a smaller doc has the string that begins o bytes before it.

    context: rows of REACH bytes before the anchor, the anchor, and REACH bytes after it; left and right tell
    how many of those before and after belong to the text.
    """
    n = len(anchor)
    out = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return out
    suffix = np.zeros((n, 56), np.uint8)
    suffix[:, : LENGTH] = context[:, REACH:]
    words = suffix.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), anchor])
    anchor, context, suffix, left, right, doc = (x[order] for x in (anchor, context, suffix, left, right, doc))
    differs = suffix[1:, :LENGTH] != suffix[:-1, :LENGTH]
    lcp = np.where(differs.any(1), differs.argmax(1), LENGTH)
    lcp = np.where(anchor[1:] != anchor[:-1], 0, np.maximum(lcp, ANCHOR))
    depth, up, lo, hi = lcp_intervals(lcp)
    before = np.zeros((REACH + 1, n), np.uint64)  # hash of the o bytes before the anchor
    for o in range(1, REACH + 1):
        before[o] = before[o - 1] * np.uint64(_BASE) + context[:, REACH - o].astype(np.uint64) + np.uint64(1)
    found = np.zeros((n, REACH + 1), bool)
    for o in range(REACH + 1):
        at = (depth >= LENGTH - o) & (up < LENGTH - o)  # the nodes that the tree has at this depth
        if not at.any():
            continue
        node = np.repeat(np.flatnonzero(at), (hi - lo + 1)[at])
        many = (hi - lo + 1)[at]
        rows = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + lo[node]
        fits = (left[rows] >= o) & (right[rows] >= REACH - o)
        node, rows = node[fits], rows[fits]
        if not len(rows):
            continue
        # left extensions of a node: its occurrences that agree in the o bytes before
        key = mix(node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + before[o][rows])
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.minimum.reduceat(doc[rows[by]], heads)
        many = np.diff(np.append(heads, len(by)))
        found[rows[by], o] = np.repeat(least, many) < doc[rows[by]]
    out[order] = found
    return out


def _unzipped(z) -> bytes:
    return zstandard.decompress(bytes(z)) if z is not None else b""


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of the batches in lists with about FLUSH bytes of text, the text last and unzipped."""
    some, n = [], 0
    for batch in batches:
        for *row, z in batch.itertuples(index=False, name=None):
            raw = _unzipped(z)
            if some and n + len(raw) > FLUSH:
                yield some
                some, n = [], 0
            some.append((*row, raw))
            n += len(raw)
    if some:
        yield some


def anchor_ids(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor's hash in the upper half, and its last 32 bits: the more buckets, the longer."""
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).view(np.int64)


def _zipped(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 3)


def sent_anchors(anchor: np.ndarray, key: np.ndarray) -> Iterator[pd.DataFrame]:
    """Packed rows for `met_anchors` from the ids of anchors and the keys that have them."""
    order = np.lexsort((key, anchor))
    anchor, key = anchor[order], key[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])])[: len(anchor)]
    anchor, key = anchor[new], key[new]
    if not len(anchor):
        return
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.append(heads, len(anchor)))
    local = np.repeat(many > 1, many)
    if local.any():  # known here already: passed on as they are
        yield pd.DataFrame({"bucket": [int(anchor[local][0] >> 32)], "known": True, "packed": [_zipped(key[local], anchor[local])]})
    # to the others goes one key of each anchor, with a mark if it has several here; ids as their differences
    anchor, key, several = anchor[heads], key[heads], many > 1
    bucket = anchor >> 32
    names, where = np.unique(key, return_inverse=True)
    for part in np.split(np.arange(len(anchor)), np.flatnonzero(np.diff(bucket)) + 1):
        own, short = np.unique(where[part], return_inverse=True)
        kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
        steps = np.diff(anchor[part] & 0xFFFFFFFF, prepend=0).astype(np.uint32)
        packed = _zipped(np.array([len(own), len(part)], np.int64), names[own], steps.view(np.uint8).reshape(-1, 4).T, short.astype(kind), several[part])
        yield pd.DataFrame({"bucket": [int(bucket[part[0]])], "known": False, "packed": [packed]})


def met_anchors(part: pd.DataFrame) -> pd.DataFrame:
    """(key, anchor) of the anchors of a bucket that several keys have."""
    ids, keys, marks, out_keys, out_anchors = [], [], [], [], []
    for bucket, z, known in zip(part["bucket"], part["packed"], part["known"]):
        data = _unzipped(z)
        if known:
            n = len(data) // 16
            out_keys.append(np.frombuffer(data, np.int64, n))
            out_anchors.append(np.frombuffer(data, np.int64, n, 8 * n))
            continue
        n_keys, n = np.frombuffer(data, np.int64, 2)
        at = 16 + 8 * n_keys
        names = np.frombuffer(data, np.int64, n_keys, 16)
        steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel()
        ids.append(np.cumsum(steps.astype(np.int64)) | int(bucket) << 32)
        kind = np.uint16 if n_keys <= 1 << 16 else np.uint32
        keys.append(names[np.frombuffer(data, kind, n, at + 4 * n)])
        marks.append(np.frombuffer(data, bool, n, at + (4 + np.dtype(kind).itemsize) * n))
    if ids:
        anchor, key, mark = (np.concatenate(x) for x in (ids, keys, marks))
        order = np.lexsort((key, anchor))
        anchor, key, mark = anchor[order], key[order], mark[order]
        heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        many = np.diff(np.append(heads, len(anchor)))
        ends = heads + many - 1
        on = np.repeat(key[heads] != key[ends], many) & ~mark  # marked ones are known where they are
        out_keys.append(key[on])
        out_anchors.append(anchor[on])
    return pd.DataFrame({"key": np.concatenate(out_keys), "anchor": np.concatenate(out_anchors)})


def _shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, anchor) of the anchors that several keys have."""

    @tidy
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _grouped(batches):
            found = [anchors(raw)[0] for _, raw in some]
            key = np.repeat(np.array([k for k, _ in some], np.int64), [len(x) for x in found])
            yield from sent_anchors(anchor_ids(np.concatenate(found), buckets), key)

    sent = texts.select("key", "z").mapInPandas(scan, "bucket long, known boolean, packed binary")
    return sent.groupBy("bucket").applyInPandas(met_anchors, "key long, anchor long")


def _spans(texts: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(key, tag, first, past): covered runs of the texts, not merged. texts is bucketed by key."""
    each = shared.groupBy(F.col("key").alias("of")).agg(F.collect_set("anchor").alias("marks"))
    rows = texts.join(each, texts["key"] == each["of"]).select("key", "tag", "marks", "z")

    @tidy
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for some in _grouped(batches):
            hs, owner, at, lefts, rights, mats = [], [], [], [], [], []
            for i, (_, _, marks, raw) in enumerate(some):
                h, p = anchors(raw)
                on = np.isin(anchor_ids(h, buckets), np.asarray(marks, np.int64))
                h, p = h[on], p[on]
                if not len(h):
                    continue
                data = np.frombuffer(bytes(REACH) + raw + bytes(REACH), np.uint8)
                mats.append(np.lib.stride_tricks.sliding_window_view(data, LENGTH + REACH)[p])
                hs.append(h)
                owner.append(np.full(len(h), i))
                at.append(p)
                lefts.append(np.minimum(p, REACH))
                rights.append(np.minimum(len(raw) - ANCHOR - p, REACH))
            if not hs:
                continue
            h, own, p, left, right, mat = (np.concatenate(x) for x in (hs, owner, at, lefts, rights, mats))
            key = np.array([k for k, *_ in some], np.int64)[own]
            tag = np.array([t for _, t, *_ in some], np.int64)[own]
            same = left.astype(np.uint64) * np.uint64(64) + right.astype(np.uint64)
            for c in np.ascontiguousarray(np.pad(mat, ((0, 0), (0, -mat.shape[1] % 8)))).view(np.uint64).T:
                same = mix(same * np.uint64(_BASE) + c)
            order = np.lexsort((key, same))
            heads = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
            many = np.diff(np.append(heads, len(order)))
            least = np.repeat(key[order][heads], many)
            later = order[key[order] > least]
            if len(later):  # the same surroundings in a smaller key of this group: covered whatever else there is
                known = np.stack([key[later], tag[later], p[later] - left[later], p[later] + ANCHOR + right[later]]).astype(np.int64)
                yield pd.DataFrame({"bucket": [int(h[later[0]] >> np.uint64(20)) % buckets], "known": True, "packed": [press.compress(known.tobytes())]})
            rest = np.sort(order[key[order] == least])
            bucket = ((h[rest] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                x = rest[part]
                packed = b"".join([h[x].tobytes(), key[x].tobytes(), tag[x].tobytes(), p[x].astype(np.int64).tobytes(), left[x].astype(np.uint8).tobytes(), right[x].astype(np.uint8).tobytes(), mat[x].tobytes()])
                yield pd.DataFrame({"bucket": [bucket[part[0]]], "known": False, "packed": [press.compress(packed)]})

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        out = [np.empty((4, 0), np.int64)]
        width = LENGTH + REACH
        for z, known in zip(part["packed"], part["known"]):
            data = _unzipped(z)
            if known:
                out.append(np.frombuffer(data, np.int64).reshape(4, -1))
                continue
            n, start = len(data) // (34 + width), 0
            for column, kind in zip(got, (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8)):
                column.append(np.frombuffer(data, kind, n, start))
                start += n * np.dtype(kind).itemsize
            got[6].append(np.frombuffer(data, np.uint8, n * width, start).reshape(n, width))
        if got[0]:
            h, key, tag, p, left, right, mat = (np.concatenate(x) for x in got)
            on = covered_offsets(h, mat, left.astype(np.int64), right.astype(np.int64), key)
            row, o = np.nonzero(on)
            # runs of neighbouring offsets are one span
            heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (o[1:] != o[:-1] + 1)])[: len(row)])
            last = np.append(heads[1:], len(row)) - 1 if len(row) else heads
            out.append(np.stack([key[row[heads]], tag[row[heads]], p[row[last]] - o[last], p[row[heads]] - o[heads] + LENGTH]))
        return pd.DataFrame(dict(zip(("key", "tag", "first", "past"), np.concatenate(out, 1))))

    sent = rows.mapInPandas(contexts, "bucket long, known boolean, packed binary")
    return sent.groupBy("bucket").applyInPandas(resolve, "key long, tag long, first long, past long")


def drop_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept binary) for each row of df.

    A byte is removed if a string of LENGTH bytes that covers it also begins in a row with a smaller id; null
    ids are larger than any other. Null texts are empty. Rows with one id do not count for each other. kept is
    the rest of the text's UTF-8 bytes.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("key"), raw.alias("raw"))
    rows = rows.withColumn("md5", F.unhex(F.md5("raw"))).withColumn("tag", F.xxhash64("md5"))
    known = written(rows.select("id", "key", "tag", "md5", F.length("raw").cast("long").alias("n")), "repeat-rows")
    firsts = written(known.groupBy("md5").agg(F.min("key").alias("least")), "repeat-firsts")
    each = written(known.join(firsts, "md5").select("id", "key", "tag", "n", "least", (F.col("key") > F.col("least")).alias("copy")), "repeat-rows")
    # copies of a whole text need no text any more: only first ones go on, zipped and bucketed by key once
    copies = each.where("copy").select(F.col("key").alias("copy_key"), F.col("tag").alias("copy_tag")).distinct()
    if copies.count() <= MAX_SENT:
        copies = F.broadcast(copies)

    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        return pd.Series([zstandard.compress(bytes(x), 3) for x in texts], dtype=object)

    only = rows.join(copies, (rows["key"] == copies["copy_key"]) & (rows["tag"] == copies["copy_tag"]), "left_anti")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    # a bucketed table in the shared folder, not in the warehouse
    bounded(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    only.select("key", "tag", zipped("raw").alias("z")).repartition(buckets, "key").write.option("compression", "none").option("path", path).bucketBy(buckets, "key").saveAsTable(name)
    texts = spark.table(name)
    size = known.agg(F.sum("n")).collect()[0][0] or 0
    shares = max(1, -(-int(size) // PER_BUCKET))
    discard(known, firsts)
    spans = _spans(texts, _shared_anchors(texts, shares), shares)
    merged = written(spans.groupBy(F.col("key").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_list(F.struct("first", "past")).alias("spans")), "repeat-spans")
    found = texts.join(merged, (texts["key"] == merged["of"]) & (texts["tag"] == merged["of_tag"]), "left").select("key", "tag", "spans", "z")

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _grouped(batches):
            out = []
            for key, tag, spans, data in some:
                kept, n = _cut(data, spans)
                out.append((key, tag, len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pd.DataFrame(out, columns=["of", "of_tag", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = found.mapInPandas(cut, "of long, of_tag long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done.dropDuplicates(["of", "of_tag"]) if keep_text else done.drop("kept").dropDuplicates(["of", "of_tag"])
    joined = each.join(done, (each["least"] == done["of"]) & (each["tag"] == done["of_tag"]))
    gone = F.col("copy") & (F.col("n") >= LENGTH)
    out = [
        F.when(gone, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    ]
    return joined.select("id", F.col("n").alias("n_bytes"), *out)


def drop_texts(spark) -> None:
    """Removes the bucketed texts that earlier calls have left; results that are not read yet need theirs."""
    for t in spark.catalog.listTables():
        if t.name.startswith("repeat_texts_"):
            spark.sql(f"drop table `{t.name}`")
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{t.name}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _cut(data: bytes, spans) -> tuple[bytes, int]:
    """What is left of the bytes, and the number of maximal runs removed."""
    if spans is None or not len(spans):
        return data, 0
    on = np.zeros(len(data) + 1, np.int64)
    bounds = np.array([(s["first"], s["past"]) for s in spans], np.int64)
    np.add.at(on, bounds[:, 0], 1)
    np.add.at(on, bounds[:, 1], -1)
    gone = np.cumsum(on)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs
