"""Near-duplicate groups by SetSketch registers: band the registers, estimate by likelihood, verify on full sets.

Equal shingle sets are one node from the start, so copies of a text cost nothing later; a node goes by a long
number, and sketches and sets are only joined where they are read. Bands of register values put nodes into
buckets. Every bucket is first linked as a star: each member with the bucket's smallest node, so a bucket of any
size gives as many pairs as members. Pairs whose likelihood estimate is far under the threshold go; the rest are
compared on full sets. Where a bucket still holds members of different groups, these meet in blocks bounded in
rows and bytes: first their registers, which leave the members that have a possible partner in another group,
then the full sets of those, whose products give all sizes of intersections at once; of the links found there
only as many leave the task as it takes to connect the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import shingles
from lumenframe.llm.shared import bounded, discard, fresh, tidy, written

BANDS, ROWS = 36, 4
PERCENT = 75
#: Pairs with an estimate below are not compared: over five standard deviations under the threshold.
ESTIMATE = 0.55
#: Members of a bucket, and bytes of their full sets, that one task compares with as many others.
BLOCK = 1_024
BLOCK_BYTES = 8_000_000
#: Ids that may be sent to all executors; beyond, they are joined by key.
MAX_SENT = 1_000_000
#: Pairs of a star whose members' sets meet one copy of its centre's.
STAR = 1_024
#: Bytes of text that are hashed together.
_GROUP_BYTES = 1_000_000


def _batches(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in groups of bounded size (or one text), with the position of the first."""
    group, at, n = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if group and n + len(raw) > _GROUP_BYTES:
            yield at, group
            group, at, n = [], i, 0
        group.append(raw)
        n += len(raw)
    if group:
        yield at, group


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs for each set that tell sets apart."""
    return np.frombuffer(b"".join(shingles.digest(s) for s in sets), np.int64).reshape(-1, 2)


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d0, d1, n, sketch): the digest of the shingle set, its size and registers; null where it is empty."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, group in _batches(list(batch["text"])):
                sets = shingles.shingle_sets(group)
                made, d = shingles.sketches(sets), _digests(sets)
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + len(group)], "d0": d[:, 0], "d1": d[:, 1], "n": [len(s) for s in sets], "sketch": [k.tobytes() if len(s) else None for s, k in zip(sets, made)]})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, d0 long, d1 long, n long, sketch binary")


def full_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the wanted nodes (columns node, id, d0, d1), from the texts."""
    ids = wanted.select(F.col("id").alias("wanted_id"))
    if ids.count() <= MAX_SENT:
        ids = F.broadcast(ids)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(ids, rows["id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in _batches(list(batch["text"])):
                sets = [s for s in shingles.shingle_sets(group) if len(s)]
                d = _digests(sets)
                yield pd.DataFrame({"e0": d[:, 0], "e1": d[:, 1], "shingles": [s.tobytes() for s in sets]})

    sets = rows.mapInPandas(run, "e0 long, e1 long, shingles binary")
    named = sets.join(wanted.select("node", "d0", "d1"), (F.col("e0") == F.col("d0")) & (F.col("e1") == F.col("d1")))
    return named.select("node", "shingles").dropDuplicates(["node"])


@F.pandas_udf(T.DoubleType())
@tidy
def _estimate(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    rows = lambda x: np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
    for a, b, na, nb in batches:
        yield pd.Series(shingles.joint_estimate(rows(a), rows(b), na.to_numpy(float), nb.to_numpy(float)) if len(a) else [], dtype="float64")


@F.pandas_udf(T.BooleanType())
@tidy
def _linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pd.Series(out, dtype="bool")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches, by distributed label spreading."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("b", "node").alias("label")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = nearer.join(jump, nearer["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        moved = written(moved, "near-labels")
        discard(labels)
        labels = moved.select("node", "label")
        labels._written = moved._written
        if not moved.where("label != old").limit(1).count():
            discard(both)
            return labels


def near_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df.

    component_id is the smallest id that the row reaches over links, its own included; kept tells whether that
    is its own. Null and empty texts, and texts of white space, have no shingles and no links. Rows that are
    repeated share all values. Null ids count as larger than any other.
    """
    bounded(df.sparkSession)
    # numbers of rows are fixed once the table is written
    each = written(sketched(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    reps = each.where("n > 0").groupBy("d0", "d1").agg(F.min("row").alias("node"), F.min("id").alias("id"))
    reps = written(reps, "near-reps")
    nodes = written(each.select("row", "n", "sketch").join(reps.select("node"), F.col("row") == F.col("node")).select("node", "n", "sketch"), "near-nodes")

    @tidy
    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not len(batch):
                continue
            regs = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(salt, (len(batch), BANDS))
            for i in range(ROWS):
                keys = shingles.mix(keys * np.uint64(0x2545F4914F6CDD1D) + regs[:, :, i])
            yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), BANDS), "key": keys.view(np.int64).ravel()})

    bands = nodes.select("node", "sketch").mapInPandas(band, "node long, key long")
    centers = bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center != last").select("key", "center")
    shared = written(bands.join(centers, "key").select("key", "node", "center"), "near-buckets", spread=True)
    stars = shared.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    edges = _verified(_close(stars, nodes), df, id_col, text_col, reps)
    labels = components(edges)
    more = _across(shared, labels, nodes, df, id_col, text_col, reps)
    if more.limit(1).count():
        discard(labels)
        labels = components(edges.unionByName(more))
    discard(shared, edges, more, nodes)
    ids = labels.join(reps.select("node", "id"), "node")
    smallest = ids.groupBy("label").agg(F.min("id").alias("component_id"))
    grouped = labels.join(smallest, "label").select("node", "component_id")
    own_id = written(reps.join(grouped, "node", "left").select(F.col("d0").alias("e0"), F.col("d1").alias("e1"), F.coalesce("component_id", "id").alias("component_id")), "near-groups")
    discard(labels, reps)
    rows = each.select("id", "n", "d0", "d1").join(own_id, (F.col("n") > 0) & (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a").drop("sa"), "a").join(side("b").drop("sb"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    full = sized.join(side("a").drop("na"), "a").join(side("b").drop("nb"), "b")
    return full.where(_estimate("sa", "sb", "na", "nb") >= ESTIMATE).select("a", "b")


def _verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    pairs = written(pairs, "near-pairs", spread=True)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(ends.join(reps, "node"), "near-wanted")
    sets = written(full_sets(df, id_col, text_col, wanted), "near-sets", spread=True)
    # the centre of a large star is dealt out in several copies, each for about STAR of its members
    hot = pairs.groupBy(F.col("a").alias("hot")).agg(F.count("*").alias("members")).where(f"members > {STAR}")
    hot = written(hot.select("hot", F.ceil(F.col("members") / STAR).cast("int").alias("copies")), "near-hot")
    copies = F.coalesce("copies", F.lit(1))
    salted = pairs.join(hot, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("copy"))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    centers = side("a").join(pairs.select("a").distinct(), "a", "left_semi").join(hot, F.col("a") == F.col("hot"), "left")
    centers = centers.select("a", "sa", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    found = written(salted.join(side("b"), "b").join(centers, ["a", "copy"]).where(_linked("sa", "sb")).select("a", "b"), "near-links", spread=True)
    discard(pairs, wanted, sets, hot)
    return found


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows of buckets with (i, j): a block meets itself and every other block of its bucket once."""
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return own.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", blocks)


def _across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that share a bucket and lie in different groups so far: enough to connect the groups."""
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members")).where("x != y and members > 2")
    counts = counts.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    left = written(named.where("node != center").join(counts, "key").select("key", "node", "label", "blocks"), "near-across")

    def possible(part: pd.DataFrame) -> pd.DataFrame:
        return part[["key", "node", "label", "n"]][with_partner(np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(len(part), -1), part["n"].to_numpy(), part["label"].to_numpy(), part["block"].to_numpy())]

    known = _dealt(left.join(nodes, "node"), "blocks")
    hits = known.groupBy("key", "i", "j").applyInPandas(possible, "key long, node long, label long, n long").distinct()
    hits = written(hits, "near-possible", spread=True)
    sizes = hits.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    sizes = sizes.select("of", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    wanted = written(hits.select("node").distinct().join(reps, "node"), "near-wanted")
    sets = written(full_sets(df, id_col, text_col, wanted), "near-sets", spread=True)
    dealt = _dealt(hits.join(sizes, F.col("key") == F.col("of")).select("key", "node", "label", "blocks"), "blocks").join(sets, "node")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        a, b = connecting_links([np.frombuffer(x, np.uint64) for x in part["shingles"]], pd.factorize(part["label"])[0], part["block"].to_numpy())
        node = part["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    links = dealt.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "near-links", spread=True)
    discard(left, hits, wanted, sets)
    return links


def with_partner(registers: np.ndarray, n: np.ndarray, label: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Of each row: whether a row of another label, with two blocks of the other block, may be linked with it.

    So many registers of a linked pair are equal but for a chance like that of ESTIMATE: the share of equal ones
    is about the similarity. Rows that have a partner are not compared with further ones, so a bucket of near
    copies costs a few columns and not all pairs.
    """
    out, least = np.zeros(len(n), bool), ESTIMATE * registers.shape[1]
    two = len(np.unique(block)) > 1
    by_register = np.ascontiguousarray(registers.T)
    order = np.random.default_rng(0).permutation(len(n))
    for start in range(0, len(n), 128):
        cols, rows = order[start : start + 128], np.flatnonzero(~out)
        may = label[rows][:, None] != label[cols][None, :]
        if two:
            may &= block[rows][:, None] != block[cols][None, :]
        may &= 100 * np.minimum(n[rows][:, None], n[cols][None, :]) >= PERCENT * np.maximum(n[rows][:, None], n[cols][None, :])
        if may.any():
            same = np.zeros(may.shape, np.uint16)
            for r in by_register:
                same += r[rows][:, None] == r[cols][None, :]
            may &= same >= least
            out[rows] |= may.any(1)
            out[cols] |= may.any(0)
        if out.all():
            break
    return out


def connecting_links(sets: list[np.ndarray], label: np.ndarray, block: np.ndarray, columns: int = 2_048, singly: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different labels, as few as connect all labels that any such pair connects.

    With two blocks only pairs between them are looked at. One row after the other that is not in the largest
    group so far meets all others; where rows are still left after `singly` of them, sizes of intersections are
    products of incidence matrices over the shingles that several sets have, a bounded number of columns at a time.
    Groups that are dense in links are connected after a few rows.
    """
    n, two = len(sets), len(np.unique(block)) > 1
    size = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(size) - size
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    group, a, b = np.unique(label, return_inverse=True)[1], [], []

    def join(row: int, hits: np.ndarray) -> None:
        while len(hits := hits[group[hits] != group[row]]):
            a.append(row)
            b.append(int(hits[0]))
            group[group == group[hits[0]]] = group[row]

    def left() -> np.ndarray:
        return np.flatnonzero((group != np.bincount(group).argmax()) & ~done)

    done, flags = np.zeros(n, bool), np.zeros(where.max(initial=-1) + 1, np.int64)
    for _ in range(singly):
        rest = left()
        if not len(rest):
            return np.array(a, np.int64), np.array(b, np.int64)
        row = int(rest[0])
        own = where[starts[row] : starts[row] + size[row]]
        flags[own] = 1
        both = np.add.reduceat(flags[where], starts)
        flags[own] = 0
        hit = (100 * both >= PERCENT * (size[row] + size - both)) & (label != label[row])
        if two:
            hit &= block != block[row]
        join(row, np.flatnonzero(hit))
        done[row] = True
    few = left()
    if not len(few):
        return np.array(a, np.int64), np.array(b, np.int64)
    common = np.bincount(where) > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[where]
    owner = np.repeat(np.arange(n), size)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(few), n), np.float32)
    for start in range(0, int(common.sum()), columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        x = np.zeros((n, columns), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        both += x[few] @ x.T
    hit = (100 * both >= PERCENT * (size[few][:, None] + size[None, :] - both)) & (label[few][:, None] != label[None, :])
    if two:
        hit &= block[few][:, None] != block[None, :]
    for row, hits in zip(few.tolist(), hit):
        join(row, np.flatnonzero(hits))
    return np.array(a, np.int64), np.array(b, np.int64)


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one document of each group, that of the smallest id, and all rows without a group.

    Rows that repeat an id and its text are one document and stay once.
    """
    found = near_groups(df, id_col=id_col, text_col=text_col)
    name = fresh(df, "near_id")[0]
    by_id = written(found.groupBy(F.col("id").alias(name)).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "near-kept")
    gone, again = by_id.where("not kept").select(name), by_id.where("kept and rows > 1").select(name)
    if gone.count() <= MAX_SENT:
        gone = F.broadcast(gone)
    rest = df.join(gone, df[id_col].eqNullSafe(gone[name]), "left_anti")
    if not again.limit(1).count():
        return rest
    again = written(again, "near-again")
    same = rest[id_col].eqNullSafe(again[name])
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
