"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are shuffled and laid end to end, and its words cut into blocks of equal size. The
schedule's slots are the points of a golden-ratio sequence, mapped through the cumulative numbers of slots
that the sources need; the k-th slot of a source takes its k-th block, starting over after the last. So any
stretch of the schedule holds the sources in nearly their target proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import NOT_SPACE, fresh, unit_hash, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 256
#: The golden-ratio step as a fraction of 2 ** 40, odd; and that step 2 ** 21 times.
_ONE = 1 << 40
_STEP = 679_572_821_001
_BIG_STEP = (_STEP << 21) % _ONE
_CELLS = 2_048


def words_of(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Split share * sum(sizes) by weight; a target stops at cap * size, its excess goes to the others by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > cap * sizes[i] * total} if total else set()
        for i in over or open_:
            out[i] = cap * sizes[i] if over else (left * weights[i] / total if total else 0.0)
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def plan(sized: DataFrame, weights, share: float, cap: float, block: int) -> DataFrame:
    """A row for each source, numbered by code point, null last: (named, number, source_size, target, take, blocks, slots).

    The same targets as `targets` gives. In the order of cap * size / weight the sources that stop come first, so sums
    over the order tell the first one that does not. Windows over all sources see a row for each.
    """
    found = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    each = found.withColumn("number", number).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    each = written(each.select(F.col("source").alias("named"), "number", "source_size", "w", (F.col("source_size") * float(cap)).alias("most")), "mix-sources")
    order = Window.orderBy("r", "number")
    ordered = each.withColumn("r", F.when(F.col("w") > 0, F.col("most") / F.col("w")).otherwise(float("inf")))
    # of each source: what is left for it and those after it if all before it stop
    left = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ordered = ordered.withColumns({"left": left, "total": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    open_ = ordered.where("total > 0 and left * w <= most * total").orderBy("r", "number").limit(1).collect()  # one row
    if open_:
        left, total, r, at = (open_[0][c] for c in ("left", "total", "r", "number"))
        stops = (F.col("r") < F.lit(r)) | ((F.col("r") == F.lit(r)) & (F.col("number") < at))
        target = F.when(stops, F.col("most")).otherwise(F.lit(left) * F.col("w") / F.lit(total))
    else:
        target = F.when(F.col("w") > 0, F.col("most")).otherwise(0.0)
    size, take = F.col("source_size"), F.col("take")
    taken = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("most")))
    slots = F.when(size > 0, F.expr(f"take div source_size * blocks + (take % source_size + {block} - 1) div {block}")).otherwise(F.lit(0))
    out = ordered.withColumn("target", target).withColumn("take", taken.cast("long")).withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}"))
    return written(out.withColumn("slots", slots.cast("long")).select("named", "number", "source_size", "target", "take", "blocks", "slots"), "mix-plan")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix in any order: (number, rank, slot, block, take).

    sources: (number, source_size, take, blocks, slots). number: the source's; rank: among its slots; slot: place
    in the schedule; take: words of that block, less than the whole one only in a source's last slot.
    """
    spark = sources.sparkSession
    needs = sources.where("slots > 0").select("number", F.col("source_size").alias("of_size"), F.col("take").alias("of_take"), F.col("blocks").alias("of_blocks"), F.col("slots").alias("of_slots"))
    n, total = needs.agg(F.count("*"), F.sum("of_slots")).collect()[0]
    total = int(total or 0)
    cells = max(_CELLS, 1 << (4 * n).bit_length())
    width = _ONE // cells
    past = F.sum("of_slots").over(Window.orderBy("number"))  # a row for each source
    bound = lambda c: F.expr(f"(cast({c} as decimal(20, 0)) * {_ONE}) div {max(1, total)}")
    bounds = needs.withColumn("past", past).withColumn("at", F.col("past") - F.col("of_slots")).withColumns({"lo": bound("at"), "hi": bound("past")}).drop("at", "past")
    bounds = written(bounds, "mix-bounds")
    by_cell = bounds.select("number", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"greatest(lo, hi - 1) div {width}"))).alias("cell"))
    chunk = 1 << max(8, (total.bit_length() + 1) // 2)
    i = F.col("id")
    point = (F.shiftright(i, 21) * F.lit(_BIG_STEP) + (i % (1 << 21)) * F.lit(_STEP)) % F.lit(_ONE)
    points = spark.range(total).select("id", point.alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    mapped = points.join(written(by_cell, "mix-cells"), "cell").where("u >= lo and u < hi").select("number", "id", F.expr(f"id div {chunk}").alias("chunk"))
    # ranks in two steps, so that no task sees all slots of one source: inside chunks, and over the chunks' counts
    inside = mapped.withColumn("inside", F.row_number().over(Window.partitionBy("chunk", "number").orderBy("id")) - 1)
    counts = mapped.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = inside.join(counts.withColumn("before", before), ["number", "chunk"]).select("number", (F.col("before") + F.col("inside")).alias("rank"), F.col("id").alias("slot"))
    # a source can get a few slots too many or too few: surplus ones go, missing ones follow at the end
    lows = bounds.drop("lo", "hi")
    got = lows.join(counts.groupBy("number").agg(F.sum("n").alias("got")), "number", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    missing = got.where("got < of_slots").select("number", F.explode(F.sequence("got", F.col("of_slots") - 1)).alias("rank")).withColumn("slot", F.lit(total) + F.col("rank"))
    all_ = ranked.unionByName(missing).join(lows, "number").where("rank < of_slots")
    b, in_block = F.expr("rank % of_blocks"), F.expr(f"least({block}, of_size - (rank % of_blocks) * {block})")
    left = F.expr(f"of_take - (rank div of_blocks) * of_size - (rank % of_blocks) * {block}")
    return all_.select("number", "rank", "slot", b.alias("block"), F.greatest(F.lit(0), F.least(in_block, left)).alias("take"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """A row for each row of df: (id, source, size, source_size, target, taken).

    weights are dealt to the sources by code point (null last), repeating. size counts words (null text: 0),
    target is what the whole source should give, taken what the mix takes of this row, repeats counted: never
    more than cap * size. Rows that are equal in id, source and size share their places in any order, so their
    taken words may be exchanged, no more. An empty table gives an empty result.
    """
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(text_col).alias("size")), "mix-sizes")
    sources = plan(sized, weights, share, cap, block)
    n = sized.count()
    buckets = max(1, min(1 << 16, n // 2_000))
    named = sources.select("named", "number", "source_size", "target")
    known = sized.join(named, sized["source"].eqNullSafe(named["named"])).drop("named")
    known = known.withColumn("h", unit_hash("id", "size")).withColumn("bucket", (F.col("h") * buckets).cast("int"))
    order = Window.partitionBy("number", "bucket").orderBy("h", "id", "size")
    placed = known.withColumn("in_bucket", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(order))
    totals = known.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(totals.select("number", "bucket", before.alias("before")), ["number", "bucket"]).withColumn("start", F.col("before") + F.col("in_bucket"))
    last = F.expr(f"(start + size - 1) div {block}")
    parts = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last)).otherwise(F.array(F.lit(-1).cast("long")))))
    slots = schedule(sources, block).select(F.col("number"), F.col("block"), F.col("take"))
    joined = parts.join(slots, ["number", "block"], "left")
    overlap = F.expr(f"greatest(0, least(start + size, block * {block} + coalesce(take, 0)) - greatest(start, block * {block}))")
    keys = ["number", "bucket", "nth", "id", "source", "size", "source_size", "target"]
    summed = joined.groupBy(*keys).agg(F.sum(overlap).cast("long").alias("taken"))
    return summed.select("id", "source", "size", "source_size", "target", "taken")


def repeat_taken(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of df, each as often as the mix takes it whole (to the nearest number of times), with df's columns.

    A source's slots take its shuffled documents in their order, over and over, so what is taken of it is some
    whole passes and then all documents up to one place in that order. A row for each source tells both, and
    the texts stay where they are. Texts without words are not taken.
    """
    of, passes, cut, size, spot, copy = fresh(df, "mix_source", "mix_passes", "mix_cut", "mix_size", "mix_spot", "mix_copy")
    mixed = written(mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **settings).where("size > 0"), "mix-taken")
    # a row for each source, written: the planner sends it to all if it is small
    whole = written(mixed.groupBy(F.col("source").alias(of)).agg(F.floor(F.sum("taken") / F.sum("size")).cast("int").alias(passes)), "mix-passes")
    each = mixed.join(whole, F.col("source").eqNullSafe(F.col(of)))
    more = F.when(F.round(F.col("taken") / F.col("size")) > F.col(passes), unit_hash("id", "size"))
    cuts = written(each.groupBy(of, passes).agg(F.coalesce(F.max(more), F.lit(-1.0)).alias(cut)), "mix-cuts")
    rows = df.withColumn(size, words_of(text_col))
    rows = rows.join(cuts, rows[source_col].eqNullSafe(cuts[of])).where(F.col(size) > 0)
    rows = rows.withColumn(spot, unit_hash(id_col, size))
    times = F.col(passes) + (F.col(spot) <= F.col(cut)).cast("int")
    return rows.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[f"`{c}`" for c in df.columns])
