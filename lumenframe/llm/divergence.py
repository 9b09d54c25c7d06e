"""How far the sources of a language differ in their use of words, over integer-coded vocabularies.

Terms are counted by language and source; those in enough documents of a language are kept. They are laid out in
order and cut into chunks, each with its sorted array of terms: a term's id is its place there, found by binary
search, and a source's counts become one dense vector of a chunk by a bincount over ids. Ids follow the order of
UTF-8 bytes, so ties are broken by them. Chunks and blocks of sources bound what a task holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import bounded, discard, tidy, written

MIN_DOCS = 10
TOP = 10
#: Terms of a chunk, and sources of a block: a task holds two blocks' vectors of a chunk.
CHUNK = 16_384
BLOCK = 64
#: Entries that a counting task holds before it sends them on.
HELD = 600_000
#: Bytes of a text that are split into terms at a time.
STRETCH = 1 << 20
ONE = 1_000_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def stretches(text: bytes) -> Iterator[bytes]:
    """The text in parts of about STRETCH bytes, cut where no term is."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def terms(text: bytes) -> Iterator[bytes]:
    """Runs of letters A to Z and of all that is no ASCII; only A to Z are lower-cased."""
    for part in stretches(text):
        yield from _TERM.findall(part.lower())


def share(count, total, kept):
    """1 + floor(ONE * (count + 2) / (total + 2 * kept)), exactly: three decimals at a time, in 64 bits."""
    of = total + 2 * kept
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return 1 + whole


def gap(p, q):
    return (p - q) ** 2 // (p + q)


def counted(df: DataFrame, *, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): parts of each group's occurrences and documents of a term."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = defaultdict(Counter), defaultdict(Counter)

        def send():
            for (lang, source), found in n.items():
                of = docs[lang, source]
                for at in range(0, len(found), 50_000):
                    some = list(found.items())[at : at + 50_000]
                    words = [x for x, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([k for _, k in some]), pa.array([of[x] for x in words])], ["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                group, of, once = n[lang, source], docs[lang, source], set()
                held -= len(group)
                for part in stretches(text):
                    found = _TERM.findall(part.lower())
                    group.update(found)
                    once.update(found)
                of.update(once)
                held += len(group)
                if held > HELD:
                    yield from send()
                    held = 0
        yield from send()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def chunked(kept: DataFrame, chunk: int) -> DataFrame:
    """kept with the column chunk: runs of about `chunk` terms of a language in their order."""
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, run, part = (None, None), -1, TaskContext.get().partitionId()
        for batch in batches:
            lang, term = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "term"))
            out = []
            for key in zip(lang, term):
                if key != last:
                    run = run + 1 if key[0] == last[0] else -(-(run + 1) // chunk) * chunk  # a language begins a chunk
                    last = key
                out.append((part << 32) + run // chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "chunk"])

    return ordered.mapInArrow(number, ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", chunk long")


def audit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others, and its terms against its language.

    Part `pair` has a row for each other source of the language, part `term` one for each of the `top` kept terms
    that the source uses more than the language does. Null texts, languages and sources are empty ones; a group
    whose texts hold no kept term has one by its pairs alone; where a language keeps no term, all values are 0. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    bounded(spark)
    parts = counted(df, text_col=text_col, lang_col=lang_col, source_col=source_col)
    counts = written(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term)}).where(F.col("in_docs") >= min_docs)
    kept = written(chunked(kept.select("lang", "source", "term", "n", "all_n"), chunk), "audit-kept")
    discard(counts)

    groups = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    by_lang = Window.partitionBy("lang")  # a row for each source of a language, of whose square the result is made
    groups = groups.withColumns({"number": F.row_number().over(by_lang.orderBy("source")) - 1, "of_total": F.sum("total").over(by_lang), "sources": F.count("*").over(by_lang)})
    groups = written(groups, "audit-groups")
    by_chunk = written(kept.groupBy("lang", "chunk").agg(F.countDistinct("term").alias("terms")), "audit-chunks")
    chunks = by_chunk.withColumn("kept", F.sum("terms").over(Window.partitionBy("lang")))  # a row for each chunk

    # every chunk meets each two blocks of sources once; sources without its terms still have a share of them
    blocks = F.expr(f"(sources + {block - 1}) div {block}")
    mine = F.expr(f"number div {block}")
    two = F.explode(F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda x: F.struct(F.least(x, mine.cast("int")).alias("a"), F.greatest(x, mine.cast("int")).alias("b"))))
    heads = groups.join(chunks, "lang").withColumn("two", two).select("lang", "chunk", "two.a", "two.b", "source", "number", "total", "of_total", "kept", "terms")
    heads = heads.toDF(*heads.columns)  # columns of its own: both sides come from the same tables
    rows = kept.join(groups.select("lang", "source", "number", "sources"), ["lang", "source"]).withColumn("two", two)
    rows = rows.select("lang", "chunk", "two.a", "two.b", "term", "number", "n", "all_n")
    keys = ["lang", "chunk", "a", "b"]

    def compare(key, rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        lang, _, a, b = key
        heads = heads.sort_values("number", ignore_index=True)
        kept, of_total = int(heads["kept"].iat[0]), int(heads["of_total"].iat[0])
        words = rows["term"].map(str.encode).to_numpy()
        dictionary = np.array(sorted(set(words)), object)
        ids = np.searchsorted(dictionary, words)
        place = np.searchsorted(heads["number"].to_numpy(), rows["number"].to_numpy())
        wide = len(dictionary)
        n = np.bincount(place * wide + ids, rows["n"].to_numpy(), len(heads) * wide) if rows["n"].sum() < 1 << 53 else None
        if n is None:  # beyond what doubles hold exactly
            n = np.zeros(len(heads) * wide, np.int64)
            np.add.at(n, place * wide + ids, rows["n"].to_numpy())
        n = n.astype(np.int64).reshape(len(heads), wide)
        p = np.stack([share(row, int(t), kept) for row, t in zip(n, heads["total"])])
        bare = np.array([share(0, int(t), kept) for t in heads["total"]])  # of terms that none of these sources has
        unused = int(heads["terms"].iat[0]) - wide
        first = heads["number"].to_numpy() // block == a
        out = []
        for i in np.flatnonzero(first):
            others = np.flatnonzero(~first) if a != b else np.arange(i + 1, len(heads))
            for j in others:
                v = int(gap(p[i], p[j]).sum()) + unused * int(gap(bare[i], bare[j]))
                out += [(heads["source"][i], "pair", heads["source"][j], v), (heads["source"][j], "pair", heads["source"][i], v)]
        if a == b:
            all_n = np.zeros(wide, np.int64)
            all_n[ids] = rows["all_n"].to_numpy()
            q = share(all_n, of_total, kept)
            for i in range(len(heads)):
                more = np.flatnonzero((n[i] > 0) & (p[i] > q))
                f = gap(p[i][more], q[more])
                best = np.lexsort((more, -f))[:top]
                out += [(heads["source"][i], "term", dictionary[more[k]].decode(), int(f[k])) for k in best]
        found = pd.DataFrame(out, columns=["source", "part", "item", "value"])
        return found.assign(lang=lang)[["lang", "source", "part", "item", "value"]]

    found = written(rows.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(compare, "lang string, source string, part string, item string, value long"), "audit-found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # where a language keeps no term, its pairs are there all the same
    bare = groups.join(chunks.select("lang").distinct(), "lang", "left_anti").select("lang", "source")
    pairs = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(pairs).withColumn("part", F.lit("pair"))
    every = pairs.unionByName(found.where("part = 'term'"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
