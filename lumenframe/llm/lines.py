"""Line dedup by site-relative frequency: lines that a large share of a host's pages contain are boilerplate.

Every host's pages are counted, and for every line the pages of that host that contain it; a line on more than
`ratio` of them (and on `min_pages` at least) is dropped from all pages of that host. Pages with equal texts count
as one, and pages that share nearly all of their text with others do not count, so that copies do not make each
other boilerplate. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import fresh, written

#: Under the rate of lines that really repeat (1 to 5 % of a site's pages).
RATIO = 0.02
MIN_PAGES = 2
#: Pages of whose characters a smaller share is on no often repeated line are near copies (as similar as op 7 asks).
OWN = 0.25


def host_of(site: str | Column) -> Column:
    """The host of a URL, in lower case; any other value names a site by itself."""
    site = F.col(site) if isinstance(site, str) else site
    host = F.regexp_extract(site, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host)).otherwise(site)


def _pair(line: str | Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lists(each: DataFrame, pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines) from a row for each line of each page (host, pair) and a row for each page (host)."""
    on = each.groupBy("host", "pair.a", "pair.b").agg(F.count("*").alias("on"))
    pages = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    often = on.where(F.col("on") >= min_pages).join(pages, F.col("host").eqNullSafe(F.col("of"))).where(F.col("on") > F.lit(float(ratio)) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def boilerplate(df: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = False) -> DataFrame:
    """Columns (host, lines): for each host with any, the pairs of hashes of its boilerplate lines.

    host_col holds URLs, whose hosts group the pages, or names of sites.
    A list has at most (mean lines of the host's pages) / ratio entries, since each entry is on more than
    ratio of the pages. A null host is a host of its own; empty lines never count. With copies, every row is a
    page. Otherwise every text that the host has is one (null texts are one), and what is found so is counted
    again on the pages that are no near copies: those with OWN of their text, by characters, on other lines.
    """
    texts = F.filter(F.array_distinct(F.split(text_col, "\n", -1)), lambda x: x != "")
    keyed = df.select(host_of(host_col).alias("host"), F.xxhash64(text_col).alias("page"), texts.alias("lines"))
    each = keyed.select("host", "page", F.explode("lines").alias("line")).select("host", "page", _pair("line").alias("pair"))
    if copies:
        return _lists(each, keyed, ratio, min_pages)
    found = written(_lists(each.distinct(), keyed.select("host", "page").distinct(), ratio, min_pages), "line-candidates").toDF("of", "often")
    joined = keyed.join(found, F.col("host").eqNullSafe(F.col("of")), "left")
    shared = F.when(F.col("often").isNull(), F.array().cast("array<string>")).otherwise(F.filter("lines", lambda x: F.array_contains("often", _pair(x))))
    length = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    sized = joined.select("host", "page", F.transform(shared, _pair).alias("pairs"), length(shared).alias("n"), length(F.col("lines")).alias("of_n"))
    own = written(sized.where(F.col("of_n").isNull() | (F.col("of_n") - F.col("n") >= OWN * F.col("of_n"))).drop("n", "of_n").dropDuplicates(["host", "page"]), "line-pages")
    return _lists(own.select("host", F.explode("pairs").alias("pair")), own, ratio, min_pages)


def drop_boilerplate(df: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = False, count_col: str | None = None) -> DataFrame:
    """df with the text of every row freed from its host's boilerplate lines; all rows stay.

    The other lines keep their order and repeats. A text of boilerplate only becomes empty; null and empty
    texts stay as they are; count_col, if named, gets the number of lines dropped (null texts: 0).
    """
    host, flags = fresh(df, "host_of_lines", "boilerplate_lines")
    # written first: the planner then knows its size and broadcasts it only if it is small
    found = written(boilerplate(df, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages, copies=copies), "line-dedup").toDF(host, flags)
    joined = df.join(found, host_of(df[host_col]).eqNullSafe(found[host]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(flags, _pair(x)))
    text = F.when(F.col(flags).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if count_col:
        columns.append(F.when(F.col(flags).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(count_col))
    return joined.select(*columns)
