"""Main text of HTML pages: a host's suffix array finds what its pages repeat, and unique runs are the text.

A page is cut into blocks of text; structure marks them. Blocks of page furniture (menus, forms, adverts,
comments and the like, told by elements, roles and class names) go; the others belong to regions: what the main element
and articles hold, nested or side by side, in page order, and the rest. The token streams of the regions of a host's pages are laid end to end, and
their suffixes sorted, in buckets of equal first tokens: common prefixes of neighbours form intervals, and an
interval of DEPTH tokens or more whose occurrences lie in distinct streams is a repeat. Only suffixes at
anchors are sorted (positions that every string of DEPTH tokens holds one of, chosen by content), and intervals
are told apart by the tokens before the anchor, so all repeats are found. Streams with under OWN of their tokens
outside repeats are near copies of others and make nothing boilerplate. What over a share of a host's remaining
streams of the same kind hold is boilerplate: SHARE of those of the rest of pages (and two at least), MOST of those of
marked regions (and three at least), where text is meant to be. Its tokens are covered, the region with most
uncovered tokens holds the text, and covered boilerplate goes from it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.repeats import anchor_ids, lcp_intervals, met_anchors, minimizers, sent_anchors
from lumenframe.llm.shared import bounded, discard, fresh, sweep, tidy, written
from lumenframe.llm.shingles import mix, word_hashes

#: Tokens of the shortest repeat, and of an anchor.
DEPTH, ANCHOR = 8, 4
REACH = DEPTH - ANCHOR
#: Streams with a smaller share of tokens outside repeats are near copies.
OWN = 0.25
#: Repeats are boilerplate if a larger share of a host's streams holds them, and so many at least: outside marked regions, and in them.
SHARE, FEW = 0.1, 2
MOST, MANY = 0.5, 3
#: Uncovered tokens of a marked region count as often as this beside those of the rest of the page.
MARKED = 2
#: Contexts of anchors that a task sorts together, about; bytes of HTML for each bucket of anchors.
PER_BUCKET = 20_000
PER_SHARE = 8_000_000
#: Bytes of anchors, or of places found, that may be sent to all executors; beyond, they are joined by key.
MAX_SENT = 32_000_000
#: Pages that are searched together.
GROUP = 512

#: Elements whose content is no text of the page.
UNSEEN = {"script", "style", "template", "title", "textarea", "iframe", "svg", "math", "object", "noscript", "head", "canvas", "audio", "video"}
#: Elements of page furniture.
FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "fieldset", "datalist"}
#: Roles of page furniture.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: Words in class names and ids of page furniture.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search pagination pager widget copyright disclaimer skip".split()
)
#: Words that say nothing beside those.
PLAIN = set(
    "site page main global primary secondary top bottom left right upper lower inner outer header body box container wrapper wrap list section area "
    "block item items slot unit group bar panel row col column buttons button icons icon links link form title text label post posts article articles "
    "stories user reader visitor mobile desktop sticky fixed js is has the of and by us this".split()
)
#: Elements that begin and end a block.
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

_FACTOR = np.uint64(0xD6E8FEB86659FD93)

#: kind (main: in the main element or an article; open: the rest), texts of its blocks, and of each whether its name is weak evidence of furniture.
Region = tuple[str, list[str], list[bool]]


def _furniture(name: str, attributes: dict[str, str], in_main: bool) -> bool | None:
    """True: page furniture; None: a name that holds such a word beside others, as in `share-price`."""
    if name in FURNITURE or (name == "header" and not in_main):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    weak = False
    for compound in (c for key in ("class", "id") for c in attributes.get(key, "").split()):
        words = {w.lower() for w in _NAME_PARTS.findall(compound)}
        if words & NAMES or ("header" in words and not in_main):
            if all(w in NAMES or w in PLAIN or w.isdigit() for w in words):
                return True
            weak = True
    return None if weak else False


def regions(page: str | None) -> list[Region]:
    """The page's regions with text: the rest, and what all articles and main elements hold, each in page order.

    Blocks of furniture are left out.
    """
    found: list[Region] = [("open", [], []), ("main", [], [])]
    stack: list[tuple[str, int, bool]] = []  # element, region of what it holds (-1: furniture), weak name
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            _, at, weak = stack[-1] if stack else ("", 0, False)
            if text and at >= 0:
                found[at][1].append(text)
                found[at][2].append(weak)

    at, page = 0, page or ""
    while (m := _TOKEN.match(page, at)) is not None:
        at = m.end()
        raw, name = m[0], m["name"]
        if name is None:
            if raw[0] != "<" or raw == "<":
                parts.append(raw)
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCKS:
                flush()
            if any(e == name for e, *_ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in BLOCKS:
            flush()
        if name in UNSEEN and name != "head" and not m["rest"].endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close or name in ("script", "style", "title", "textarea"):
                at = close.end() if close else len(page)
            continue
        if name in VOID or name == "head":
            continue
        if name == "p" or name in BLOCKS and name not in ("li", "dd", "dt", "td", "th", "tr", "option"):
            while stack and stack[-1][0] == "p":
                stack.pop()
        elif name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        _, region, weak = stack[-1] if stack else ("", 0, False)
        if region >= 0:
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m["rest"])} if m["rest"].strip(" /\n\t") else {}
            seen = _furniture(name, attributes, region == 1)
            if seen:
                region = -1
            elif name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody":
                region = 1
            weak = weak or seen is None
        if not m["rest"].endswith("/") or name in BLOCKS:
            stack.append((name, region, weak))
    flush()
    return [r for r in found if r[1]]


def main_text(found: list[Region], covered: list[np.ndarray | None]) -> str:
    """The text of a page from its regions, and of each the tokens that boilerplate covers (None: none).

    The region with the most uncovered tokens, those of articles and the main element counted MARKED times, is
    the text; the marked one in a tie. In it a block that is covered as a whole goes; of blocks of the rest
    and of those with a weak name all covered tokens go. A marked region that would be left empty stays as it is,
    since something else repeats it. Empty without regions.
    """
    best, most = None, -1
    for i, (kind, texts, _) in enumerate(found):
        n = sum(len(t.split()) for t in texts) - (int(covered[i].sum()) if covered[i] is not None else 0)
        score = (n * (1 if kind == "open" else MARKED), kind != "open")
        if best is None or score > most:
            best, most = i, score
    if best is None:
        return ""
    kind, texts, weak = found[best]
    if covered[best] is None or (kind != "open" and covered[best].all()):
        return "\n".join(texts)
    out, at = [], 0
    for text, name in zip(texts, weak):
        tokens = text.split()
        gone = covered[best][at : at + len(tokens)]
        at += len(tokens)
        if kind == "open" or name:
            text = " ".join(t for t, g in zip(tokens, gone) if not g)
        elif gone.all():
            text = ""
        if text:
            out.append(text)
    return "\n".join(out)


def _long(*parts: str) -> int:
    """A 64-bit number for the strings."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Streams:
    """The token hashes of some streams end to end; count and salt (by host) of each."""

    tokens: np.ndarray
    counts: np.ndarray
    salts: np.ndarray

    def __post_init__(self):
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.begins = (np.cumsum(self.counts) - self.counts)[self.owner]

    def whole(self) -> np.ndarray:
        """Of each DEPTH tokens: whether they lie in one stream."""
        return self.owner[: len(self.tokens) - DEPTH + 1] == self.owner[DEPTH - 1 :]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the anchors; every DEPTH tokens of a stream hold one."""
        tokens = self.tokens
        if len(tokens) < DEPTH:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = self.salts[self.owner[: len(tokens) - ANCHOR + 1]]
        for i in range(ANCHOR):
            h = mix(h * _FACTOR + tokens[i : i + len(h)])
        at = minimizers(h, REACH + 1, self.whole())
        return h[at], at

    def first(self, starts: np.ndarray) -> np.ndarray:
        """Of each of these places, ascending, DEPTH tokens before their stream's end: whether those tokens are at no earlier one of the same stream."""
        h = self.owner[starts].astype(np.uint64)
        for i in range(DEPTH):
            h = mix(h * _FACTOR + self.tokens[starts + i])
        out = np.zeros(len(starts), bool)
        out[np.unique(h, return_index=True)[1]] = True
        return out

    def contexts(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of anchors at these places: the place in their stream and its length; the tokens around and a hash of
        them; how many of those before and after are in the stream; and the offsets whose tokens are new, as bits."""
        spot, n = at - self.begins[at], self.counts[self.owner[at]]
        left, right = np.minimum(spot, REACH), np.minimum(n - ANCHOR - spot, REACH)
        pad = np.zeros(REACH, np.uint64)
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, self.tokens, pad]), DEPTH + REACH)[at]
        column = np.arange(DEPTH + REACH)
        rows = np.where((column >= REACH - left[:, None]) & (column < REACH + ANCHOR + right[:, None]), rows, np.uint64(0))
        c = left.astype(np.uint64) * np.uint64(64) + right.astype(np.uint64)
        for x in rows.T:
            c = mix(c * _FACTOR + x)
        # all places of the same tokens are around anchors, and these are all of an anchor or none
        inside = (spot[:, None] >= np.arange(REACH + 1)) & (right[:, None] >= REACH - np.arange(REACH + 1))
        starts, where = np.unique((at[:, None] - np.arange(REACH + 1))[inside], return_inverse=True)
        firsts = np.zeros(inside.shape, np.int64)
        firsts[inside] = self.first(starts)[where]
        firsts = firsts @ (1 << np.arange(REACH + 1))
        return {"at": spot, "n": n, "context": (rows >> np.uint64(32)).astype(np.uint32), "c": c.view(np.int64), "left": left, "right": right, "firsts": firsts}


def streams(texts: list[str], hosts: list[str]) -> Streams:
    hashes, counts = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    return Streams(hashes, counts, np.array([_long("host", h) for h in hosts], np.int64).view(np.uint64))


def streams_holding(anchor: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each distinct context of an anchor, and each o up to REACH: how many streams hold the DEPTH tokens that begin o before it.

    context: rows of REACH tokens before the anchor, the anchor, and REACH after it, of which left and right are
    in the stream; 0 where those tokens are not. held: for each o, how many streams hold them first in this context.
    """
    n = len(anchor)
    out = np.zeros((n, REACH + 1), np.int64)
    if not n:
        return out
    suffix = context[:, REACH:]
    order = np.lexsort([*(suffix[:, i] for i in range(DEPTH - 1, -1, -1)), anchor])
    anchor, context, suffix, left, right, held = (x[order] for x in (anchor, context, suffix, left, right, held))
    differs = suffix[1:] != suffix[:-1]
    common = np.where(differs.any(1), differs.argmax(1), DEPTH)
    common = np.where(anchor[1:] != anchor[:-1], 0, common)
    depth, up, first, last = lcp_intervals(common)
    found = np.zeros((n, REACH + 1), np.int64)
    before = np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        if o:
            before = mix(before * _FACTOR + context[:, REACH - o].astype(np.uint64))
        node = np.arange(n) + len(depth)  # suffixes outside every interval are nodes of their own
        for k in np.flatnonzero((depth >= DEPTH - o) & (up < DEPTH - o)):
            node[first[k] : last[k] + 1] = k
        rows = np.flatnonzero((left >= o) & (right >= REACH - o))
        if not len(rows):
            continue
        # left extensions of a node: its suffixes that agree in the o tokens before
        key = mix(node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + before[rows])
        _, group = np.unique(key, return_inverse=True)
        found[rows, o] = np.bincount(group, held[rows, o])[group]
    out[order] = found
    return out


def covered_tokens(n: int, at: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n tokens repeats cover, from the anchors' places and their repeated offsets as bits."""
    on = np.zeros(n + 1, np.int64)
    for o in range(REACH + 1):
        begins = at[masks >> o & 1 > 0] - o
        np.add.at(on, begins, 1)
        np.add.at(on, begins + DEPTH, -1)
    return np.cumsum(on)[:n] > 0


def _masks(occurrences: DataFrame, contexts: DataFrame, least: DataFrame | None) -> DataFrame:
    """(of_a, of_c, mask, most): the offsets of each context whose tokens are in enough streams, the host's least or 2, and the most streams of any offset."""
    columns = [f"s{o}" for o in range(REACH + 1)]
    sums = [F.sum(F.shiftright("firsts", o).bitwiseAND(F.lit(1))).alias(c) for o, c in enumerate(columns)]
    held = occurrences.groupBy(F.col("a").alias("of_a"), F.col("c").alias("of_c")).agg(*sums)
    # contexts that only streams have which do not count meet the sums of the others
    sized = contexts.join(held, (F.col("a") == F.col("of_a")) & (F.col("c") == F.col("of_c")), "left")
    if least is None:
        sized = sized.withColumn("least", F.lit(2).cast("long"))
    else:
        sized = sized.join(least, F.col("host") == F.col("of_host"), "left").withColumn("least", F.coalesce("least", F.lit(2).cast("long")))
    sized = sized.select("a", "c", "context", "left", "right", "least", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    buckets = max(1, contexts.count() // PER_BUCKET)

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        context = np.frombuffer(b"".join(part["context"]), np.uint32).reshape(len(part), -1)
        n = streams_holding(part["a"].to_numpy(), context, part["left"].to_numpy(), part["right"].to_numpy(), part[columns].to_numpy())
        return pd.DataFrame({"a": part["a"], "c": part["c"], "mask": (n >= part["least"].to_numpy()[:, None]) @ (1 << np.arange(REACH + 1)), "most": n.max(1, initial=0)})

    found = sized.groupBy(F.pmod("a", F.lit(buckets))).applyInPandas(sort, "a long, c long, mask int, most long").where("mask > 0")
    return written(found.withColumnsRenamed({"a": "of_a", "c": "of_c"}), "extract-masks")


def _parsed(batch: pd.DataFrame) -> Iterator[tuple[list[tuple[int, int, int, str, str]], Streams]]:
    """((page, nth, unit, host, text) of each region, their streams), a group of pages (html, host) at a time."""
    for i in range(0, len(batch), GROUP):
        some, units = batch.iloc[i : i + GROUP], []
        for text, host in zip(some["html"], some["host"]):
            own = regions(text)
            page = _page_number(host, own)
            for nth, (kind, t, _) in enumerate(own):
                group = f"{kind}:{host}"  # streams of one kind count among themselves
                units.append((page, nth, _long("unit", group, *t), group, " ".join(t)))
        yield units, streams([u[4] for u in units], [u[3] for u in units])


def _least(share: float, few: int) -> Column:
    """How many of n streams make a repeat boilerplate."""
    return F.greatest(F.lit(few), F.floor(F.col("n") * share) + 1)


def _page_number(host: str, own: list[Region]) -> int:
    """A 64-bit number that pages of a host share if they have the same regions."""
    return _long("page", host, *[x for k, t, _ in own for x in (k, *t)])


def extract(df: DataFrame, *, html_col: str = "html", url_col: str = "url", text_name: str = "text") -> DataFrame:
    """df without its HTML, with a column of the main text: blocks in page order, joined by newlines; empty where there is none.

    Null pages are empty. Regions of one host with equal texts count as one, and near copies (under OWN of their
    tokens outside repeats) do not count, so that copies do not make each other boilerplate; a null url, or one
    without a host, is a host of its own. Tokens are told apart by hashes, A-Z like a-z. df has to give its rows
    again unchanged, as a table does: pages are parsed in each of three passes, which costs less than to keep them.
    """
    spark = df.sparkSession
    bounded(spark)
    found, host, page, kept = fresh(df, "extract_regions", "extract_host", "extract_page", "extract_places")
    own_host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    size = df.agg(F.sum(F.octet_length(html_col))).collect()[0][0] or 0
    shares = max(1, int(size) // PER_SHARE)
    raw = df.select(F.col(html_col).alias("html"), own_host.alias("host"))

    @tidy
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for units, made in _parsed(batch):
                h, at = made.anchors()
                yield from sent_anchors(anchor_ids(h, shares), np.array([u[2] for u in units], np.int64)[made.owner[at]])

    met = raw.mapInPandas(scan, "bucket long, known boolean, packed binary").groupBy("bucket").applyInPandas(met_anchors, "key long, anchor long")
    shared = written(met.select("anchor").distinct(), "extract-anchors")
    # so many bytes are sent to all executors; beyond, occurrences are joined with the anchors by key
    sent = np.sort(shared.toPandas()["anchor"].to_numpy()) if 8 * shared.count() <= MAX_SENT else None
    sent = spark.sparkContext.broadcast(sent)
    sweep(spark)

    @tidy
    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for units, made in _parsed(batch):
                h, at = made.anchors()
                a = anchor_ids(h, shares)
                if sent.value is not None:
                    on = np.isin(a, sent.value)
                    a, at = a[on], at[on]
                names = {k: np.array([u[i] for u in units], object if k == "host" else np.int64) for i, k in enumerate(("page", "nth", "unit", "host"))}
                blank = dict.fromkeys(("c", "at", "n", "firsts", "left", "right"), 0)
                yield pd.DataFrame({**names, "a": -1, **blank, "context": None})  # a row for each region
                if len(at):
                    x, owner = made.contexts(at), made.owner[at]
                    # a context that this group holds several times is sent once
                    _, once = np.unique(mix(a.view(np.uint64) * _FACTOR + x["c"].view(np.uint64)), return_index=True)
                    context = np.full(len(at), None, object)
                    context[once] = [r.tobytes() for r in x["context"][once]]
                    yield pd.DataFrame({**{k: v[owner] for k, v in names.items()}, "a": a, **{k: x[k] for k in blank}, "context": context})

    each = raw.mapInPandas(occur, "page long, nth int, unit long, host string, a long, c long, at int, n int, firsts int, left int, right int, context binary")
    if sent.value is None:
        each = each.where("a < 0").unionByName(each.join(shared.withColumnRenamed("anchor", "of"), F.col("a") == F.col("of"), "left_semi"))
    each = written(each, "extract-occurrences")
    units = written(each.where("a < 0").select("page", "nth", "unit", "host").distinct(), "extract-units")
    contexts = written(each.where("context is not null").select("host", "a", "c", "left", "right", "context").dropDuplicates(["a", "c"]), "extract-contexts", spread=True)
    occurrences = written(each.where("a >= 0").select("unit", "a", "c", "at", "n", "firsts").distinct(), "extract-distinct", spread=True)  # pages may hold the same unit
    discard(each, shared)

    @F.pandas_udf("double")
    def own_share(n: pd.Series, x: pd.Series) -> pd.Series:
        share = lambda k, v: 1 - covered_tokens(k, *(np.array([s[f] for s in v], np.int64) for f in ("at", "mask"))).mean()
        return pd.Series([share(k, v) for k, v in zip(n, x)], dtype="float64")

    of = (F.col("a") == F.col("of_a")) & (F.col("c") == F.col("of_c"))
    sent_if_small = lambda masks: F.broadcast(masks) if 32 * masks.count() <= MAX_SENT else masks
    marked = lambda masks: occurrences.join(sent_if_small(masks), of).groupBy("unit", "n").agg(F.collect_list(F.struct("at", "mask")).alias("x"))
    first = _masks(occurrences, contexts, None)
    near = written(marked(first).where(own_share("n", "x") < OWN).select(F.col("unit").alias("near")), "extract-near")
    own = lambda rows: rows.join(near, F.col("unit") == F.col("near"), "left_anti")
    n_regions = own(units.select("host", "unit").distinct()).groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("n"))
    least = written(n_regions.select("of_host", F.when(F.col("of_host").startswith("main:"), _least(MOST, MANY)).otherwise(_least(SHARE, FEW)).cast("long").alias("least")), "extract-hosts")
    # only what enough streams hold, near copies counted, can be in enough of the others: whole groups stay or go
    some = contexts.join(sent_if_small(first), of).join(least, F.col("host") == F.col("of_host"), "left").where("most >= coalesce(least, 2)")
    some = written(some.select(*contexts.columns), "extract-some")
    pairs = some.select(F.col("a").alias("of_a"), F.col("c").alias("of_c"))
    every, occurrences = occurrences, written(occurrences.join(sent_if_small(pairs), of, "left_semi"), "extract-some-of")
    second = _masks(own(occurrences), some, least)
    places = written(marked(second).withColumnsRenamed({"unit": "of_unit"}).drop("n"), "extract-marks")
    discard(contexts, first, near, least, some, every, occurrences, second)
    of_page = units.join(places, F.col("unit") == F.col("of_unit")).groupBy(F.col("page").alias("of_page")).agg(F.collect_list(F.struct("nth", "x")).alias(kept))
    of_page = written(of_page, "extract-places")
    n_places = of_page.agg(F.sum(F.aggregate(kept, F.lit(0).cast("long"), lambda n, r: n + F.size(r["x"])))).collect()[0][0] or 0
    discard(units, places)

    @F.pandas_udf("page long, regions array<struct<kind: string, texts: array<string>, weak: array<boolean>>>")
    @tidy
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, hosts in batches:
            made = [regions(p) for p in pages]
            yield pd.DataFrame({"page": [_page_number(h, r) for h, r in zip(hosts, made)], "regions": [[{"kind": k, "texts": t, "weak": w} for k, t, w in r] for r in made]})

    @F.pandas_udf("string")
    @tidy
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for all_regions, all_places in batches:
            out = []
            for own, seen in zip(all_regions, all_places):
                own = [] if own is None else [(r["kind"], list(r["texts"]), list(r["weak"])) for r in own]
                covered: list[np.ndarray | None] = [None] * len(own)
                for r in [] if seen is None else seen:
                    at, mask = (np.array([x[k] for x in r["x"]], np.int64) for k in ("at", "mask"))
                    covered[r["nth"]] = covered_tokens(sum(len(t.split()) for t in own[r["nth"]][1]), at, mask)
                out.append(main_text(own, covered))
            yield pd.Series(out, dtype=object)

    columns = [F.col(f"`{c}`") for c in df.columns if c != html_col]
    rows = df.withColumn(host, own_host).withColumn(found, parse(F.col(html_col), F.col(host)))
    rows = rows.select(*columns, F.col(f"{found}.page").alias(page), F.col(f"{found}.regions").alias(found))
    if 16 * n_places <= MAX_SENT:
        of_page = F.broadcast(of_page)
    joined = rows.join(of_page, F.col(page) == F.col("of_page"), "left")
    return joined.select(*columns, text(F.col(found), F.col(kept)).alias(text_name))
