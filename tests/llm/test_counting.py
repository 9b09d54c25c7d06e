"""Minimum bin slack, collocations and source divergence against plain Python, on small tables with hard rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import divergence, phrases, registry, slack
from lumenframe.llm.packing import Encoder
from tests.llm.test_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    return df.withColumns({"id": F.lit("mine"), "term": F.lit(1), "n": F.lit(2), "chunk": F.lit(0), "ids": F.lit(1.5), "part": F.lit("s"), "rank": F.lit(7)})


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


# ---------------------------------------------------------------- packing by minimum bin slack


def best_sum(counts, room):
    sums = {0}
    for length in Counter(counts).elements():
        sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


def test_fullest_combination_equals_all_subsets():
    r = random.Random(3)
    for _ in range(200):
        counts = Counter(r.randrange(1, 40) for _ in range(r.randrange(0, 14)))
        room = r.randrange(0, 80)
        found = slack.fullest(counts, room)
        assert all(counts[k] >= n for k, n in found.items()) and sum(k * n for k, n in found.items()) == best_sum(counts, room)


def one_by_one(counts, size):
    """Bins made one after the other: the longest piece opens one, the fullest combination of the others goes in."""
    left, bins = Counter(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        left += Counter()
        more = slack.fullest(left, size - longest)
        bins.append(sorted([longest, *Counter(more).elements()]))
        left -= Counter(more)
    return sorted(bins)


def test_patterns_are_bins_one_by_one_and_few():
    r = random.Random(4)
    for _ in range(20):
        counts = Counter(r.randrange(1, 65) for _ in range(r.randrange(1, 300)))
        found = slack.patterns(counts, 64)
        assert sorted(sorted(Counter(b).elements()) for b, times in found for _ in range(times)) == one_by_one(counts, 64)
    many = {length: 10**9 + length for length in range(1, 65)}
    found = slack.patterns(many, 64)
    assert len(found) <= sum(64 // x for x in range(1, 65)) and sum(times for _, times in found) <= 1.0001 * sum(k * n for k, n in many.items()) / 64


def test_cuts_lie_end_to_end():
    for n in (1, 7, 8, 9, 16, 17, 100):
        found = slack.cuts(n, 8)
        assert [s for s, _ in found] == [sum(k for _, k in found[:i]) for i in range(len(found))] and sum(k for _, k in found) == n
        assert all(k == 8 for _, k in found[1:]) and 1 <= found[0][1] <= 8


def test_slack_packing_places_every_id_once(spark, docs, rows):
    files = registry.tokenizer_files()
    got = slack.pack(docs, files, size=64).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins, by_doc, lengths = {}, {}, Counter()
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
        by_doc.setdefault(x.id, []).append(x)
    assert sorted(bins) == list(range(len(bins)))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    import zlib

    import numpy as np

    want = Counter()
    for doc in rows:
        ids = np.array(tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (start, n) in enumerate(slack.cuts(len(ids), 64)):
            want[doc.doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            lengths[n] += 1
    assert Counter((x.id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    assert len(bins) == len(one_by_one(lengths, 64)) and len(bins) <= 1.01 * sum(k * n for k, n in lengths.items()) / 64 + 1
    assert slack.pack(docs.limit(0), files).count() == 0


def test_both_tokenizer_libraries_give_the_same_ids(spark):
    path, ranks, pattern = registry.tokenizer_files()
    fast, plain = Encoder(path, ranks, pattern), Encoder(path)
    assert fast.fast is not None and plain.fast is None
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert fast(row.text).tolist() == plain(row.text).tolist()


# ---------------------------------------------------------------- collocations


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, least, covered, top, longest=4):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = Counter()
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    held[lang, words[i:j]] = max(held[lang, words[i:j]], a)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * held[lang, words] >= covered * a:
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def phrase_rows(spark):
    r = random.Random(9)
    rows = corpus()
    words = ["New", "york", "of", "the", "é", "naïve", "x" * 200, "a-b", " ", "don't"]
    for i in range(150):
        lang = r.choice(["en", "en", "de", None, "und"])
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randrange(0, 60)))
        rows.append((500 + i, text + " of the new york", lang, "s9"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"id": F.lit(1), "n": F.lit("x"), "word": F.lit(2), "score": F.lit(0)})


@pytest.mark.parametrize("blocks", [(phrases.WORDS, phrases.KEYS), (7, 5)])
def test_collocations_equal_plain_counts(spark, blocks):
    df = phrase_rows(spark)
    got = phrases.collocations(df, min_count=12, top=40, word_block=blocks[0], key_block=blocks[1])
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert {tuple(x) for x in got.collect()} == plain_collocations(df.collect(), 12, 80, 40)


def test_collocations_of_nothing(spark):
    df = phrase_rows(spark)
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df, min_count=10**6).count() == 0
    assert phrases.words_of(b"A. b\tC,,\r\nd") == [b"a", b".", b"b", b"c", b".", b".", b".", b".", b"d"]


# ---------------------------------------------------------------- divergence


def plain_audit(rows, least, top):
    n, docs, groups = {}, {}, {}
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r.text))
        groups.setdefault(lang, set()).add(source)
        n.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, d in docs[lang].items() if d >= least), key=str.encode)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        gap = lambda p, q: int(Fraction((p - q) ** 2, p + q))
        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("sizes", [(divergence.CHUNK, divergence.BLOCK), (5, 2), (64, 1)])
def test_divergence_equals_plain_sums(docs, rows, sizes):
    got = divergence.audit(docs, min_docs=4, top=6, chunk=sizes[0], block=sizes[1])
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert {tuple(x) for x in got.collect()} == plain_audit(rows, 4, 6)


def test_divergence_of_languages_without_kept_terms(spark, docs, rows):
    got = {tuple(x) for x in divergence.audit(docs, min_docs=10**6).collect()}
    assert got == plain_audit(rows, 10**6, 10) and got and {x[4] for x in got} == {0}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_terms_and_exact_shares(monkeypatch):
    text = "Ab1cÄ-é中 X\x7fy_Z[q".encode()
    assert [t.decode() for t in divergence.terms(text)] == ["ab", "cÄ", "é中", "x", "y", "z", "q"]
    monkeypatch.setattr(divergence, "STRETCH", 3)
    assert [t.decode() for t in divergence.terms(text)] == ["ab", "cÄ", "é中", "x", "y", "z", "q"]
    r = random.Random(2)
    for _ in range(300):
        total, kept = r.randrange(1, 10**14), r.randrange(1, 10**9)
        count = r.randrange(0, total + 1)
        assert divergence.share(count, total, kept) == 1 + 10**9 * (count + 2) // (total + 2 * kept)
