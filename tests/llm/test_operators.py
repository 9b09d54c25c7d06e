"""Corpus operators on small tables with nulls, empty and very long texts, ties, repeated rows, and clashing names."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import extract, hamming, language, lines, mixing, near, ogg, packing, registry, repeats, toxicity
from lumenframe.llm.shared import unit_hash, written

R = random.Random(0)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 8))) for _ in range(400)]


def prose(n: int, r=R) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus() -> list[tuple]:
    r = random.Random(1)
    base = prose(120, r)
    edited = base.split()
    edited[60] = "changed"
    far = base.split()
    for i in range(0, 120, 12):
        far[i] = "other"
    shared = prose(20, r)
    rows = [(i, prose(r.randrange(20, 90), r), "en", f"s{i % 3}") for i in range(20)]
    rows += [(20, base, "en", "s0"), (21, " ".join(edited), "en", "s1"), (22, base.upper(), None, "s0"), (23, " ".join(far), "en", "s2"), (24, base, "en", "s0"), (24, base, "en", "s0")]
    rows += [(25, None, "en", "s0"), (26, "", None, None), (27, " \n\t ", "en", None), (28, "one two", "de", "s1"), (29, "one two", "de", "s1"), (30, prose(30_000, r), "en", "s2")]
    rows += [(31, prose(10, r) + " " + shared, "en", "s1"), (32, shared + " " + prose(10, r), "en", "s1"), (33, "x" * 300, "en", "s2"), (34, "x" * 120, "en", "s2"), (None, prose(15, r), "en", "s0")]
    rows += [(40 + i, f"menu home\n{prose(12, r)}\nmenu home\n\nfooter {i % 2}", "de", "site") for i in range(12)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    return df.withColumns({"id": F.lit("mine"), "node": F.lit(1), "n": F.lit(2), "host": F.lit("h"), "lines": F.lit(0), "taken": F.lit(1.5), "score": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 2, "MAX_SENT": -1, "STAR": 1}, {"BLOCK_BYTES": 400, "STAR": 2}])
def test_near_groups_equal_brute_force(docs, none, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near, name, value)
    rows = corpus()
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d if d is not None else 1 << 60)
    want = Counter((d, len(sets[i]), least[find(i)] if d is not None else None, d is None or least[find(i)] == d) for i, (d, *_) in enumerate(rows))
    got = Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(docs).collect())
    assert got == want
    assert near.near_groups(none).count() == 0
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert 20 in ids and not {21, 22, 24} & set(ids) and {25, 26, 27, 28, 30} <= set(ids) and len(ids) == len(set(ids))
    assert near.keep_one(none).count() == 0


def test_rows_with_a_partner():
    r = np.random.default_rng(4)
    registers = r.integers(0, 60, (400, 144)).astype(np.uint16)
    for i in range(0, 300, 3):  # pairs and triples that share most registers
        registers[i + 1] = np.where(r.random(144) < 0.8, registers[i], registers[i + 1])
        registers[i + 2] = np.where(r.random(144) < 0.57, registers[i], registers[i + 2])
    n, label = r.integers(80, 120, 400), r.integers(0, 300, 400)
    for block in (np.zeros(400, int), np.arange(400) % 2):
        may = lambda i, j: label[i] != label[j] and (not block.any() or block[i] != block[j]) and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and (registers[i] == registers[j]).sum() >= near.ESTIMATE * 144
        want = [any(may(i, j) for j in range(400)) for i in range(400)]
        assert near.with_partner(registers, n, label, block).tolist() == want


def test_groups_that_only_meet_across_stars(spark, monkeypatch):
    """Chains of edits: buckets hold members of several groups, in blocks of two."""
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "BLOCK_BYTES", 3_000)
    r, rows = random.Random(23), []
    for c in range(6):
        words = prose(100, r).split()
        for step in range(14):
            words = list(words)
            for at in r.sample(range(100), 2):
                words[at] = f"new{c}x{step}y{at}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {x.id: x.component_id for x in near.near_groups(df).collect()} == {i: find(i) for i in range(len(rows))}


def test_connecting_links_across_blocks():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[r.random(len(base)) > e], r.integers(0, 1 << 62, int(e * 200)).astype(np.uint64)])) for e in r.uniform(0, 0.3, 40)]
    label, block = np.arange(40), np.arange(40) % 2
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    for blocks, singly in ((np.zeros(40, int), 0), (block, 0), (np.zeros(40, int), 5), (block, 64)):
        a, b = near.connecting_links(sets, label, blocks, columns=64, singly=singly)
        assert all(linked(i, j) for i, j in zip(a, b))
        root = list(range(40))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in zip(a, b):
            assert find(i) != find(j)
            root[find(i)] = find(j)
        for i in range(40):
            for j in range(i):
                if (len(set(blocks)) == 1 or blocks[i] != blocks[j]) and linked(i, j):
                    assert find(i) == find(j)


@pytest.mark.parametrize("most", [repeats.MAX_SENT, -1])
def test_repeats_equal_brute_force(docs, none, monkeypatch, most):
    monkeypatch.setattr(repeats, "MAX_SENT", most)
    seen: dict[bytes, int] = {}
    rows = corpus()
    raw = lambda t: (t or "").encode()
    key = lambda d: (1 << 63) - 1 if d is None else d
    for d, t, *_ in rows:
        b = raw(t)
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(seen.get(b[i : i + 50], 1 << 63), key(d))
    want = Counter()
    for d, t, *_ in rows:
        b = raw(t)
        on = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < key(d):
                on[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, o in zip(b, on) if not o)
        runs = sum(1 for i in range(len(on)) if on[i] and (i == 0 or not on[i - 1]))
        want[d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept] += 1
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.drop_repeats(docs, keep_text=True).collect())
    assert got == want
    assert repeats.drop_repeats(none).count() == 0


def test_lines_equal_brute_force(docs, none):
    got = {(r.doc_id, r.source): (r.text, r.dropped) for r in lines.drop_boilerplate(docs, ratio=0.3, min_pages=3, count_col="dropped").collect()}
    rows = corpus()
    pages, on = Counter(s for *_, s in rows), Counter()
    for _, t, _, s in rows:
        on.update((s, x) for x in set((t or "").split("\n")) if x and t is not None)
    for d, t, _, s in rows:
        bad = [x for x in t.split("\n") if x and on[s, x] >= 3 and on[s, x] > 0.3 * pages[s]] if t is not None else []
        want = None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)
        assert got[d, s] == (want, len(bad))
    assert got[40, "site"][0].startswith(prose(0)) and "menu" not in got[40, "site"][0] and "footer" not in got[40, "site"][0]
    assert lines.drop_boilerplate(docs).columns == docs.columns and lines.drop_boilerplate(none).count() == 0


def test_lines_are_judged_by_host(spark):
    r = random.Random(12)
    rows = [(i, f"menu of a\n{prose(30, r)}", f"HTTP://user@A.example:80/{i}") for i in range(6)] + [(10 + i, f"menu of a\n{prose(30, r)}" if not i else prose(30, r), f"https://b.example/{i}") for i in range(6)]
    got = {x.doc_id: x.text for x in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == t.removeprefix("menu of a\n") for i, t, _ in rows if i < 10) and all(got[i] == t for i, t, _ in rows if i >= 10)


def test_copies_of_a_document_do_not_make_its_lines_boilerplate(spark):
    r = random.Random(11)
    copied = f"{prose(30, r)}\n{prose(30, r)}"
    rows = [(i, f"menu home\n{copied}", "s") for i in range(10)] + [(10 + i, f"menu home\n{prose(40, r)}", "s") for i in range(20)]
    df = spark.createDataFrame([(*x, "en", len(x[1])) for x in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    found = corpus_pipeline.drop_lines(spark, df, "")
    got = {x.doc_id: x.text for x in found.collect()}
    assert got == {i: text.removeprefix("menu home\n") for i, text, _ in rows}
    left = [x.text for x in corpus_pipeline.keep_one_of_each(spark, found, "").collect()]
    assert left.count(copied) == 1 and len(left) == 21


def test_the_pipeline_drops_lines_of_a_few_hundredths_and_of_small_hosts(spark):
    r = random.Random(13)
    rows = [(i, ("license line\n" if i % 25 == 0 else "") + ("once\n" if i == 7 else "") + prose(40, r), "big") for i in range(200)]
    rows += [(300 + i, f"menu\n{prose(40, r)}", "small") for i in range(3)]
    base = [prose(30, r) for _ in range(12)]
    near_ = [(400 + i, "\n".join([*base[:5], prose(30, r), *base[6:]]), "big") for i in range(20)]
    df = spark.createDataFrame([(*x, "en", len(x[1])) for x in rows + near_], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_lines(spark, df, "").collect()}
    assert got == {i: text.removeprefix("license line\n").removeprefix("menu\n") for i, text, _ in rows + near_}


def test_mix_meets_targets_and_repeats(docs, none):
    one, two = (mixing.mix(d, block=16).collect() for d in (docs, docs.repartition(3)))
    assert Counter(one) == Counter(two) and len(one) == len(corpus())
    sizes = Counter()
    for r in one:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    for s in order:
        own = [r for r in one if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in own) and abs(sum(r.taken for r in own) - want[s]) <= 1
    size = {r.id: r.size for r in one}
    assert size[25] == size[26] == size[27] == 0 and size[28] == 2 and size[30] == 30_000
    mixed = mixing.repeat_taken(docs, block=16)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    for r in one:
        if r.id not in (24, None):
            assert times[r.id] == (int(r.taken / r.size + 0.5) if r.size else 0)
    assert mixing.mix(none).count() == 0 and mixing.repeat_taken(none).count() == 0


def plain_mix(rows, block, weights=(3, 1, 2)):
    """Plain Python: words taken of each row (id, text, source, place in its source's shuffled order)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s, _ in rows if s == x) for x in order]
    goals = mixing.targets(sizes, [float(weights[i % len(weights)]) for i in range(len(order))])
    takes = [min(int(g + 0.5), 2 * n) for g, n in zip(goals, sizes)]
    blocks = [-(-n // block) for n in sizes]
    slots = [t // n * b + -(-(t % n) // block) if n else 0 for t, n, b in zip(takes, sizes, blocks)]
    total, one = sum(slots), 1 << 40
    edges = [sum(slots[:i]) * one // total for i in range(len(slots) + 1)] if total else [0] * (len(slots) + 1)
    got = [0] * len(order)
    for i in range(total):
        u = i * 679_572_821_001 % one
        got[next(s for s in range(len(order)) if edges[s] <= u < edges[s + 1])] += 1
    # the first `slots` ranks of a source are served whether its points were too many or too few
    out = Counter()
    for s, source in enumerate(order):
        taken = Counter()  # words of each block
        for rank in range(slots[s]):
            b, lap = rank % blocks[s], rank // blocks[s]
            taken[b] = max(taken[b], 0) + max(0, min(min(block, sizes[s] - b * block), takes[s] - lap * sizes[s] - b * block))
        at = 0
        laps: dict = {}
        for rank in range(slots[s]):
            b, lap = rank % blocks[s], rank // blocks[s]
            laps.setdefault(b, []).append(max(0, min(min(block, sizes[s] - b * block), takes[s] - lap * sizes[s] - b * block)))
        for d, t, x, _ in sorted((r for r in rows if r[2] == source), key=lambda r: r[3]):
            n = size(t)
            words = sum(max(0, min(at + n, b * block + k) - max(at, b * block)) for b in range(at // block, (at + n - 1) // block + 1 if n else 0) for k in laps.get(b, []))
            out[d, n, sizes[s], round(goals[s], 6), words] += 1
            at += n
    assert all(abs(g - n) <= 3 + 0.02 * total for g, n in zip(got, slots))
    return out


def test_mix_equals_plain_python(spark):
    r = random.Random(17)
    rows = [(i, prose(r.randrange(0, 60), r) if i % 13 else None, r.choice(["a", "a", "a", "b", "c", "é", None]) if i % 11 else f"s{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    places = {x.doc_id: x.h for x in df.select("doc_id", unit_hash("doc_id", mixing.words_of("text")).alias("h")).collect()}
    got = Counter((x.id, x.size, x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df, block=16).collect())
    assert got == plain_mix([(*x, places[x[0]]) for x in rows], 16)


def test_targets_in_tables_equal_plain_python(spark):
    r = random.Random(8)
    for n in (1, 2, 7, 40):
        sizes = [r.choice([0, 1, r.randrange(1000), r.randrange(100_000)]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [x.target for x in mixing.plan(df, mixing.WEIGHTS, 1.5, 2.0, 256).orderBy("number").collect()]
        assert got == pytest.approx(mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)]), abs=1e-6)


def test_schedule_is_even_everywhere(spark):
    plan = spark.createDataFrame([(0, 6400, 6400, 100, 100), (1, 3200, 3200, 50, 50), (2, 3200, 6400, 50, 100), (3, 0, 0, 0, 0)], "number int, source_size long, take long, blocks long, slots long")
    slots = sorted(mixing.schedule(plan, 64).collect(), key=lambda r: r.slot)
    assert Counter(r.number for r in slots) == {0: 100, 1: 50, 2: 100}
    for n in (25, 50, 125, 200):
        got = Counter(r.number for r in slots[:n])
        assert abs(got[0] - 0.4 * n) <= 3 and abs(got[1] - 0.2 * n) <= 3
    assert sorted(r.block for r in slots if r.number == 2) == sorted(list(range(50)) * 2)


def test_packs_are_gapless_and_whole(docs, none):
    args = registry.tokenizer_files()
    rows = packing.pack(docs, args).collect()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(args[0])
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.id, []).append(r)
    texts: dict = {}
    for d, t, *_ in corpus():
        texts.setdefault(d, []).append(t)
    for d, own in texts.items():
        ids = np.array([*slow.encode(own[0] or "", add_special_tokens=False).ids, 0], np.uint32)
        starts = Counter()
        for p in pieces[d]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            starts.update(range(p.start, p.start + p.length))
        assert starts == Counter({i: len(own) for i in range(len(ids))})
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in spans:
        assert s * 1024 + o == at and o + n <= 1024
        at += n
    assert packing.pack(none, args).count() == 0


def shares_of_windows(rows, source_of):
    """Of each full window the share of tokens of each source."""
    out = {}
    for p in rows:
        out.setdefault(p.sequence_id, Counter())[source_of(p.id)] += p.length
    return [{s: n / 1024 for s, n in c.items()} for _, c in sorted(out.items()) if sum(c.values()) == 1024]


def test_every_window_holds_the_mixture(spark):
    r = random.Random(9)
    rows = [(i, prose(r.randrange(1, 600), r), f"s{i % 20}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = packing.pack(df, registry.tokenizer_files()).collect()
    tokens = Counter()
    for p in got:
        tokens[p.id % 20] += p.length
    target = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    for shares in shares_of_windows(got, lambda i: i % 20):
        assert sum(abs(shares.get(s, 0) - t) for s, t in target.items()) / 2 < 0.1


def test_packing_follows_weights(spark):
    df = spark.createDataFrame([(i, prose(60), "a" if i % 2 else "b") for i in range(80)], "doc_id long, text string, source string")
    rows = packing.pack(df, registry.tokenizer_files(), weights={"a": 3.0, "b": 1.0}).collect()
    for shares in shares_of_windows(rows, lambda i: i % 2)[:6]:
        assert shares[1] == pytest.approx(0.75, abs=0.01)
    none_of_b = packing.pack(df, registry.tokenizer_files(), weights={"b": 0.0}).collect()
    last_a, first_b = (f((p.sequence_id, p.offset) for p in none_of_b if p.id % 2 == odd) for f, odd in ((max, 1), (min, 0)))
    assert last_a < first_b


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 8)
    monkeypatch.setattr(packing, "RUN", 2)
    r = random.Random(2)
    rows = [(i, prose(r.randrange(1, 60), r), f"s{i % 90}" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    got, encode = packing.pack(df, registry.tokenizer_files()).collect(), packing.Encoder(*registry.tokenizer_files())
    seen = Counter((p.id, p.start + k) for p in got for k in range(p.length))
    assert seen == Counter({(i, k): 1 for i, t, _ in rows for k in range(len(encode(t)))})
    spots = sorted(p.sequence_id * 1024 + p.offset + k for p in got for k in range(p.length))
    assert spots == list(range(len(seen)))


def test_language_over_rows(docs, none):
    model = language.fit(docs)
    rows = docs.select("doc_id", language.predict(docs, model).alias("p")).collect()
    by = {r.doc_id: r.p for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (25, 26, 27)) and by[28].lang_pred == "de"
    assert all(0 <= r.p.score <= 1 for r in rows)
    empty = language.fit(none)
    assert docs.select(language.predict(docs, empty).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def plain_language(rows, texts):
    """Plain Python: (language, probability) of each text, learned from rows (text, language)."""
    letters = lambda t: re.findall(r"\w+", "".join(c if unicodedata.category(c).startswith("L") else " " for c in (t or "").lower()))
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts: dict = {}
    for text, lang in rows:
        for w in letters(text):
            for n, e in [(0, w), *((n, e) for n in range(1, 6) for e in grams(w, n))]:
                counts.setdefault((lang, n), Counter())[e] += 1
    langs = sorted({lang for _, lang in rows})
    cost = lambda lang, n, e: min(7.0, -math.log10(c / counts[lang, n].total())) if (c := counts[lang, n][e]) else 7.0
    known = lambda n, e: any(e in counts[lang, n] for lang in langs)
    out = []
    for t in texts:
        sums, words = dict.fromkeys(langs, 0.0), letters(t)
        for w in words:
            n, parts = next(((n, p) for n, p in [(0, [w] * known(0, w)), *((n, [e for e in grams(w, n) if known(n, e)]) for n in (5, 4, 3, 2, 1))] if p), (None, []))
            for lang in langs:
                sums[lang] += sum(cost(lang, n, e) for e in parts) / len(parts) if parts else 7.0
        best = min(langs, key=lambda lang: (round(sums[lang] / max(1, len(words)), 9), lang))
        odds = [10 ** -(max(0.0, sums[lang] - sums[best])) for lang in langs]
        out.append((best, 1 / sum(odds)) if words else ("und", 0.0))
    return out


def test_language_equals_plain_python(spark):
    r = random.Random(21)
    own = {lang: ["".join(r.choice(a) for _ in range(r.randrange(2, 7))) for _ in range(60)] for lang, a in {"aa": "abcdeé", "bb": "abcdfg", "cc": "xyzab"}.items()}
    rows = [(i, " ".join(r.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    bare = language.Model(model.languages, model.entries, model.at, model.of, model.costs)
    bare._all = None  # as with more entries than are laid out
    assert all(np.allclose(bare.word_cost(w), model.word_cost(w), atol=1e-5) for w in ("abcde", "zzzz", "é", *own["aa"][:9]))
    texts = [" ".join("".join(r.choice("abcdeéfgxyz") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    texts += [" ".join(r.choice(own[lang]) for _ in range(25)) for lang in own] + [None, "", "½ ²", "Ⅷ", "日本", "A_b 7x", "a½b ab²cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x.i: (x.p.lang_pred, x.p.score) for x in df.select("i", language.predict(df, model, "t").alias("p")).collect()}
    for i, (lang, p) in enumerate(plain_language([(t, lang) for _, t, lang in rows], texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, abs=1e-3)


def test_many_languages_share_the_characters_that_are_learned(spark):
    r = random.Random(5)
    rows = [(i * 40 + j, " ".join(f"{chr(0x4E00 + i)}{r.choice('abc')}" for _ in range(20)), f"l{i:03d}") for i in range(600) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, max_chars=600 * 60)
    assert len(model.languages) == 600
    found = df.select("lang", language.predict(df, model).alias("p"))
    assert found.where("lang = p.lang_pred").count() == len(rows)


def test_toxicity_learns_planted_words(spark, none):
    r = random.Random(3)
    rows = [(i, prose(40, r) + (" vileword zzqx " if i % 4 == 0 else " ") + prose(40, r), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.where("doc_id < 120").select("doc_id", F.col("y").alias("toxic")).union(spark.createDataFrame([(5000, 1), (121, None)], "doc_id long, toxic int"))
    model = toxicity.fit(df, labels)
    scored = df.withColumn("got", toxicity.score(df, model))
    assert scored.where("(got >= 0.5) <> (y = 1)").count() == 0 and scored.where("got < 0 or got > 1").count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("x",), ("ab " * 200_000,)], "text string")
    assert odd.withColumn("s", toxicity.score(odd, model)).where("s >= 0 and s <= 1").count() == 4
    assert toxicity.reject_toxic(df, model).columns == df.columns and toxicity.reject_toxic(df, model).count() == 120
    # plain Python on the same hashed features: document frequencies, shrunk ratios, gradient steps
    known = {i: y for i, _, y in rows if i < 120}
    sets = {i: set(toxicity.ngram_buckets(t).tolist()) for i, t, _ in rows}
    n1, share = sum(known.values()), sum(known.values()) / len(known)
    df1, df0 = (Counter(f for i, y in known.items() if y == k for f in sets[i]) for k in (1, 0))
    scale = {}
    for f in set(df1) | set(df0):
        a, b, na, nb = df1[f] + share, df0[f] + 1 - share, n1 + share, len(known) - n1 + 1 - share
        ratio, error = math.log(a / na) - math.log(b / nb), math.sqrt(max(0.0, 1 / a - 1 / na + 1 / b - 1 / nb))
        if abs(ratio) > toxicity.SHRINK * error:
            scale[f] = math.copysign(abs(ratio) - toxicity.SHRINK * error, ratio)
    names, y = sorted(scale), np.array([known[i] for i in sorted(known)])
    x = np.array([[scale[f] * (f in sets[i]) for f in names] for i in sorted(known)])
    w, c = np.zeros(len(names)), 0.0
    step = 1 / (0.25 * np.linalg.norm(np.column_stack([x, np.ones(len(x))]), 2) ** 2 + 1)
    for _ in range(30_000):
        e = 1 / (1 + np.exp(-(x @ w + c))) - y
        w, c = w - step * (x.T @ e + w), c - step * e.sum()
    weight = dict(zip(names, w))
    for s in scored.collect():
        z = c + sum(weight.get(f, 0.0) * scale.get(f, 0.0) for f in sets[s.doc_id])
        assert s.got == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)
    nothing = toxicity.fit(df, labels.limit(0))
    assert df.withColumn("s", toxicity.score(df, nothing)).where("s > 0.01").count() == 0
    assert toxicity.reject_toxic(none, model).count() == 0


def test_ogg_over_rows(docs, none):
    rows = docs.select("doc_id", "text", ogg.stored("text").alias("m")).withColumn("r", ogg.inspected("m")).collect()
    for row in rows:
        n, payload = ogg.padded(row.text)
        assert (row.r.n_bytes, row.r.payload_bytes, row.r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert row.r.tail_crc32 == zlib.crc32(payload[-64:]) and row.r.media_sha256 == hashlib.sha256(bytes(row.m)).hexdigest() and row.r.media_bytes == len(row.m)
    assert len({(r.text, r.r.feature) for r in rows}) == len({r.text for r in rows})
    assert none.select(ogg.inspected(ogg.stored("text"))).count() == 0


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(0, 1, 64).tolist()) for i in range(300)] + [(300 + i, [1.0] * 64) for i in range(40)] + [(400, None), (401, []), (402, [float("nan")] * 64), (None, [1.0] * 64), (7, [1.0] * 64)]
    df = spark.createDataFrame(vectors, "id long, e array<double>").select("id", hamming.sign_code("e").alias("code"))
    rows = hamming.top_k(df, df.where("id % 20 = 0"), 5).collect()
    codes = [(i, [x > 0 and x == x for x in e]) for i, e in vectors if e and i is not None]
    want = set()
    for q, a in codes:
        if q % 20 == 0:
            near_ = sorted((sum(x != y for x, y in zip(a, b)), i) for i, b in codes)[:5]
            want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near_)}
    assert {tuple(x) for x in rows} == want
    assert hamming.top_k(df.limit(0), df, 5).count() == 0 and hamming.top_k(df, df.limit(0), 5).count() == 0
    two = df.where("id < 2")
    assert hamming.top_k(two, two, 5).count() == 4


def test_codes_of_longer_vectors(spark):
    r = np.random.default_rng(6)
    centre = r.normal(0, 1, 150)
    vectors = [(i, (centre + r.normal(0, 0.4 + 0.01 * i, 150)).tolist()) for i in range(120)] + [(200, [1.0, -1.0])]
    df = spark.createDataFrame(vectors, "id long, e array<double>")
    assert hamming.longest(df, "e") == 150 and hamming.longest(df.limit(0), "e") == 1
    codes = df.select("id", hamming.sign_code("e", 150).alias("code"))
    rows = hamming.top_k(codes, codes.where("id % 20 = 0"), 4).collect()
    bits = {i: [x > 0 for x in e] + [False] * (192 - len(e)) for i, e in vectors}
    want = {(q, n + 1, i, d) for q in bits if q % 20 == 0 for n, (d, i) in enumerate(sorted((sum(x != y for x, y in zip(bits[q], b)), i) for i, b in bits.items())[:4])}
    assert {tuple(x) for x in rows} == want
    with pytest.raises(Exception, match="more than 64 elements: 150"):
        df.select(hamming.sign_code("e").alias("code")).collect()


@pytest.mark.parametrize("n, words", [(1, 1), (40, 1), (3000, 1), (3000, 3)])
def test_index_meets_each_code_once_and_finds_the_nearest(n, words):
    r = np.random.default_rng(n + words)
    codes = np.unique(r.integers(0, 1 << 63, (n, words), dtype=np.uint64) & np.uint64(0x00FFFF00FFFF0FFF), axis=0)
    index = hamming.Index(codes)
    queries = np.concatenate([codes[:3], r.integers(0, 1 << 63, (5, words), dtype=np.uint64)])
    apart = np.bitwise_count(queries[:, None] ^ codes[None]).sum(2, dtype=np.int64)
    own, seen = [index.values(queries, p) for p in index.parts], []
    for distance in range(max(map(len, index.parts)) + 1):
        for segment, part in enumerate(index.parts):
            if distance <= len(part):
                for q, c, d in index.met(queries, own[segment], np.arange(len(queries)), segment, distance):
                    assert (apart[q, c] == d).all()
                    seen += zip(q.tolist(), c.tolist())
        if n > 1000 and distance == 3:
            break
    assert len(set(seen)) == len(seen) and (n > 1000 or len(seen) == len(queries) * len(codes))
    low, size = r.permutation(len(codes)).astype(np.int64), r.integers(1, 4, len(codes))
    q, c, d = index.nearest(queries, np.full(len(queries), 64 * words), low, size, 7)
    for i in range(len(queries)):
        best = np.lexsort((low, apart[i]))[:7]
        enough = int(np.searchsorted(np.cumsum(size[best]), 7)) + 1
        limit = apart[i][best[min(enough, len(best)) - 1]]
        want = [x for x in best if apart[i][x] <= limit]
        assert c[q == i][: len(want)].tolist() == want


def test_blocks_and_batches_change_nothing(spark):
    r = np.random.default_rng(8)
    vectors = [(i, r.normal(0, 1, 64).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 64) for i in range(60)]
    df = spark.createDataFrame(vectors, "id long, e array<double>").select("id", hamming.sign_code("e").alias("code")).cache()
    asked = df.where("id % 20 = 0")
    whole = {tuple(x) for x in hamming.top_k(df, asked, 6).collect()}
    assert {tuple(x) for x in hamming.top_k(df, asked, 6, block=64, batch=8).collect()} == whole and len(whole) == 6 * asked.count()


def test_pages_of_a_host_lose_what_they_share(spark):
    r = random.Random(6)
    chrome = prose(14, r)
    rows = [(i, "http://a.example/x", f"<p>{chrome}</p><div>{prose(20, r)}</div>", "mine") for i in range(4)]
    rows += [(10, "http://a.example/y", f"<div>{chrome}</div><article><p>{chrome}</p></article>", "m"), (11, None, "<p>alone</p>", "m"), (12, "bad url", None, "m"), (13, "http://b.example", f"<p>{chrome}</p>", "m")]
    rows += [(14, "http://c.example", "<p>copy of a page</p>" * 3, "m"), (15, "http://c.example", "<p>copy of a page</p>" * 3, "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extract_page string")
    got = {x.page_id: x.text for x in extract.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] and chrome not in got[i] and got[i] in rows[i][2] for i in range(4))
    assert got[10] == chrome and got[11] == "alone" and got[12] == "" and got[13] == chrome and got[14] == "\n".join(["copy of a page"] * 3) == got[15]
    assert extract.extract(df.limit(0)).count() == 0


def plain_texts(rows):
    """Plain Python: every string of DEPTH tokens of a host's regions, and the regions that hold it."""
    pages = [(i, re.sub(r"^[a-z]+://|/.*", "", url) if url and "://" in url else "", extract.regions(page)) for i, url, page, *_ in rows]
    units = {((h, kind), tuple(t)): [w.lower() for x in t for w in x.split()] for _, h, found in pages for kind, t, _ in found}
    grams = lambda w: [tuple(w[i : i + extract.DEPTH]) for i in range(len(w) - extract.DEPTH + 1)]

    def covers(counted, least):
        holds = {}
        for h, t in counted:
            for g in grams(units[h, t]):
                holds.setdefault((h, g), set()).add(t)
        out = {}
        for (h, t), w in units.items():
            out[h, t] = on = np.zeros(len(w), bool)
            for i, g in enumerate(grams(w)):
                if len(holds.get((h, g), ())) >= least(h):
                    on[i : i + extract.DEPTH] = True
        return out

    first = covers(set(units), lambda h: 2)
    own = {u for u, on in first.items() if 1 - on.mean() >= extract.OWN}
    of = Counter(h for h, _ in own)
    second = covers(own, lambda h: max(3, of[h] // 2 + 1) if h[1] == "main" else max(2, int(of[h] * 0.1) + 1))
    return {i: extract.main_text(found, [second[(h, kind), tuple(t)] for kind, t, _ in found]) for i, h, found in pages}


@pytest.mark.parametrize("most", [extract.MAX_SENT, -1])
def test_texts_equal_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(extract, "MAX_SENT", most)
    r = random.Random(31)
    rows = []
    for host in ("a.example", "b.example"):
        chrome, notice, quote, copy = (prose(n, r) for n in (15, 12, 10, 80))
        for i in range(14):
            body = f"<p>{prose(r.randrange(3, 60), r)} {quote if i % 4 == 0 else ''} {prose(20, r)}</p><p>{notice}</p>" if i % 5 else f"<p>{copy}</p>"
            body = [f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"][i % 3]
            rows.append((len(rows), f"http://{host}/{i}", f"<nav>x</nav><div>{chrome}</div>{body}<p class='share-box-words'>{notice}</p><footer>f</footer>", "m"))
    rows += [(90, "http://a.example/z", rows[3][2], "m"), (90, "http://a.example/z", rows[3][2], "m"), (91, None, None, "m"), (92, "", "", None), (93, "http://a.example", f"<p>{prose(30_000, r)}</p>", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extract_regions string").repartition(5)
    got = Counter((x.page_id, x.text) for x in extract.extract(df).collect())
    want = plain_texts(rows)
    assert got == Counter((i, want[i]) for i, *_ in rows)


def test_sentences_that_articles_share_stay(spark):
    """On under half of a host's articles, or on two of few, a repeated sentence is text; on most it is none."""
    r = random.Random(17)
    saying, line = prose(12, r), prose(10, r)
    for n, with_saying in ((30, 12), (4, 2), (3, 2)):
        rows = [(i, "http://a.example/x", f"<main><h1>Title {i}</h1><article><p>{prose(30, r)}</p>{f'<p>{saying}</p>' if i < with_saying else ''}<article><p>inner {prose(9, r)}</p></article><p>end {i}</p></article><article>side {i}</article><p>{line}</p></main>") for i in range(n)]
        got = {x.page_id: x.text.split("\n") for x in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i in range(n):
            assert got[i][0] == f"Title {i}" and (saying in got[i]) == (i < with_saying) and [x for x in got[i] if x.startswith("inner")] and f"end {i}" in got[i] and f"side {i}" in got[i]
            assert line not in got[i]


def test_pages_of_megabytes(spark):
    r = random.Random(18)
    long = "".join(f"<p>{prose(40, r)}</p>" for _ in range(8_000))
    rows = [(1, "http://a.example/1", f"<nav>menu</nav><article>{long}</article>"), (2, "http://a.example/2", "<div>" * 20_000 + "deep")]
    got = {x.page_id: x.text for x in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n".join(re.findall(r"<p>(.*?)</p>", long)) and got[2] == "deep"


def test_near_copies_of_a_page_keep_their_text(spark):
    r = random.Random(14)
    chrome, article = prose(12, r), prose(120, r)
    rows = [(i, "http://a.example/x", f"<p>{chrome}</p><p>{article}</p><p>read {i} times</p>") for i in range(3)]
    rows += [(10 + i, "http://a.example/y", f"<p>{chrome}</p><p>{prose(40, r)}</p>") for i in range(3)]
    got = {x.page_id: x.text for x in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{article}\nread {i} times" for i in range(3))
    assert all(got[10 + i] and chrome not in got[10 + i] for i in range(3))


def plain_lines(rows):
    """Plain Python: rows (id, text, ..., source) without lines on over RATIO of a source's distinct texts, near copies left out."""
    pages = {(r[-1], r[1]) for r in rows}
    of = lambda t: {x for x in t.split("\n") if x} if t is not None else set()

    def often(counted):
        total, on = Counter(s for s, _ in counted), Counter((s, x) for s, t in counted for x in of(t))
        return {k for k, n in on.items() if n >= lines.MIN_PAGES and n > lines.RATIO * total[k[0]]}

    first = often(pages)
    length = lambda xs: sum(map(len, xs))
    own = {(s, t) for s, t in pages if t is None or length(x for x in of(t) if (s, x) not in first) >= lines.OWN * length(of(t))}
    bad = often(own) & first
    return [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[-1], x) not in bad), *r[2:]) for r in rows]


def plain_near(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """A folder with documents and labels: toxic words, boilerplate, copies, near copies, null and empty texts."""
    r, rows, toxic = random.Random(41), [], {}
    for i in range(90):
        source = r.choice(["s0", "s0", "s1", None])
        text = "\n".join(["site menu of " + str(source), prose(r.randrange(15, 60), r), prose(r.randrange(15, 60), r)])
        if i % 6 == 0:
            text += " vileword zzqx " + prose(10, r)
        toxic[i] = int(i % 6 == 0)
        rows.append((i, text, "en", source))
    base = rows[1][1].split(" ")
    base[20] = "edited"
    rows += [(100, rows[1][1], "en", rows[1][3]), (101, " ".join(base), "en", "s1"), (102, None, "en", "s0"), (103, "", None, None), (104, rows[2][1].upper(), "en", "s1")]
    sf = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumn("host", F.lit("clash"))
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf), rows


def test_pipeline_equals_plain_python(spark, small_corpus):
    sf, rows = small_corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.fit(docs, labels.where(~F.col("doc_id").isin([i for i in range(90) if held(i)])))
    want, found = [x for x in rows if model.score(x[1]) < 0.5], docs
    assert {x[0] for x in rows} - {x[0] for x in want} >= {i for i in range(0, 90, 6) if not held(i)}
    plain = [want]
    plain.append(plain_lines(plain[-1]))
    plain.append(plain_near(plain[-1]))
    assert any(a[1] != b[1] for a, b in zip(plain[0], plain[1])) and len(plain[2]) < len(plain[1])
    places = {(x.doc_id, x.size): x.h for x in spark.createDataFrame([(x[0], len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))) for x in plain[2]], "doc_id long, size long").select("doc_id", "size", unit_hash("doc_id", "size").alias("h")).collect()}
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))
    taken = {d: n for (d, _, _, _, n), _ in plain_mix([(x[0], x[1], x[3], places[x[0], size(x)]) for x in plain[2]], mixing.BLOCK).items()}
    mixed = []
    for source in {x[3] for x in plain[2]}:
        own = [x for x in plain[2] if x[3] == source and size(x)]
        passes = sum(taken[x[0]] for x in own) // max(1, sum(map(size, own)))
        cut = max((places[x[0], size(x)] for x in own if round(taken[x[0]] / size(x)) > passes), default=-1.0)
        mixed += [x for x in own for _ in range(passes + (places[x[0], size(x)] <= cut))]
    plain.append(mixed)
    for (name, stage), rows_ in zip(corpus_pipeline.STAGES[:-1], plain):
        found = written(stage(spark, found, sf), f"test-{name}")
        assert sorted(found.columns) == sorted(docs.columns), name
        assert Counter((x.doc_id, x.text, x.source) for x in found.collect()) == Counter((x[0], x[1], x[3]) for x in rows_), name
        assert found.where("text is not null and n_chars <> length(text)").count() == 0
    encode, pieces, spots = packing.Encoder(*registry.tokenizer_files()), Counter(), Counter()
    copies = Counter(x[0] for x in mixed)
    ids = {x[0]: encode(x[1]) for x in mixed}
    last, total = corpus_pipeline.run(spark, sf).collect(), 0
    for x in last:
        assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) and x.doc_tokens == len(ids[x.doc_id])
        pieces.update((x.doc_id, x.start + i) for i in range(x.length))
        spots.update(x.sequence_id * 1024 + x.offset + i for i in range(x.length))
        total += x.length
    assert pieces == Counter({(d, i): n for d, n in copies.items() for i in range(len(ids[d]))})
    assert spots == Counter(range(total))


def test_pipeline_of_empty_tables(spark, small_corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small_corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_columns_and_ends_in_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, n = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf)
        assert sorted(found.columns) == sorted(docs.columns), name
        n.append(found.count())
        assert found.where("text is not null and n_chars <> length(text)").count() == 0
    assert n[0] > n[1] == n[2] > n[3]
    pieces = corpus_pipeline.run(spark, sf)
    total, last = pieces.agg(F.sum("length"), F.max("sequence_id")).collect()[0]
    assert total > 1024 * last
