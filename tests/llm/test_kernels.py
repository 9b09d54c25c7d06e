"""Kernels of the corpus operators against brute force, without Spark."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import extract, language, mixing, ogg, packing, registry, repeats, shingles, toxicity

ENCODE = packing.Encoder(*registry.tokenizer_files())


def words(text: str) -> list[str]:
    return [w for w in "".join(c if c not in "\x20\x09\x0a\x0b\x0c\x0d" else " " for c in text).split(" ") if w]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té x", max_size=60), max_size=6))
def test_shingle_sets_tell_texts_apart_as_word_tuples_do(texts):
    sets = shingles.shingle_sets([t.encode() for t in texts])
    want = []
    for t in texts:
        w = words(lower(t))
        want.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:3000])
    k = shingles.sketches([a, b, np.union1d(a, b), np.empty(0, np.uint64)])
    assert (np.maximum(k[0], k[1]) == k[2]).all() and not k[3].any()
    est = shingles.joint_estimate(k[:1], k[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - 0.5) < 5 * np.sqrt(0.25 / shingles.REGISTERS)
    same = shingles.joint_estimate(k[:1], k[:1], np.array([len(a)]), np.array([len(a)]))[0]
    assert same > 0.97


def brute_cover(texts: list[bytes], n: int = 50) -> list[bytes]:
    seen, out = set(), []
    for t in texts:
        on = bytearray(len(t))
        own = [t[i : i + n] for i in range(len(t) - n + 1)]
        for i, w in enumerate(own):
            if w in seen:
                on[i : i + n] = b"\1" * n
        seen |= set(own)
        out.append(bytes(on))
    return out


def test_anchors_are_chosen_by_content_alone():
    r = random.Random(1)
    shared = bytes(r.randrange(97, 101) for _ in range(50))
    for _ in range(50):
        a = bytes(r.randrange(97, 101) for _ in range(r.randrange(80))) + shared + bytes(r.randrange(97, 101) for _ in range(40))
        h, p = repeats.anchors(a)
        at = a.index(shared)
        inside = {x - at: y for x, y in zip(p.tolist(), h.tolist()) if at <= x <= at + repeats.REACH}
        g, q = repeats.anchors(shared)
        assert q.tolist() and all(inside.get(x) == y for x, y in zip(q.tolist(), g.tolist()))
    assert not len(repeats.anchors(b"x" * 49)[0])


def test_covered_offsets_equal_brute_force():
    r = random.Random(2)
    base = bytes(r.randrange(97, 100) for _ in range(300))
    texts = []
    for _ in range(12):
        lo = r.randrange(200)
        cut = bytearray(base[lo : lo + 100] * r.randrange(1, 3))
        if r.random() < 0.6:
            cut[r.randrange(len(cut))] = 120
        texts.append(bytes(r.randrange(97, 123) for _ in range(r.randrange(20))) + bytes(cut))
    h, at, doc, ctx, left, right = [], [], [], [], [], []
    for d, t in enumerate(texts):
        a, p = repeats.anchors(t)
        wide = np.frombuffer(bytes(repeats.REACH) + t + bytes(repeats.REACH), np.uint8)
        ctx.append(np.lib.stride_tricks.sliding_window_view(wide, repeats.LENGTH + repeats.REACH)[p])
        h.append(a)
        at.append(p)
        doc.append(np.full(len(p), d))
        left.append(np.minimum(p, repeats.REACH))
        right.append(np.minimum(len(t) - repeats.ANCHOR - p, repeats.REACH))
    h, at, doc, ctx, left, right = (np.concatenate(x) for x in (h, at, doc, ctx, left, right))
    on = repeats.covered_offsets(h, ctx, left, right, doc)
    got = [bytearray(len(t)) for t in texts]
    for i, o in zip(*np.nonzero(on)):
        s = at[i] - o
        got[doc[i]][s : s + 50] = b"\1" * 50
    assert [bytes(g) for g in got] == brute_cover(texts) and any(map(any, got))


def test_maximal_repeats_equal_brute_force():
    texts = [b"abcabcxabc", b"zabcab", b""]
    got = repeats.maximal_repeats(texts, 3)
    every = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 3, len(t) + 1):
                every.setdefault(t[a:b], []).append((i, a))
    want = []
    for s, at in every.items():
        before = {texts[i][a - 1] if a else (-1, i) for i, a in at}
        after = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (-1, i) for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.append((len(s), sorted(at)))
    assert got == sorted(want)


def slow_checksum(data: bytes) -> int:
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 4096, 65_025, 70_000, 300_000])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = ogg.write(payload, "note é")
    streams = ogg.read(data)
    assert ogg.samples(streams) == payload and streams[ogg.NOTES].packets[1].decode() == "note é"
    assert streams[ogg.AUDIO].seconds()[-1] == n / ogg.RATE
    assert slow_checksum(data[:40]) == ogg.page_checksum(data[:40])


def test_ogg_damage_is_found():
    data = ogg.write(b"x" * 9000)
    for at in (5, 30, 200, len(data) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    for bad in (data[:-3], data[1:], data + data[:60]):
        with pytest.raises(ogg.OggError):
            ogg.read(bad)


def test_ogg_packets_of_lace_multiples_and_interleaved_streams():
    a = ogg.pages_of([(b"h", 0), (b"p" * 510, 510), (b"", 510), (b"q" * 66_000, 66_510)], 7)
    b = ogg.pages_of([(b"one", 1)], 9)
    streams = ogg.read(b"".join([a[0], b[0], *a[1:]]))
    assert [len(p) for p in streams[7].packets] == [1, 510, 0, 66_000] and streams[9].packets == [b"one"]


def test_toxicity_features_and_regression():
    assert not len(toxicity.ngram_buckets(None)) and not len(toxicity.ngram_buckets(""))
    assert set(toxicity.ngram_buckets("ABC")) == set(toxicity.ngram_buckets("abc"))
    r = np.random.default_rng(0)
    x = r.random((200, 5)) < 0.5
    y = (x[:, 0] | x[:, 1]).astype(float)
    rows, cols = np.nonzero(x)
    w, b = toxicity.logistic(toxicity.Sparse(rows, cols, np.ones(len(rows)), 200, 5, block=70), y, 0.1, 2000)
    assert ((x @ w + b > 0) == y).all()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 0.1 * w).max() < 1e-2 and abs((p - y).sum()) < 1e-2
    same = toxicity.log_count_ratios(np.array([10, 0]), np.array([90, 0]), 10, 90)
    assert same[0] == 0 and abs(same[1]) < 1e-2
    told = toxicity.log_count_ratios(np.array([90.0]), np.array([10.0]), 100, 100)[0]
    plain, error = np.log(90.5 / 100.5) - np.log(10.5 / 100.5), np.sqrt(1 / 90.5 + 1 / 10.5 - 2 / 100.5)
    assert told == pytest.approx(plain - toxicity.SHRINK * error)


def test_language_backs_off_from_words_to_ngrams():
    counts = {lang: dict(language.count_entries([t] * 3)) for lang, t in {"en": "the house of the rising sun", "de": "das haus der aufgehenden sonne"}.items()}
    model = language.build(counts)
    assert model.predict("THE sun")[0] == "en" and model.predict("das haus")[0] == "de"
    assert model.predict("aufgehen sonnen")[0] == "de"  # unseen words, known pieces
    assert model.predict(None) == ("und", 0.0) and model.predict("123 !?")[0] == "und" and model.predict("")[0] == "und"
    lang, score = model.predict("日本")
    assert lang in ("de", "en") and 0 <= score <= 1  # only the padding is known
    none = language.Model([], {}, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    assert none.predict("abc") == ("und", 0.0)
    assert all(model.predict(t) == ("und", 0.0) for t in ("½", "² Ⅷ ①", "٣ 12", "_ - _"))
    long = model.predict("the sun " * 300_000)
    assert long[0] == "en"


def test_mixing_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    t = mixing.targets([10, 1000, 10], [3, 1, 2])
    assert t == [20.0, 1490.0, 20.0]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0] and mixing.targets([], []) == []


def plain_round_robin(quanta, totals):
    """(queue, first, past) of what queues send, one round after the other: a credit of at least LEAST is spent in whole."""
    credit = [0.0 if q >= packing.LEAST else packing.LEAST * ((i + 1) * 0.6180339887498949 % 1) for i, q in enumerate(quanta)]
    at, out = [0] * len(quanta), []
    while any(a < t for a, t, q in zip(at, totals, quanta) if q > 0):
        for i, q in enumerate(quanta):
            if q > 0 and at[i] < totals[i]:
                credit[i] += q
                unit = 1 if q >= packing.LEAST else packing.LEAST
                n = min(int((credit[i] + 1e-9) // unit) * unit, totals[i] - at[i])
                credit[i] -= n
                if n:
                    out.append((i, at[i], at[i] + n))
                    at[i] += n
    return out + [(i, 0, t) for i, (q, t) in enumerate(zip(quanta, totals)) if q == 0 and t]


def test_schedule_is_that_of_deficit_round_robin():
    r = random.Random(3)
    for turn in range(12):
        quanta = [r.choice([0.0, 0.25, 1.5, 31.5, 32.0, 50.25, 300.75]) for _ in range(r.randrange(1, 9))]
        totals = [r.randrange(1, 900) for _ in quanta]
        stream = [(i, x) for i, a, b in plain_round_robin(quanta, totals) for x in range(a, b)]
        plan, got = packing.Schedule(np.array(quanta), np.array(totals)), {}
        queue, spot, n = [], [], []
        for i, t in enumerate(totals):
            at = 0
            while at < t:
                size = min(t - at, r.randrange(1, 200))
                queue, spot, n, at = [*queue, i], [*spot, at], [*n, size], at + size
        doc, first, length, place = plan.pieces(*(np.array(x) for x in (queue, spot, n)))
        for d, a, k, p in zip(doc, first, length, place):
            for j in range(k):
                assert p + j not in got
                got[p + j] = (queue[d], spot[d] + a + j)
        assert [got[i] for i in range(len(stream))] == stream


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "'LL", "!", "<|endoftext|>", "<|", "日本", "🙂", "\x85", "\x1c", "\xa0", "\u3000", "ŉ", "ǆ", "the", " of"]), max_size=30))
def test_both_tokenizers_agree(parts):
    text = "".join(parts)
    assert ENCODE(text).tolist() == [*ENCODE.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_both_tokenizers_agree_on_code_points():
    assert ENCODE.fast is not None
    for c in (c for start in range(7) for c in range(start * 11, 0x110000, 1201) if not 0xD800 <= c < 0xE000):
        text = f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?  {chr(c)}\n{chr(c)} x"
        assert ENCODE(text).tolist() == [*ENCODE.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_blocks_of_a_page():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header>H</header><nav>N</nav><div class="cookie-notice">we use</div>
    <main><article><header><h1>T&eacute;&#33;</h1></header><p>a <b>b</b>c&nbsp;d<p>e<br>f<script>var x="</p>";</script><div class="comments"><p>nice</div><form>q</form></article></main>
    <aside>x</aside><footer>f</footer><!-- c --></body>"""
    only = lambda page: [(k, t) for k, t, _ in extract.regions(page)]
    assert only(page) == [("main", ["Té!", "a bc d", "e", "f"])]
    assert only("<p>one</p><div>two <i>three</i></div>") == [("open", ["one", "two three"])]
    assert only(None) == [] and only("") == [] and only("< < >")[0][1] == ["< < >"]
    assert only("<article>a" + "<b>x" * 2000) == [("main", ["a" + "x" * 2000])]
    assert only("<article><script>never closed <p>z") == []


def test_names_beside_others_are_weak_evidence():
    text = lambda page: extract.main_text(found := extract.regions(page), [None] * len(found))
    assert text('<article><p>Story.</p><p class="share-price">Price rose</p></article>') == "Story.\nPrice rose"
    assert text('<article><p>Story.</p><div class="related-work">Others did so</div></article>') == "Story.\nOthers did so"
    assert text('<article><p>Story.</p><div class="site-footer">x</div><div class="ad slot-3">y</div><p id="comments_list">z</p></article>') == "Story."
    story = "the story goes on and on for many more words than this"
    assert text(f"<article>a teaser</article><div>{story}</div>") == story
    assert text(f"<article><p>{story}</p></article><article>another one</article>") == f"{story}\nanother one"
    assert text("<main><h1>Title of story</h1><article><p>Body…</p></article></main>") == "Title of story\nBody…"
    assert text("<article><p>Intro…</p><article><p>Second update…</p></article><p>End.</p></article>") == "Intro…\nSecond update…\nEnd."
    assert text("") == "" and text(None) == ""


def test_covered_blocks_go_and_quotes_stay():
    words = [f"w{i}" for i in range(20)]
    article = [("main", [" ".join(words[:4]), " ".join(words[4:])], [False, False])]
    on = lambda *spots: np.array([i in spots for i in range(20)])
    assert extract.main_text(article, [on(0, 1, 2, 3, 9)]) == article[0][1][1]
    assert extract.main_text(article, [on(*range(20))]) == "\n".join(article[0][1])
    rest = [("open", *article[0][1:])]
    assert extract.main_text(rest, [on(0, 1, 2, 3, 9)]) == " ".join(words[4:9] + words[10:])
    weak = [("main", article[0][1], [False, True])]
    assert extract.main_text(weak, [on(9)]).split() == words[:9] + words[10:]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6), st.integers(0, 1000), st.integers(2, 3))
def test_suffix_intervals_find_every_repeat(streams, seed, least):
    r = random.Random(seed)
    common = [r.randrange(50) for _ in range(12)]
    streams = [s if i % 2 else s + common + s[:3] for i, s in enumerate(streams)]
    made = extract.Streams(np.concatenate([shingles.mix(np.array(s, np.uint64) + np.uint64(1)) for s in streams]), np.array([len(s) for s in streams]), np.full(len(streams), 5, np.uint64))
    h, at = made.anchors()
    x, owner = made.contexts(at), made.owner[at]
    _, once, which = np.unique(x["c"], return_index=True, return_inverse=True)
    bits = x["firsts"][:, None] >> np.arange(extract.REACH + 1) & 1
    held = np.zeros((len(once), extract.REACH + 1), np.int64)
    np.add.at(held, which, bits)
    on = extract.streams_holding(h[once], *(x[k][once] for k in ("context", "left", "right")), held) >= least
    masks = (on @ (1 << np.arange(extract.REACH + 1)))[which] if len(once) else np.empty(0, np.int64)
    got = [extract.covered_tokens(len(s), x["at"][owner == unit], masks[owner == unit]) for unit, s in enumerate(streams)]
    holds: dict = {}
    for unit, s in enumerate(streams):
        for i in range(len(s) - extract.DEPTH + 1):
            holds.setdefault(tuple(s[i : i + extract.DEPTH]), set()).add(unit)
    for unit, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - extract.DEPTH + 1):
            if len(holds[tuple(s[i : i + extract.DEPTH])]) >= least:
                want[i : i + extract.DEPTH] = True
        assert (got[unit] == want).all()


def test_digests_of_padded_payloads():
    for text, n in ((None, 64), ("", 64), ("a", 64), ("é" * 32, 64), ("x" * 65, 128)):
        size, payload = ogg.padded(text)
        assert len(payload) == n and payload[:size] == (text or "").encode() and not any(payload[size:])
    assert zlib.crc32(ogg.padded("abc")[1][-64:]) == zlib.crc32(b"abc" + bytes(61)) and hashlib.sha256(ogg.padded("")[1]).digest()
