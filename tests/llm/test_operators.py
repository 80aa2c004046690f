"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import chosen_path, components, containment, jpeg, language, pieces, run_index, steps, style_tree, toxicity, url_cascade
from quillspark.llm import textcodes as tc

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "rp", "sta", "vel", "")]
DOCS = "doc_id long, text string, score string, n long, sig string, kept string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 7, None, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 20, 120, 400]))) for i in range(60)]
    base = prose(rng, 200).split(" ")
    for i in range(60, 90):  # near copies
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(200)] = "EDIT%d" % rng.randrange(1000)
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[5][1]) for i in range(90, 95)]  # exact copies
    passage = prose(rng, 90)
    rows += [(i, prose(rng, 50) + " " + passage + " " + prose(rng, 30)) for i in range(95, 110)]
    rows += [(110, None), (111, ""), (112, " \t\n"), (113, "ab" * 2000), (114, "é" * 900), (115, "日本語" * 300), (116, prose(rng, 9000))]
    rows += [rows[70]]  # a repeated row
    return rows


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("leaf", [96, 4])
def test_near_duplicates(spark, corpus, leaf, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)  # small leaves: branching, blocks and later rounds take part
    monkeypatch.setattr(chosen_path, "BLOCK", 5 if leaf == 4 else 1024)
    monkeypatch.setattr(chosen_path, "SHINGLES", 500 if leaf == 4 else 1_000_000)
    got = chosen_path.near_duplicates(frame(spark, corpus), 4, 80).collect()
    want, sets = brute_components(corpus, 4, 80)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)
    assert chosen_path.near_duplicates(frame(spark, []), 4, 80).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\x01" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(spark, corpus, group, monkeypatch):
    monkeypatch.setattr(run_index, "GROUP", group)  # 1: all open anchors are resolved by hash
    rows = corpus
    got = run_index.repeat_digest(frame(spark, rows), 400).collect()
    want = brute_repeats(rows, 400)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))
    texts = dict(rows)
    for r in got:
        assert r.text == texts[r.doc_id] if not r.n_removed else len(r.text.encode()) <= r.n_bytes - r.n_removed
    assert run_index.repeat_digest(frame(spark, []), 400).count() == 0


def test_match_lengths():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (2, 2), (60, 2), (400, 3), (300, 1)):
        text = rng.integers(1, k + 1, n).astype(np.uint8)
        got = run_index.match_lengths(text)
        for i in range(n):
            best = 0
            for j in range(n):
                m = 0
                while i != j and i + m < n and j + m < n and text[i + m] == text[j + m]:
                    m += 1
                best = max(best, m)
            assert got[i] == best


def test_texts_without_repeats_keep_whole_characters(spark):
    common = "äöü" * 200
    rows = [(1, "x�" + common + "ß"), (2, "é" + common + "end"), (3, None), (4, "short")]
    got = {r.doc_id: r.text for r in run_index.texts_without_repeats(frame(spark, rows), 400).collect()}
    assert got == {1: "x�", 2: "éend", 3: None, 4: "short"}  # the first byte of ß ends a string that repeats


CLASHES = "nodes spans kept score predicted _keys _host row id rep component cell node n_bytes n_removed n_spans first end n sig"


def test_any_column_name(spark):
    """Columns that are named like inner ones come through as they are, also of rows without an id."""
    names = CLASHES.split()
    common = "same " * 100
    rows = [(1, common + "one", *names), (2, common + "two", *names), (None, common, *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = run_index.texts_without_repeats(docs, 400).collect()
    assert {r.doc_id: r.text for r in got} == {1: "one", 2: "two", None: "", 3: None}
    assert all(r[2:] == tuple(names) for r in got) and len(got) == 4
    near = {r.doc_id: (r.component_id, r.kept) for r in chosen_path.near_duplicates(docs, 4, 80).collect()}
    assert near == {1: (1, True), 2: (2, True), None: (None, True), 3: (3, True)}
    assert sorted((r.n_bytes, r.n_removed) for r in run_index.repeat_digest(docs, 400).collect() if r.doc_id is None) == [(500, 500)]


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats_among_rows_with_equal_and_null_ids(spark, group, monkeypatch):
    """Each row is a document of its own: nothing that comes once goes, whatever its id."""
    monkeypatch.setattr(run_index, "GROUP", group)
    rng = random.Random(5)
    p, q = prose(rng, 90), prose(rng, 120)
    rows = [(1, prose(rng, 80) + p), (1, prose(rng, 150)), (2, p + prose(rng, 70)), (None, p + prose(rng, 60)), (None, q + prose(rng, 20)), (3, prose(rng, 40) + q), (1, q), (4, prose(rng, 200)), (4, prose(rng, 200)), (None, prose(rng, 90)), (None, None)]
    rows += [rows[7], rows[9]]  # rows that repeat id and text repeat each other
    got = run_index.repeat_digest(frame(spark, rows), 400).collect()
    want = brute_repeats(rows, 400)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


def test_containment(spark, corpus):
    rng = random.Random(8)
    long = next(t for i, t in corpus if i == 116)
    items = [(0, " ".join(long.split()[4000:4040])), (1, prose(rng, 30)), (2, "kan1 lorp2"), (3, None), (4, ""), (5, long.split()[77].upper()), (0, " ".join(long.split()[10:60]))]
    edited = long.split()[5000:5060]
    edited[10] = "changed"
    items += [(6, " ".join(edited)), (7, " ".join(long.split()[100:103]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in containment.contained_items(frame(spark, corpus), bench).collect())
    want = []
    for d, t in corpus:
        w = words_of(t)
        for i, it in items:
            k = min(5, len(words_of(it)))
            s = shingle_set(it, 5)
            if s:
                same = len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
                if 100 * same >= 80 * len(s):
                    want.append((d, i, len(s), same))
    assert got == sorted(want) and got
    monkey = containment.BLOCK_ITEMS
    try:
        containment.BLOCK_ITEMS = 2
        assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in containment.contained_items(frame(spark, corpus), bench).collect()) == got
    finally:
        containment.BLOCK_ITEMS = monkey
    assert containment.contained_items(frame(spark, corpus), bench.limit(0)).count() == 0
    assert containment.contained_items(frame(spark, []), bench).count() == 0
    clean = containment.clean_documents(frame(spark, corpus), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in corpus} - {d for d, *_ in got}


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        bad = i % 5 == 0
        w = prose(rng, 30).split()
        if bad:
            w[rng.randrange(30)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad), "c"))
    rows += [(900, None), (901, ""), (5, rows[5][1])]
    labels += [(0, 1, None, "c"), (5, 1, 0, "c"), (77777, 1, 1, "c"), (None, 1, 1, "c")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity_digest(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id < 700]
    assert all(r.held_out for r in held) and len(held) > 100
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    empty = {r.doc_id: r.score for r in got if r.doc_id >= 900}
    assert empty[900] == empty[901] < 0.5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in toxicity.toxicity_digest(frame(spark, rows), lab.limit(0)).collect()} == {0}
    assert toxicity.toxicity_digest(frame(spark, []), lab).count() == 0
    full = toxicity.toxicity(frame(spark, rows[:3]), lab)
    assert full.columns == ["doc_id", "text", "n", "sig", "kept", "score", "predicted"]


def plain_ftrl(docs, labels, size, epochs):
    """FTRL-proximal with a loop over coordinates, the intercept without L1 and L2."""
    l1 = max(0.5, toxicity.L1_ROW * len(docs))
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(k):
        if k == size:
            return -z[k] / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA)
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(docs)):
            w = {int(k): weight(int(k)) for k in [*docs[i], size]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for k, old in w.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * old
                n[k] += g * g
    return [weight(k) for k in range(size + 1)]


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(3)
    docs = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(80)]
    labels = np.array([float(3 in d or 7 in d) for d in docs])
    got = toxicity.ftrl(docs, labels, 30, 3)
    assert np.allclose(got, plain_ftrl(docs, labels, 30, 3)) and 0 < np.count_nonzero(got[:-1]) < 30 and got[3] > 0 < got[7]


def test_groups_over_batches():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 12):
        batches = [pa.record_batch([pa.array(keys[i : i + size])], names=["k"]) for i in range(0, len(keys), size)]
        parts = [t.column("k").to_pylist() for t in steps.groups(batches, "k")]
        assert sum(parts, []) == keys and all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(steps.groups([], "k")) == []


def plain_viterbi(v, text):
    """Best segmentation by a table of pieces, without a trie."""
    known = {k: i for i, k in enumerate(v.keys)}
    most = max(map(len, v.keys))
    best, back = [(0.0, 0)] + [(-float("inf"), 0)] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        size = min(int(pieces._CHAR[text[i]]), len(text) - i)
        for j in range(i + 1, min(len(text), i + most) + 1):
            if text[i:j] in known and best[i][0] + v.scores[known[text[i:j]]] > best[j][0]:
                best[j], back[j] = (best[i][0] + v.scores[known[text[i:j]]], 0), (i, [int(v.ids[known[text[i:j]]])])
        if text[i : i + size] not in known and best[i][0] + v.unknown > best[i + size][0]:
            best[i + size], back[i + size] = (best[i][0] + v.unknown, 0), (i, [int(v.byte_id[b]) for b in text[i : i + size]])
    out, n = [], len(text)
    while n:
        i, ids = back[n]
        out, n = ids + out, i
    return out


PIECE_TEXTS = [None, "", " ", "\n", "hello world", "  two  spaces\n\nx ", "▁mark \U0001f600 日本語テキスト", "a" * 300, "x\ty\r\n", "naïve café ñandú", "\x00zero", "The quick brown fox."]


def test_pieces(spark):
    v = pieces.Vocabulary(pieces.default_model())
    rng = random.Random(2)
    texts = PIECE_TEXTS + [prose(rng, 50), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(400))]
    rows = list(enumerate(texts))
    enc = pieces.encode(frame(spark, rows))
    got = {r.doc_id: r for r in enc.collect()}
    for i, t in rows:
        spaced = b" " + t.encode() if t else b""
        want, at = [], 0
        _, _, starts, ends, _ = pieces.pretokens(*tc.column_bytes(pa.array([t])), v.alone)
        for s, e in zip(starts, ends):
            want += plain_viterbi(v, spaced[s:e])
        assert got[i].token_ids == want and got[i].n_tokens == len(want) and got[i].round_trip
    assert {r.doc_id: r.text for r in pieces.decode(enc).collect()} == {i: t or "" for i, t in rows}
    counts = {r.doc_id: r.n_tokens for r in pieces.token_counts(frame(spark, rows)).collect()}
    assert counts == {i: r.n_tokens for i, r in got.items()}
    digest = {r.doc_id: r for r in pieces.encoding_digest(frame(spark, rows)).collect()}
    assert all(d.round_trip and d.ids_sha256 == hashlib.sha256(np.array(got[i].token_ids, "<i4").tobytes()).hexdigest() for i, d in digest.items())
    assert pieces.encoding_digest(frame(spark, [])).count() == pieces.count_digest(frame(spark, [])).count() == 0


def test_pretokens_lose_nothing():
    """Cutting a text into pre-tokens leaves the best total score as it is."""
    v = pieces.Vocabulary(pieces.default_model())
    score = {int(i): s for i, s in zip(v.ids, v.scores)}
    text = (" " + prose(random.Random(5), 12) + "\n  x").encode()
    whole = pieces.viterbi_one(v, text)
    _, _, starts, ends, _ = pieces.pretokens(*tc.column_bytes(pa.array([text[1:].decode()])), v.alone)
    parts = [t for s, e in zip(starts, ends) for t in pieces.viterbi_one(v, text[s:e])]
    assert sum(score.get(t, v.unknown) for t in whole) == pytest.approx(sum(score.get(t, v.unknown) for t in parts))


class Slow(jpeg.Picture):
    """Reads all scans symbol by symbol."""

    def _scan(self, head, data):
        ids = {head[1 + 2 * i]: head[2 + 2 * i] for i in range(head[0])}
        self._symbols(list(ids), ids, head[-3], head[-2], head[-1] >> 4, head[-1] & 15, np.frombuffer(data, np.uint8))


def test_jpeg(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (64, 128, 384, 448, 64 * 95):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        made = jpeg.encode(payload)
        assert jpeg.Picture(made).payload() == payload == Slow(made).payload()
        assert (jpeg.Picture(made).rgb() == Slow(made).rgb()).all()
    monkeypatch.setattr(jpeg, "MOST_UNITS", 3)  # a wide picture
    payload = rng.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes()
    made = jpeg.encode(payload)
    assert jpeg.Picture(made).payload() == payload == Slow(made).payload()
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "é" * 5000), (6, "x" * 64)]
    table = steps.stored(jpeg.media(frame(spark, rows)), "media")
    got = {r.doc_id: r for r in jpeg.media_digest(table).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[1][2:] == got[4][2:] and got[2][1:] == got[3][1:]
    full = jpeg.tensors(table).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in full)
    for r in full:
        jpg = next(m.media for m in table.filter(f"doc_id = {r.doc_id}").collect())
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(jpg), hashlib.sha256(jpg).hexdigest())
    assert jpeg.media_digest(jpeg.media(frame(spark, []))).count() == 0


def test_idct_matches_the_definition():
    coef = np.zeros((1, 64), np.float32)
    coef[0, 5] = 100  # zigzag place 5: row 0, column 2
    u, v = divmod(int(jpeg.ZIGZAG[5]), 8)
    c = lambda k: np.sqrt(0.125) if k == 0 else 0.5
    want = [100 * c(u) * c(v) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for y in range(8) for x in range(8)]
    assert np.allclose((coef @ jpeg._KERNEL)[0], want, atol=1e-3)
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-1] == 63


def test_cross_parsing():
    """The table's phrases are the greedy longest matches in the sample."""
    rng = random.Random(6)
    sample = [rng.randrange(3) for _ in range(80)]
    table = language.automaton(sample, 5)
    inside = lambda p: any(sample[i : i + len(p)] == p for i in range(len(sample) - len(p) + 1))
    chunks = sorted(([rng.randrange(4) for _ in range(rng.randrange(1, 60))] for _ in range(20)), key=len, reverse=True)
    lengths = np.array([len(c) for c in chunks])
    got = language.phrases(table, 5, np.array(sum(chunks, []), np.int32), np.cumsum(lengths) - lengths, lengths)
    for c, n in zip(chunks, got):
        at = count = 0
        while at < len(c):
            end = at + 1
            while end < len(c) and inside(c[at : end + 1]):
                end += 1
            at, count = end, count + 1
        assert abs(n - count) <= c.count(3)  # a symbol outside the sample ends a phrase on both sides
        if 3 not in c:
            assert n == count


def test_language(spark):
    rng = random.Random(9)
    make = {"aa": lambda n: " ".join(rng.choice(["the", "of", "winter", "ship"]) for _ in range(n)), "bb": lambda n: " ".join(rng.choice(["der", "und", "größe", "schiff"]) for _ in range(n))}
    rows = [(i, make["aa" if i % 2 else "bb"](rng.randrange(3, 60)), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(300, None, "aa"), (301, "", None), (302, "123 !?", "bb"), (303, "the of " * 3000, None), (304, "日本", "aa")]
    docs = spark.createDataFrame([(*r, "q", "p") for r in rows], "doc_id long, text string, lang string, lang_pred string, sample string")
    got = {r.doc_id: r for r in language.language_digest(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert [got[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[304].lang_pred in ("aa", "bb")
    assert {r.lang_pred for r in language.language_digest(docs.filter("lang is null")).collect()} == {"und"}
    assert language.language_digest(docs.limit(0)).count() == 0


URLS = [
    "https://a.org/x", "http://ORG/", "http://evilorg/", "https://www.example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/1",
    "http://shop.com/fr/a?b", "http://shop.com/de/#x", "http://com/de/", "http://x.example.net/de/1", "http://m.tiontion.example.com/en/3", "no scheme", None, "", "://", "http://a.org", "http://a.org?x=/es/", "ftp://user@Example.ORG:80/es/", "http://a.org/" + "p" * 5000,
]


LISTED = ["example.net/de/", "m.tiontion.example.com/en/", "a.org/p", "nokey", None, "", "a.org/p"] + [f"site{i}.example.net/en/{i}" for i in range(400)]


def test_urls(spark):
    every = URLS * 2 + [f"https://{'www.' * (i % 2)}site{i}.example.net/en/{i + i % 3}x?ref={i}" for i in range(500)]
    rows = [(i, u, "v", "k", "x") for i, u in enumerate(every)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, key string, _keys string")
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    got = {r.page_id: r for r in url_cascade.filter_urls(pages, list(url_cascade.RULES), listed).collect()}

    def parsed(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        return host.lower(), re.match("[^?#]*", rest[len(host) :])[0]

    def verdict_of(host, path, keys):
        fits = lambda k: (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])
        rule = max((r for r in url_cascade.RULES if fits(r[1])), key=lambda r: len(r[1]), default=None)
        return rule and rule[1], rule[0] if rule else "block" if any(map(fits, keys)) else "allow"

    for i, u, *_ in rows:
        host, path = parsed(u)
        rule, verdict = verdict_of(host, path, [k for k in LISTED if k and "/" in k])
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].key, got[i]._keys) == (host, path, rule, verdict, "k", "x")
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}
    keys = {"".join(parsed(u)) for u in every if u and "ref=" in u}
    for r in url_cascade.url_digest(pages).collect():
        assert (r.rule, r.verdict) == verdict_of(r.host, r.path, keys)
    assert url_cascade.url_digest(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_cascade.filter_urls(pages, [], listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_with_wrong_filters(spark):
    """With a list large beside the universe, several levels are needed."""
    listed = spark.range(0, 300).selectExpr("concat('k', id) key")
    universe = spark.range(0, 3000).selectExpr("concat('k', id) key")
    made = url_cascade.Cascade.build(listed, universe)
    assert len(made.levels) > 2
    got = universe.select("key", made.holds(universe.key).alias("held")).collect()
    assert all(r.held == (int(r.key[1:]) < 300) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page">
<header class="site-header">Site</header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">OK?</div>
<article><header><h1>Head &amp; {0}</h1></header><p><b>First&nbsp;&lt;one&gt;<br>more<p>Second
 line {0}<aside>side</aside><form><input>f</form><footer>foot</footer><div class="comments"><p>reader</p></div></article>
<aside class="sidebar">links</aside><!-- c <p>x</p> --><footer>&copy; x"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(i)) for i in range(12)]
    rows += [(20, "http://h0.com/", None), (21, None, "plain  text"), (22, "http://h9.com/", ""), (23, "http://h9.com/", "<p>a<p>b</div>c &am; <li>d"), (24, "x", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "t", "n") for r in rows], "page_id long, url string, html string, text string, nodes string")
    got = {r.page_id: r.text for r in style_tree.page_digest(pages).collect()}
    for i in range(12):
        assert got[i] == f"Head & {i}\nFirst <one> more\nSecond line {i}"
    assert [got[i] for i in range(20, 25)] == ["", "plain text", "", "a\nbc &am;\nd", "deep"]  # an end tag without its start is no mark
    assert style_tree.page_digest(pages.limit(0)).count() == 0


def test_style_tree_drops_what_a_site_repeats(spark):
    """Without landmarks or telling names, the tree alone finds the boilerplate of a site."""
    rng = random.Random(4)
    page = "<body><div class=c1><p>Daily Herald</p><p>World Sport Money</p></div><div class=c2><p>{}</p><p>{}</p></div><div class=c3><p>All rights kept</p></div>"
    texts = [(prose(rng, 12), prose(rng, 12)) for _ in range(30)]
    pages = spark.createDataFrame([(i, "http://s.com/", page.format(*t)) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.main_texts(pages).collect()}
    assert got == {i: "\n".join(t) for i, t in enumerate(texts)}
    tree = style_tree.site_trees(pages.selectExpr("'s.com' host", "html")).collect()[0].nodes
    paths = {n.name: n.path for n in style_tree._walk(style_tree.parse(page))}
    of = {n.name: n.kids[0].path for n in style_tree._walk(style_tree.parse(page)) if n.name in ("c2", "c3")}
    assert tree[of["c3"]] == pytest.approx(0) and of["c2"] not in tree and tree[paths["c2"]] == pytest.approx(0)


def test_character_references():
    assert html.unescape("&amp;&#233;") == "&é"


@pytest.mark.parametrize("k", [1, 4, 5])
def test_gram_codes(k):
    rng = random.Random(k)
    texts = [prose(rng, n) for n in (0, 1, 3, 4, 5, 30)] + [None, "Ab aB"]
    codes, bounds = tc.gram_codes(tc.Words(*tc.column_bytes(pa.array(texts))), k)
    seen = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
        assert bounds[i + 1] - bounds[i] == len(want)
        for code, gram in zip(codes[bounds[i] : bounds[i + 1]].tolist(), want):
            assert seen.setdefault(gram, code) == code
    assert len(set(seen.values())) == len(seen)
