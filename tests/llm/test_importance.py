"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import importance


def features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, aims, longest=1, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, longest)[1]), Counter(bucket(f) for x in aims for f in features(x, longest)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for i, x in docs:
        n, fs = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "The", "of", "été", "ß9", "日本"]) + rng.choice(["", "s", "ing", str(rng.randrange(40))])
    docs = [(i, rng.choice([" ", ", ", "--", "\x7f"]).join(word() for _ in range(rng.choice([0, 1, 19, 20, 60, 300])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,;"), (203, "word " * 50_000), (None, "no id but words " * 9), (5, "again " * 30), (5, "again " * 30), (204, docs[3][1])]
    return docs, [word() + " " + word() for _ in range(30)] + [None, "", "the the ing"]


@pytest.mark.parametrize("how", [{}, {"longest": 3, "percent": 50}])
def test_equals_a_plain_loop(spark, how):
    docs, aims = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, slice int, score string").repartition(3)
    got = importance.resampling(df, spark.createDataFrame([(t,) for t in aims], "text string"), **how)
    assert got.columns == ["doc_id", "slice", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows), key=str) == brute(docs, aims, **how)


def test_drawn_documents(spark):
    docs, aims = corpus()
    want = {r[0] for r in brute(docs, aims) if r[4]}
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in aims], "text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resampling_digest(none, some).collect() == []
    assert sorted(map(tuple, importance.resampling_digest(some, none).collect())) == brute([(1, "a b")], [])
