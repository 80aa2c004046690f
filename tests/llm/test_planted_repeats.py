"""Which planted passages of over 50 words op10_suffix_dedup takes: its contract counts bytes, not words."""

import random

import corpus_pipeline as pipeline
from quillspark.llm import run_index

from .test_operators import frame, prose


def test_planted_passages_go_from_400_bytes_on(spark):
    rng = random.Random(12)
    short, long = (prose(rng, 90)[:n] for n in (399, 400))
    assert [len(p.encode()) for p in (short, long)] == [399, 400] and min(len(p.split()) for p in (short, long)) > 50
    own = [prose(rng, 40) for _ in range(8)]
    passages = {1: short, 2: short, 3: long, 4: long}
    around = {i: (own[2 * i - 2] + str(i), str(i) + own[2 * i - 1]) for i in passages}  # no byte around a passage repeats with it
    rows = [(i, p.join(around[i])) for i, p in passages.items()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.text) for r in run_index.repeat_digest(frame(spark, rows), 400).collect()}
    texts = dict(rows)
    assert got == {i: (len(texts[i]), 400, 1, "".join(around[i])) if i > 2 else (len(texts[i]), 0, 0, texts[i]) for i in passages}
    cut = pipeline.cut_repeats(spark, frame(spark, rows), "")  # which counts words as well
    assert {r.doc_id: r.text for r in cut.collect()} == {i: "".join(around[i]) for i in passages}
