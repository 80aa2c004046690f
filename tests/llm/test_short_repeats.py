"""Repeated passages of short words in the pipeline."""

import random

import corpus_pipeline

from .test_operators import prose


def test_repeats_of_fifty_one_short_words_go(spark):
    rng = random.Random(8)
    passage, chance = " ".join(rng.choice("abcdefghij") for _ in range(51)), prose(rng, 18)
    assert len(passage) == 101 and 101 <= len(chance) < 240
    own = [prose(rng, 30) for _ in range(4)]
    rows = [(1, f"{own[0]}; {passage}. {own[1]}"), (2, passage), (3, f"{own[2]}; {chance}. {own[3]}"), (4, chance), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {1: f"{own[0]}; . {own[1]}", 2: "", 3: rows[2][1], 4: chance, 5: None}
