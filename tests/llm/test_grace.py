"""Exact deduplication against a plain loop."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import grace


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and the number of rows that stay."""
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=str), len(groups)


ROWS = [(i, f"text {i % 7}  of\tmany\n") for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " "), (103, "\t\r\n "), (104, "x" * 300_000), (105, "x" * 300_000), (None, "text 3 of many "), (None, "no id"), (None, "no id"), (7, "text 0 of many "), (7, "text 0 of many "), (106, "é é"), (107, "é é"), (108, "a\x00b")]


@pytest.mark.parametrize("how", [{}, {"table_bytes": 40}, {"table_bytes": 40, "code": lambda c: F.length(c).cast("long") % 3}])
def test_equals_a_plain_loop(spark, how):
    """Also where every cell is dealt again, and where many texts share a hash."""
    df = spark.createDataFrame([(i, t, "c", "m") for i, t in ROWS], "doc_id long, text string, cell string, `my member` string").repartition(5)
    got = grace.exact_duplicates(df, **how)
    assert got.columns == ["doc_id", "cell", "my member", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    want, n_groups = brute(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert {r["my member"] for r in rows} == {"m"}


def test_full_tables_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(grace, "TASK_BYTES", 50)
    batch = spark.createDataFrame(ROWS, "doc_id long, text string")
    texts = batch.select("doc_id", F.struct("doc_id").alias("member"), F.xxhash64(grace.normal_text()).alias("code"), grace.normal_text().cast("binary").alias("text")).toArrow().to_batches()
    monkeypatch.setattr(grace.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    out = list(grace._together(texts))
    assert len(out) > 10 and sum(sum(b.column("n").to_pylist()) for b in out) == len(ROWS)
    numbers = [i for b in out for i in b.column("number").to_pylist()]
    assert len(set(numbers)) == len(numbers) and min(numbers) == 3 << 32


def test_documents_that_stay(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, _id int")
    got = [tuple(r) for r in grace.without_copies(df).collect()]
    assert len(got) == brute(ROWS)[1] and (104, "x" * 300_000, 1) in got and (0, "text 0  of\tmany\n", 1) in got


def test_empty(spark):
    assert grace.copies_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
