"""Rules, patterns and answers that are computed where they are read, and as often."""

import re

from pyspark.sql import functions as F

from quillspark import queries as q
from quillspark.functions import fields
from quillspark.functions.rx import first, folded, has, lines, rx
from quillspark.operators import categorize, structure

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_fields_that_are_read(spark):
    """Fewer patterns in the plan, and the same values as of all rules."""
    texts = ["Emisor: Ana SA\nRUC: 8-1-2\nTotal: 1,234.56", "Tienda\nCliente: Bo\nNIT: 900-1\nIVA exento\n2024-01-02\nSubtotal: 5.00", "", "IVA 7%: 0.70\nFactura Nro: F-12345\nefectivo"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    some = [("amount", "vendor_name", "currency"), ("tax",), ("currency",), ("pct", "vendor_ids", "items")]
    for r in df.select(fields.rules(t).alias("all"), *(fields.rules(t, only).alias(f"r{i}") for i, only in enumerate(some))).collect():
        assert all(list(r[f"r{i}"].asDict()) == list(only) and all(r[f"r{i}"][f] == r["all"][f] for f in only) for i, only in enumerate(some))
    count = lambda c: plan(df.select(c.alias("c"))).count("regexp_extract")
    assert 2 * count(fields.rules(t, ("amount", "vendor_name"))) < count(fields.rules(t))
    paid = "pago\\s+m"
    assert paid not in plan(q.ai_merge_all(spark, DATA)) and paid not in plan(q.provider_chain(spark, DATA)) and paid in plan(df.select(fields.rules(t)))


def test_edges_of_words(spark):
    """A word's beginning is looked for behind its first letter, and is the same."""
    assert rx(r"\btotal\b", "") == r"t(?<!\wt)otal(?!\w)" and rx(r"\bx*y", "") == r"(?<!\w)x*y"
    texts = ["total", "subtotal total", "_total", "étotal", "TOTAL", "x-total", "\ntotal\r\n", "ſtotal", "total2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(has(F.col("t"), r"\btotal\b").alias("h"), first(F.col("t"), r"\b(total)\b").alias("f")).collect()
    want = [bool(re.search(r"(?a:\btotal\b)", t, re.I)) for t in texts]
    assert [r.h for r in got] == want and [r.f is not None for r in got] == want


def test_folds_and_lines(spark):
    texts = ["A  b\n\n c\td", " x ", "\r\n\r\ny\r", "İI ß É", "a\r\r\nb", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(folded(F.col("t")).alias("f"), lines(F.col("t")).alias("l"), F.regexp_replace(F.lower(F.upper(F.replace("t", F.lit("İ"), F.lit("i")))), r"\s+", " ").alias("f0"), F.split("t", "\r?\n", -1).alias("l0")).collect()
    assert [(r.f, r.l) for r in got] == [(r.f0, r.l0) for r in got]


def test_every_keyword_passes_the_gate(spark):
    accounts = [(i, n, t) for i, (n, t) in enumerate(categorize.ACCOUNTS, 1)]
    ids = {n: i for i, n, _ in accounts}
    words = categorize.keywords()
    df = spark.createDataFrame([(i, f"x{w.upper()}y") for i, w, _ in words] + [(-1, "no such thing")], "i int, t string")
    got = {r.i: r.c for r in df.select("i", categorize.keyword_category(F.col("t"), accounts).alias("c")).collect()}
    first_in = lambda text: next(ids[n] for _, w, n in words if w in text)
    assert got == {-1: None} | {i: first_in(f"x{w.upper()}y".lower()) for i, w, _ in words}
    assert "RLIKE" in plan(df.select(categorize.keyword_category(F.col("t"), accounts).alias("c")))


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([('{"amount": 1.5, "currency": "eur", "accountId": "2"}',), ("{",)], "a string")
    out = df.select(structure.parse_answer(F.col("a"), [(2, "Two", "expense")]).alias("r"))
    assert plan(out).count("parseJson") == 1
    assert [(r.r.amount, r.r.currency, r.r.category, r.r.type) for r in out.collect()] == [(1.5, "EUR", 2, "expense"), (None, None, None, "expense")]
