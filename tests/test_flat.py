"""Patterns over a text in one case: fewer that compare two cases, and the same finds."""

import re

from pyspark.sql import functions as F

from quillspark.functions import fields
from quillspark.functions.rx import any_of, first, flat, low_rx, place
from quillspark.operators import categorize, structure


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_patterns_compare_cases(spark):
    df = spark.createDataFrame([("x",)], "text string")
    count = lambda c: plan(df.select(c.alias("c"))).count("(?iu)")
    assert count(fields.rules(F.col("text"))) < 60 and count(structure.mock(F.col("text"))) == 0


def test_same_finds(spark):
    texts = ["Total A PAGAR: 1.00", "SUB  total: 2,50", "Café TOTAL: 3.00", "ſubtotal İva ıva 4.00", "😀 Cliente: Ana 😀\nTotal 5.00", "", "ﬁn ß total 6.00", "K TOTAL\n7.00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    pattern = r"(?:\b(?:iva|TOTAL)\b)\D*([\d.,]+)"
    got = df.select(first(flat(F.col("t")), low_rx(pattern), 1, "").alias("f"), (F.length(flat(F.col("t"))) == F.length("t")).alias("same"), place(flat(F.col("t")), "cliente").alias("at")).collect()
    assert [r.f for r in got] == [(m := re.search(pattern, t, re.I | re.A)) and m[1] for t in texts]
    assert all(r.same for r in got) and got[4].at == 3
    split = df.filter("i = 4").select(fields.customer_split(F.concat(F.lit("a\r\nb\r\n"), F.col("t"))).alias("s")).first().s
    assert (split.before, split.after) == ("a\nb", "😀 Cliente: Ana 😀\nTotal 5.00")


def test_any_of(spark):
    words = [w for _, w, _ in categorize.keywords()] + ["b/.", "us$", "€", "c.i", "x"]
    found = re.compile(any_of(words))
    assert all(found.search(f" {w}")[0] in words for w in words) and not found.search("b/ us c-i 12 zzz")
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert df.filter(~F.col("w").rlike(any_of(words))).count() == 0


def test_tax_of_the_first_line_that_tells(spark):
    texts = ["iva\nITBMS x\nTax 3% 4.00\niva 5.00", "IVA exento\niva 2.00", "siva 1.00\r\nVat: 7%\r\n", "IMPUESTO 9.00"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fields.tax(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [4.0, 0.0, None, 9.0]


def test_the_merge_computes_what_it_takes(spark):
    """An amount that the mock reads isn't sought by the rules: here they would fail."""
    df = spark.createDataFrame([(1.5,), (None,)], "a double")
    fails = F.raise_error("sought").cast("double")
    got = structure.merge({"amount": F.when(F.col("a").isNull(), 2.0).otherwise(fails)}, {"amount": F.col("a")})
    assert [r.x for r in df.select(got["amount"].alias("x")).collect()] == [1.5, 2.0]
