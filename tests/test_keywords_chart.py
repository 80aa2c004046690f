"""Many keywords, accounts that change, and parsers of one's own."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.fields import rules
from quillspark.operators import categorize, chart, country, keywords

SF = "/root/testdata/sf0.001"
ACCOUNTS = "id int, name string, type string"


def theta(df, hay, listed):
    """The same by brute force: every text by every keyword."""
    rows = sorted((r["prio"], r["keyword"], r["category"]) for r in listed.collect())
    first = lambda t: next(((k, c) for _, k, c in rows if t is not None and k in t.lower()), (None, None))
    return [first(r["hay"]) for r in df.select(hay.alias("hay")).collect()]


def test_keywords_equal_the_theta_join(spark):
    accounts = categorize.seed_accounts(spark).filter("id % 4 > 0")
    parts = spark.read.parquet(f"{SF}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("hay"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").alias("hay"))
    for df in (parts, docs):
        words = df.select(F.explode(F.split(F.lower("hay"), "[^a-z]+")).alias("keyword")).distinct()
        cut = words.select(F.explode(F.array("keyword", F.substring("keyword", 2, 4), F.substring("keyword", 1, 3))).alias("keyword")).distinct()
        table = cut.withColumns({"prio": F.crc32("keyword") % 500, "account": F.get(F.array(*(F.lit(n) for n, _ in categorize.ACCOUNTS)), (F.crc32("keyword") % 17).cast("int"))})
        got = keywords.with_keyword(df, F.col("hay"), table, accounts).select("found.keyword", "found.category").collect()
        assert [tuple(r) for r in got] == theta(df, F.col("hay"), keywords.listed(table, accounts))


def test_the_rules_own_keywords(spark):
    accounts = categorize.seed_accounts(spark).filter("id <> 5")
    own = spark.createDataFrame(categorize.keywords(), "prio long, keyword string, account string")
    texts = [f"Una {k.upper()} y {j}" for (_, k, _), (_, j, _) in zip(categorize.keywords(), reversed(categorize.keywords()))] + ["", None, "nada", "spa ", "METRO"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("plain", categorize.keyword_category(F.col("text"), categorize.account_rows(accounts)))
    assert keywords.with_keyword(df, F.col("text"), own, accounts).filter("not (plain <=> found.category)").count() == 0


def test_keywords_of_any_kind(spark):
    accounts = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "b", "x")], ACCOUNTS)
    rows = [(2, "UNO", "a"), (1, "uno", "b"), (1, "dos", "a"), (1, "dos", "b"), (0, "tres", "nobody"), (5, "", "a"), (None, "cinco", "a"), (4, None, "a"), (9, "ñandú", "b"), (3, "un", "a")]
    table = spark.createDataFrame(rows, "prio long, keyword string, account string")
    df = spark.createDataFrame([(1, "Uno y DOS"), (2, "tres cinco"), (3, "el ÑANDÚ"), (4, None), (5, ""), (6, "un " + "x" * 300_000 + " uno")], "prio int, keyword string")
    got = {r["prio"]: tuple(r["f"]) for r in keywords.with_keyword(df, F.col("keyword"), table, accounts, "f").collect()}
    assert got == {1: ("dos", 1), 2: (None, None), 3: ("ñandú", 2), 4: (None, None), 5: (None, None), 6: ("uno", 2)}
    none = keywords.with_keyword(df, F.col("keyword"), table.filter("false"), accounts)
    assert {tuple(r["found"]) for r in none.collect()} == {(None, None)}
    assert keywords.with_keyword(df.filter("false"), F.col("keyword"), table, accounts).count() == 0
    assert keywords.deciding(["luz", "luzia", "a luz", "uz"]) == [0, 3]


def test_long_lists_cost_no_more_and_have_a_bound(spark, monkeypatch):
    accounts = categorize.seed_accounts(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").cache()
    docs.count()

    def took(n):
        table = spark.range(n).select(F.col("id").alias("prio"), F.concat(F.lit("wort"), F.md5(F.col("id").cast("string"))).alias("keyword"), F.lit("Caja").alias("account"))
        plan = keywords.with_keyword(docs, F.col("text"), table, accounts).select("found.category")
        plan.collect()
        began = time.time()
        plan.collect()
        return time.time() - began

    few, many = took(100), took(10_000)
    assert many < 4 * few + 2  # a hundred times as many keywords
    monkeypatch.setattr(keywords, "MOST_BYTES", 1000)
    with pytest.raises(ValueError):
        took(100)


def test_versions_and_as_of(spark):
    changes = spark.createDataFrame([(1, "a", "x", None), (1, "b", "x", "2024-02-01"), (1, "b", "x", "2024-03-01"), (1, "c", "x", "2024-04-01"), (1, "c", "y", "2024-04-01"), (2, "z", None, "2024-05-01"), (None, "q", "x", "2024-01-01")], "id int, name string, type string, since string").withColumn("since", F.col("since").cast("timestamp"))
    held = chart.versions(changes)
    show = lambda df: sorted(df.select("id", "name", "type", F.date_format("since", "M"), F.date_format("until", "M")).collect(), key=str)
    assert [tuple(r) for r in show(held)] == [(1, "a", "x", None, "2"), (1, "b", "x", "2", "4"), (1, "c", "y", "4", None), (2, "z", None, "5", None)]
    rows = [(1, "1999-01-01"), (1, "2024-02-01"), (1, "2024-03-31"), (1, "2024-04-01"), (1, None), (2, "2024-04-30"), (2, "2030-01-01"), (None, "2024-02-01"), (7, "2024-02-01")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id int, since string, name int")
    got = {r["name"]: (r["category_name"], r["category_type"]) for r in chart.as_of(df, held, "id", F.col("since")).collect()}
    assert got == {0: ("a", "x"), 1: ("b", "x"), 2: ("b", "x"), 3: ("c", "y"), 4: (None, None), 5: (None, None), 6: ("z", None), 7: (None, None), 8: (None, None)}
    assert sorted(r["name"] for r in chart.current(held).collect()) == ["c", "z"]
    assert chart.versions(changes.filter("false")).count() == 0


def test_seeding_twice_changes_nothing(spark):
    none = spark.createDataFrame([], chart.VERSION)
    seeds = categorize.seed_accounts(spark).select("name", "type").union(spark.createDataFrame([("Caja", "zzz"), (None, "expense")], "name string, type string"))
    at = F.lit("2024-01-01").cast("timestamp")
    once = chart.seeded(none, seeds, at)
    twice = chart.seeded(once, seeds, F.lit("2025-01-01").cast("timestamp"))
    rows = sorted(map(tuple, once.collect()), key=str)
    assert sorted(map(tuple, twice.collect()), key=str) == rows and len(rows) == len(categorize.ACCOUNTS)
    assert {(r[1], r[2]) for r in rows} == set(categorize.ACCOUNTS) and sorted(r[0] for r in rows) == list(range(1, 18))
    closed = once.withColumn("until", F.when(F.col("name") == "Caja", F.lit("2024-06-01").cast("timestamp")))
    again = chart.seeded(closed, seeds, F.lit("2025-01-01").cast("timestamp"))
    assert [(r["id"], r["since"].year) for r in again.filter("name = 'Caja' and until is null").collect()] == [(18, 2025)]


def test_a_third_parser(spark):
    star = country.Parser("estrella", lambda t: F.when(t.contains("ESTRELLA"), 0.9).when(t.contains("NULO"), F.lit(None).cast("double")).otherwise(0.1), lambda t, rows: F.struct(F.get(rows, 0).alias("vendor_name"), F.lit("XTS").alias("currency"), F.when(t.contains("mal"), "odd").alias("warning")), ("vendor_name", "currency"), warns=True)
    texts = ["Uno\nESTRELLA", "Dos\nESTRELLA mal", "SENIAT\nInversiones\nRIF: J-12345678-9", "SENIAT ESTRELLA", "dgi-fep.mef.gob.pa ESTRELLA", "NULO SENIAT", "nada", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("r", rules(F.col("text")))
    run = lambda *p: {r["id"]: r["fields"] for r in country.with_overlay(df, "r", "text", parsers=p).collect()}
    got = run(*country.PARSERS, star)
    assert [got[i]["parser"].split(" + ")[-1] for i in range(8)] == ["estrella", "estrella", "seniat", "seniat", "panama", "seniat", "generic", "generic"]
    assert (got[0]["vendor_name"], got[0]["currency"], got[0]["warnings"], got[1]["warnings"]) == ("Uno", "XTS", [], ["odd"])
    assert run(star, *country.PARSERS)[3]["parser"] == "generic + estrella"  # as sure: the one named first
    assert {r["parser"] for r in run().values()} == {"generic"}
