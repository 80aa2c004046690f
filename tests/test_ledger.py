"""Batches that come once, twice, or break off; requests and files that are refused."""

import os

from pyspark.sql import functions as F

from quillspark.sources import store
from quillspark.streaming.ledger import ACCEPTED, LOG, REJECTED, Ledger

GOOD = (5.0, "USD", "2024-01-02", "expense", "x", 1)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), store.REQUEST)


def test_judged(spark):
    rows = [GOOD, (0.0, "USD", "2024-01-02", "expense", None, 2), (None, "USD", "2024-01-02", "income", None, 3), (1.0, "", "2024-01-02", "income", None, 4), (1.0, None, "soon", "gift", None, 5), (1.0, "USD", "soon", "gift", None, 6), (1.0, "USD", None, "income", None, 7), (1.0, "USD", "2024-01-02", "gift", None, 8), (1.0, "USD", "2024-01-02", None, None, 9), (-3.5, "USD", "2024-01-02", "income", None, 10), (float("nan"), "USD", "2024-01-02", "income", None, 11), (1e15, "USD", "2024-01-02", "income", None, 12), GOOD]
    df = requests(spark, *rows).withColumn("reason", F.lit("mine"))
    got = store.judged(df)
    assert got.count() == 13 and sorted((r["category"], r["reason"]) for r in got.filter("reason is not null").collect()) == [(2, "amount"), (3, "amount"), (4, "currency"), (5, "currency"), (6, "date"), (7, "date"), (8, "type"), (9, "type"), (11, "amount"), (12, "amount")]
    assert sorted(r["category"] for r in store.transactions(df).collect()) == sorted(r["category"] for r in got.filter("reason is null").collect()) == [1, 1, 10]
    assert {r["request"] for r in got.filter("category = 8").collect()} == {'{"amount":1.0,"currency":"USD","date":"2024-01-02","type":"gift","category":8,"reason":"mine"}'}


def test_a_batch_counts_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), store.judged, store.JUDGED)
    assert ledger.rows().count() == ledger.rows(REJECTED).count() == ledger.log().count() == 0
    bad = (0.0, *GOOD[1:5], 2)
    ledger.write(requests(spark, GOOD, bad, bad), 0)
    ledger.write(requests(spark, GOOD, bad, bad), 0)  # comes again
    ledger.write(requests(spark).filter("false"), 1)  # empty
    assert sorted(map(tuple, ledger.log().select("batch", "accepted", "rejected").collect())) == [(0, 1, 2), (1, 0, 0)]
    judged = Ledger(spark, ledger.path, ledger.judge, ledger.schema)
    rows = store.judged(requests(spark, GOOD, GOOD, bad)).withColumn("state", F.lit(ACCEPTED))
    rows.write.partitionBy("state").parquet(f"{ledger.path}/rows/batch=2")  # an attempt that broke off before its log
    assert judged.rows().count() == 1
    judged.write(requests(spark, GOOD), 2)
    assert judged.rows().count() == 2 and judged.rows(REJECTED).count() == 2
    assert sorted((r["batch"], r["category"]) for r in judged.rows().collect()) == [(0, 1), (2, 1)]
    plan = judged.rows()._jdf.queryExecution().executedPlan().toString()
    assert "(state" in plan and "PartitionFilters" in plan


def test_a_stream_that_starts_again(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for k in range(3):
        requests(spark, *((1.0 * (n % 3), *GOOD[1:5], 10 * k + n) for n in range(6))).coalesce(1).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(store.REQUEST).option("maxFilesPerTrigger", 1).json(source)
    ledger = Ledger(spark, str(tmp_path / "ledger"), store.judged, store.JUDGED)
    ledger.run(stream(), check).awaitTermination()
    for name in os.listdir(f"{check}/commits"):  # the driver is lost between the last batch's log and its commit
        if name.strip(".").startswith("2"):
            os.remove(f"{check}/commits/{name}")
    ledger.run(stream(), check).awaitTermination()
    requests(spark, (2.0, *GOOD[1:5], 99)).write.mode("append").json(source)
    ledger.run(stream(), check).awaitTermination()
    assert sorted(r["category"] for r in ledger.rows().collect()) == sorted([10 * k + n for k in range(3) for n in range(6) if n % 3] + [99])
    assert sorted(r["category"] for r in ledger.rows(REJECTED).select(F.get_json_object("request", "$.category").cast("int").alias("category")).collect()) == [0, 3, 10, 13, 20, 23]
    assert ledger.log().agg(F.sum("accepted"), F.sum("rejected")).first()[:] == (13, 6) and LOG.startswith("batch")


def test_refused_files(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.PNG", 30), ("c.jpeg", 31), ("d.txt", 5), ("e", 5), ("f.pdf.exe", 99)):
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "x.pdf").mkdir()
    (tmp_path / "x.pdf" / "noending").write_bytes(b"y")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    refused = store.refused(files, 30)
    assert sorted((r["name"], r["reason"]) for r in refused.collect()) == [("c.jpeg", "size"), ("d.txt", "type"), ("e", "type"), ("f.pdf.exe", "type"), ("noending", "type")]
    assert sorted(r["name"] for r in store.accepted(files, 30).collect()) == ["a.pdf", "b.PNG"]
    assert "content" not in refused._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
