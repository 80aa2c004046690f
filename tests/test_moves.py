"""What the receipt queries move and how often they compute a thing, by their plans."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from quillspark import queries as q
from quillspark.functions import candidates
from quillspark.operators import categorize
from quillspark.plans import intake

DATA = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_texts_stay_where_they_are(spark):
    """Rendered texts are neither written nor shuffled, and joins of receipts by id move nothing."""
    rows = q.receipts(spark, DATA)
    joined = rows.select("id", "text").join(rows.select("id", "k").hint("merge"), "id")
    assert "Exchange" not in plan(rows) and "Exchange" not in plan(joined)
    assert "text" not in q.orders(spark, DATA).columns and rows.count() == rows.select("id").distinct().count() > 1000


def test_accounts_go_to_the_rows(spark):
    """Rows of one category, here all, don't meet in one task."""
    shown = plan(categorize.with_account(spark.range(9).withColumn("category", (F.col("id") % 3).cast("int")), categorize.seed_accounts(spark)))
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_labels_and_marks_are_looked_for_once(spark):
    """The number of patterns in a plan: one for each label, not all of them for each label."""
    rows = spark.createDataFrame([("x",)], "text string")
    count = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("regexp_extract")
    text = F.col("text")
    assert count(candidates.vendor_candidates(text)) < 12 and count(candidates.customer_candidates(text)) < 16
    shown = rows.select(candidates.classified_ids(text).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("Datos del") == 1


def test_labels_by_their_words(spark):
    """Each label is found with odd case and white space, as its words are looked for in the folded text."""
    texts = ["RUC \n CLIENTE: 12-3", "nit\tcliente 900", "C.I. 1234567", "ci: 1234567", "CLÍENTE: Ana", "Billed\n To : Bo", "SOLD  TO: Cy", "adquirente: Di", "RAZÓN SOCIAL: Ef", "NÚMERO: 7", "direccion: x", "ruc/cédula/pasaporte: 4-7", "Fecha de Emision: 1/2"]
    got = [set(r.c) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(candidates.labeled_fields(F.col("t")).alias("c")).collect()]
    want = ["RUC Cliente", "NIT Cliente", "C.I.", "C.I.", "Cliente", "Bill To", "Sold To", "Adquiriente", "Razón Social", "Número", "Dirección", "RUC_Cédula_Pasaporte", "Fecha de Emisión"]
    assert [w in g for w, g in zip(want, got, strict=True)] == [True] * len(want)


def test_pages_go_with_their_lines(spark):
    """Word boxes are lines before pages are gathered."""
    docs = spark.createDataFrame([("a", "image/png", None)], "id string, mime string, embedded string")
    pages = spark.createDataFrame([("a", 1, "x", 0.5, [("w", 0.9, 0.0, 0.0, 10.0, 12.0)])], "id string, page int, text string, confidence double, words array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>")
    out = intake.texts(docs, pages)
    shown = plan(out)
    assert out.first().layout_lines == ["w"] and shown.rindex("ArrowEvalPython") > shown.rindex("SortAggregate(key=[id" if "SortAggregate(key=[id" in shown else "Aggregate(keys=[id")
