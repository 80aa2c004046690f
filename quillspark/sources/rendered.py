"""Receipts as text, made from the order tables: what goes in is known, so what is read from them can be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import dealt_once

RATES = (0, 7, 16, 21)  #: percent, by order key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: Column) -> Column:
    return F.floor(price * 100 + 0.5).cast("long")


def us(value: Column) -> Column:
    """Cents as 1,234.56."""
    return F.format_number((value.cast("decimal(18,0)") / 100).cast("decimal(18,2)"), 2)


def eu(value: Column) -> Column:
    return F.translate(us(value), ",.", ".,")


def _orders(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), cents(F.col("l_extendedprice")).alias("cents"))
    lines = line.repartition(parts, "id").groupBy("id").agg(F.sum("cents").alias("sub"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "qty", "cents"))).alias("lines"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    name = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    named = order.join(name, F.col("o_custkey") == F.col("c_custkey")).withColumn("id", F.col("k").cast("string"))
    return named.join(lines, "id").select("id", "k", "o_custkey", "c_name", "c_nationkey", "day", "sub", "lines")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, c_name, day, sub, pct, tax, total (in cents) and the lines of each order that has any, gathered once a session.

    Lines move once, as narrow rows, to their order's task; order and customer are joined before they follow.  Rows stay dealt by id."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # text rules cost far more CPU than the bytes suggest
    out = dealt_once(spark, "orders", sf_dir, "id", parts, lambda parts: _orders(spark, sf_dir, parts))
    out = out.withColumn("pct", F.element_at(F.array(*map(F.lit, RATES)), (F.col("k") % 4 + 1).cast("int")))
    out = out.withColumn("tax", F.floor((F.col("sub") * F.col("pct") + 50) / 100).cast("long"))
    return out.select("id", "k", "o_custkey", "c_name", "c_nationkey", "day", "sub", "pct", "tax", (F.col("sub") + F.col("tax")).alias("total"), "lines")


def one(value: Column) -> Column:
    """A generator of one row: the optimizer computes the value there and does not copy it into each of the many expressions that read it."""
    return F.explode(F.array(value))


def date_text() -> Column:
    day, k = F.col("day"), F.col("k") % 5
    months = F.array(*map(F.lit, ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")))
    named = F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), F.element_at(months, F.month(day)), F.lit(" de "), F.year(day).cast("string"))
    return F.when(k == 0, F.concat(F.lit("Fecha: "), F.date_format(day, "dd/MM/yyyy"))).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "d-M-yyyy")).when(k == 3, named).otherwise(F.concat(F.lit("fecha "), F.date_format(day, "d - M - yyyy")))


def item_lines() -> Column:
    return F.transform("lines", lambda x: F.concat(F.lit("Pieza modelo "), x["l_partkey"].cast("string"), F.lit("  "), x["qty"].cast("string"), F.lit("  "), us(F.floor(x["cents"] / x["qty"]).cast("long")), F.lit("  "), us(x["cents"])))


def pay_text() -> Column:
    k = F.col("k") % 4
    return F.when(k == 0, "Pagado con tarjeta").when(k == 1, "Pago en efectivo").when(k == 2, "Pago por transferencia").otherwise("Gracias por su compra")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic receipts: the orders with their text, rendered where it is read.

    Texts are ten times the bytes that they are made of, so they are neither shuffled nor written."""
    k = F.col("k")
    head = F.concat(F.lit("Almacenes Unidos "), (k % 97).cast("string"))
    tax_line = F.when(F.col("tax") == 0, "IVA exento").otherwise(F.concat(F.lit("IVA "), F.col("pct").cast("string"), F.lit("%: "), us(F.col("tax"))))
    label = F.element_at(F.array(*map(F.lit, ("Total a pagar: ", "TOTAL: ", "Importe total: ", "Grand Total: "))), (F.floor(k / 4) % 4 + 1).cast("int"))
    text = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("RUC: 155"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("-2-"), (k % 2000).cast("string")),
        F.concat(F.lit("Factura Nro: F-"), F.lpad(k.cast("string"), 9, "0")),
        date_text(),
        F.concat(F.lit("Cliente: "), F.col("c_name")),
        F.concat(F.lit("NIT: 900"), F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0"), F.lit("-1")),
        F.array_join(item_lines(), "\n"),
        F.concat(F.lit("Subtotal: "), us(F.col("sub"))),
        tax_line,
        F.concat(label, us(F.col("total"))),
        pay_text(),
    )
    return orders(spark, sf_dir).select("*", one(text).alias("text"))


def country_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of three countries, by key: generic, Panama's, Venezuela's."""
    k = F.col("k")
    panama = F.concat_ws(
        "\n", F.lit("Comprobante Auxiliar de Factura Electrónica"), F.concat(F.lit("Emisor: Bodega Canal "), (k % 50).cast("string")), F.concat(F.lit("RUC: 8-"), (k % 1000 + 100).cast("string"), F.lit("-"), k.cast("string")), F.lit("Tipo de Receptor: Contribuyente"),
        F.concat(F.lit("Cliente: "), F.col("c_name")), F.concat(F.lit("RUC/Cédula/Pasaporte: 4-77-"), F.col("o_custkey").cast("string")), F.concat(F.lit("Número: 000"), (k + 1).cast("string")), F.concat(F.lit("Fecha de Emisión: "), F.date_format("day", "dd/MM/yyyy")),
        F.concat(F.lit("Total Neto: "), us(F.col("sub"))), F.concat(F.lit("ITBMS "), us(F.col("tax"))), F.concat(F.lit("TOTAL PAGADO\n"), us(F.col("total"))), F.lit("Efectivo"),
    )
    seniat = F.concat_ws(
        "\n", F.lit("SENIAT"), F.concat(F.lit("Inversiones Orinoco "), (k % 50).cast("string")), F.concat(F.lit("RIF J-"), F.lpad((k % 100000000).cast("string"), 8, "3"), F.lit("-5")), F.concat(F.lit("FACTURA A"), F.lpad(k.cast("string"), 8, "0")),
        F.concat(F.lit("Fecha: "), F.date_format("day", "dd-MM-yyyy")), F.concat(F.lit("SUBTOTAL Bs "), eu(F.col("sub"))), F.concat(F.lit("TOTAL Bs "), eu(F.col("total"))),
    )
    plain = F.concat_ws("\n", F.concat(F.lit("Tienda Central "), (k % 50).cast("string")), F.concat(F.lit("Total: "), us(F.col("total"))), F.lit("USD"))
    text = F.when(k % 3 == 0, plain).when(k % 3 == 1, panama).otherwise(seniat)
    return orders(spark, sf_dir).select("*", one(text).alias("text"))
