"""Reconciliation tables derived from the order tables, with the blemishes that real statements have."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spec import FULL, LEFT, BaseSpec, FieldSpec, JobSpec, RefSpec

#: Orders run to the day before.
AS_OF = dt.datetime(2001, 8, 2)

BANK = RefSpec("Bank", "Invoice No", ("Priority", "Date", "Total"))
LEDGER = RefSpec("Ledger", "Ref", ("Customer", "Open Amount"))
BASE = BaseSpec("Invoice", "Date", "Amount")
FIELDS = (
    FieldSpec("Priority", {"SOA": "Priority", "Bank": "Priority"}, "Text"),
    FieldSpec("Value", {"SOA": "Amount", "Bank": "Total", "Ledger": "Open Amount"}, "Currency"),
    FieldSpec("Day", {"SOA": "Date", "Bank": "Date"}, "Date"),
)


def spec(how: str = LEFT, refs: tuple[RefSpec, ...] = (BANK, LEDGER)) -> JobSpec:
    return JobSpec(BASE, refs, FIELDS, how)


FULL_SPEC = spec(FULL)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer")
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement of account as text: keys, dates and amounts in several spellings."""
    k, text = F.col("k"), F.col("k").cast("string")
    plain = F.format_string("%.2f", "p")
    invoice = F.when(k % 4 == 0, F.lpad(text, 10, "0")).when(k % 4 == 1, F.concat(F.lit("'"), text)).when(k % 4 == 2, F.concat(text, F.lit(".0"))).otherwise(F.concat(F.lit("  "), text, F.lit(" ")))
    day = lambda f: F.date_format("d", f)
    date = F.when(k % 3 == 0, day("yyyy-MM-dd")).when(k % 3 == 1, day("dd/MM/yyyy")).otherwise(day("yyyy/MM/dd"))
    value = (
        F.when(k % 11 == 0, "").when(k % 11 == 1, "n/a").when(k % 11 == 2, F.concat(F.lit("("), plain, F.lit(")"))).when(k % 11 == 3, F.concat(F.lit("$"), F.format_number("p", 2))).when(k % 11 == 4, F.concat(plain, F.lit(" "))).otherwise(plain)
    )
    return _orders(spark, sf_dir).select(invoice.alias("Invoice"), date.alias("Date"), value.alias("Amount"), F.col("priority").alias("Priority"), F.col("customer").alias("Customer"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference with other amounts for some keys, and keys of its own."""
    k, p = F.col("k"), F.col("p")
    total = F.when(k % 5 == 1, F.round(p.cast("decimal(18,2)") * F.lit("0.95").cast("decimal(3,2)"), 2).cast("double")).when(k % 7 == 0, (p.cast("decimal(18,2)") + F.lit("12.34").cast("decimal(4,2)")).cast("double")).otherwise(p)
    date = F.when(k % 13 != 0, F.date_format(F.when(k % 9 == 0, F.date_add("d", 1)).otherwise(F.to_date("d")), "dd/MM/yyyy"))
    priority = F.when(k % 6 == 0, F.substring("priority", 3, 100)).when(k % 6 == 1, "OTHER").otherwise(F.col("priority"))
    orders = _orders(spark, sf_dir)
    own = orders.where(k % 10 != 0).select(k.cast("string").alias("Invoice No"), total.alias("Total"), date.alias("Date"), priority.alias("Priority"))
    extra = orders.where(k % 50 == 0).select((k + 10_000_000).cast("string").alias("Invoice No"), p.alias("Total"), F.date_format("d", "dd/MM/yyyy").alias("Date"), F.col("priority").alias("Priority"))
    return own.unionByName(extra)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference with repeated keys."""
    k = F.col("k")
    own = _orders(spark, sf_dir).where(k % 3 != 0)
    row = lambda amount: [k.alias("Ref"), amount.alias("Open Amount"), F.col("customer").alias("Customer")]
    return own.select(*row(F.col("p"))).unionByName(own.where(k % 20 == 1).select(*row(F.lit(0.0))))


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customer names, and a copy with other case and signs and, for two thirds, a digit lost."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    c, n = F.col("c_custkey"), F.col("c_name")
    changed = F.when(c % 3 == 0, F.upper(F.replace(n, F.lit("#"), F.lit("-")))).when(c % 3 == 1, F.concat(F.substring(n, F.lit(1), F.length(n) - 1))).otherwise(F.concat(F.substring(n, 1, 12), F.substring(n, F.lit(14), F.length(n))))
    return customers.select(n.alias("Name"), "c_custkey"), customers.select(changed.alias("Alias"), F.col("c_custkey").alias("Id"))


def titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Long names of parts, and short ones as people write them: some of the words in another order, or a piece with a typing error."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    k = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", "p_brand", F.lit("lot"), k.cast("string"), "p_type")
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    some = F.concat_ws(" ", k.cast("string"), F.upper(last), F.when(k % 2 == 0, first), F.lit("Lot"))
    # the middle of the title, with one sign replaced for every third part
    piece = F.substring(title, F.lit(3), F.length("p_name") + 5)
    piece = F.when(k % 3 == 0, F.concat(F.substring(piece, 1, 4), F.lit("~"), F.substring(piece, F.lit(6), F.length(piece)))).otherwise(piece)
    return parts.select(title.alias("Title"), "p_partkey"), parts.select(some.alias("Words"), piece.alias("Piece"), k.alias("Id"))
