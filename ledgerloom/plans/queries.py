"""Every operator of the engine as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import compare, discrepancy, fuzzy, insights, match, reports
from ..sources import readers
from ..sources.spec import FULL, RefSpec
from ..sources.tables import observed, shared_dir, written
from . import derived as D
from .reconcile import reconcile


def _refs(spark: SparkSession, sf_dir: str, n: int = 2) -> list:
    return [(D.BANK, D.bank(spark, sf_dir)), (D.LEDGER, D.ledger(spark, sf_dir))][:n]


def _detail(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    return match.detail(D.spec(how), D.base(spark, sf_dir), _refs(spark, sf_dir), D.AS_OF)


def _report(spark: SparkSession, sf_dir: str, how: str = "left", n: int = 2, keep: bool = False) -> DataFrame:
    refs = _refs(spark, sf_dir, n)
    return discrepancy.discrepancies(D.spec(how, tuple(r for r, _ in refs)), D.base(spark, sf_dir), refs, keep_matches=keep)


def clean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.base(spark, sf_dir).select("Invoice", V.clean_key(F.col("Invoice")).alias("key"))


def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.base(spark, sf_dir).select("Invoice", "Amount", V.parse_amount(F.col("Amount")).alias("amount_value"), V.parse_amount(F.col("Amount"), accounting=False, inner_space=False).alias("aging_value"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.base(spark, sf_dir).select("Invoice", "Date", F.date_format(V.parse_date(F.col("Date")), "yyyy-MM-dd").alias("day"))


def age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = V.age_days(V.parse_date(F.col("Date")), D.AS_OF)
    return D.base(spark, sf_dir).select("Invoice", days.alias("days"), V.age_bucket(days).alias("bucket"))


def date_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", V.date_text(F.when(F.col("l_linenumber") != 2, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))).alias("ship_date"))


def canonical_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.base(spark, sf_dir).select("Invoice", V.canonical_date(F.col("Date")).alias("date_literal"), V.canonical_text(F.lower(F.col("Priority"))).alias("text_literal"))


def strict_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset, _ = readers.strict_subset(D.bank(spark, sf_dir), RefSpec("Bank", "Invoice No", ("Priority",)))
    return readers.prefixed(subset, "Bank")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a job that goes on without a reference whose key column is missing."""
    broken = RefSpec("Broken", "No Such Column", ("Total",))
    spec = D.spec(refs=(broken, D.LEDGER))
    done = reconcile(spec, D.base(spark, sf_dir), {"Broken": D.bank(spark, sf_dir), "Ledger": D.ledger(spark, sf_dir)}, D.AS_OF)
    return done.detail.groupBy("Match Source").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("Duplicate Summary").startswith("Broken: no entry"), 1)).alias("n_without")).crossJoin(F.broadcast(done.issues))


def detail_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir)


def detail_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir, FULL)


def _hot(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """A third of the base has no key, as has one row of each reference, so one key holds a third of the rows."""
    lose = lambda df, c, when: df.withColumn(c, F.when(~when, F.col(c)))
    base = lose(D.base(spark, sf_dir), "Invoice", F.col("Customer").cast("long") % 3 == 0)
    bank = lose(D.bank(spark, sf_dir), "Invoice No", F.col("Invoice No") == "1")
    view = match.detail(D.spec(how), base, [(D.BANK, bank), (D.LEDGER, D.ledger(spark, sf_dir))], D.AS_OF, heavy_rows=1000)
    return view.groupBy(F.col("Invoice").isNull().alias("no_key"), "Bank_Match_Count", "Ledger_Match_Count", "Bank_Date").agg(F.count("*").alias("n_rows"))


def detail_left_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, "left")


def detail_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail view from tables that are written once in buckets by key."""
    return match.detail(D.spec(), D.base(spark, sf_dir), _refs(spark, sf_dir), D.AS_OF, buckets=8)


def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir).groupBy("Bank_Match_Count", "Ledger_Match_Count").agg(F.count("*").alias("n_rows"))


def match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir, FULL).groupBy("Match Source").agg(F.count("*").alias("n_rows"))


def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir).groupBy("Duplicate Summary").agg(F.count("*").alias("n_rows"))


def exact_join_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return match.exact_join(orders, [("Lines", lines, "o_orderkey", "l_orderkey")])


def missing_in_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.missing_in_ref(D.base(spark, sf_dir), "Invoice", D.bank(spark, sf_dir), "Invoice No")


def missing_in_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.missing_in_ref(D.bank(spark, sf_dir), "Invoice No", D.base(spark, sf_dir), "Invoice")


def found_in_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.found_in_ref(D.base(spark, sf_dir), "Invoice", D.ledger(spark, sf_dir), "Ref")


def disc_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a reference: up to thirteen entries for a key."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_extendedprice").alias("Line Total"))
    spec = D.spec(FULL, (RefSpec("Lines", "l_orderkey", ()), D.LEDGER))
    refs = [(spec.refs[0], lines), (D.LEDGER, D.ledger(spark, sf_dir))]
    return discrepancy.sums(spec, discrepancy.entries(spec, D.base(spark, sf_dir), refs), ["Lines", "Ledger"])


def disc_status_1ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, n=1, keep=True).groupBy("Status").agg(F.count("*").alias("n_keys"), V.round2(F.sum("Delta")).alias("delta"))


def disc_status_2ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, keep=True).groupBy("Status").agg(F.count("*").alias("n_keys"), V.round2(F.sum("Delta")).alias("delta"))


def disc_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, FULL)


def disc_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discrepancy.problems_first(_report(spark, sf_dir))


def mismatched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, keep=True).groupBy("Mismatched Fields", "Status").agg(F.count("*").alias("n_keys"))


def compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = D.base(spark, sf_dir)
    out = compare.fields(D.spec(), match.detail(D.spec(), base, _refs(spark, sf_dir), D.AS_OF), base.columns)
    return out.select("Invoice", "Field Comparison")


def _schema(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    return compare.schema_report(D.spec(), _detail(spark, sf_dir), D.FIELDS[i : i + 1])


def schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema(spark, sf_dir, 0)


def schema_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema(spark, sf_dir, 1)


def schema_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema(spark, sf_dir, 2)


def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.executive_summary(D.spec(), _detail(spark, sf_dir), _report(spark, sf_dir))


def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.data_summary(D.spec(), _detail(spark, sf_dir), _report(spark, sf_dir))


def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.status_breakdown(_detail(spark, sf_dir), _report(spark, sf_dir))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.risk_scores(D.spec(), _report(spark, sf_dir))


def iqr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.iqr_summary(_report(spark, sf_dir), "SOA Amount")


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers among the amounts of order lines per key, which have a long tail."""
    report = disc_sums(spark, sf_dir)
    return insights.iqr_outliers(report, "Lines Amount")


def aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.aging(D.spec(), _detail(spark, sf_dir))


def source_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.source_reliability(D.spec(), _detail(spark, sf_dir), exclude_counts=True)


def top_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.top_discrepancies(D.spec(), _report(spark, sf_dir))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.patterns(D.spec(), _report(spark, sf_dir))


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = D.names(spark, sf_dir)
    return fuzzy.best_matches(b, "Alias", a, "Name", reordered=False)


def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = D.names(spark, sf_dir)
    return fuzzy.fuzzy_join(b, "Alias", a, "Name", "Crm", reordered=False)


def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best part title of each short name by shared words, word order and edits."""
    a, b = D.titles(spark, sf_dir)
    return fuzzy.best_matches(b, "Words", a, "Title", weighted=True)


def fuzzy_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles joined to pieces of them."""
    a, b = D.titles(spark, sf_dir)
    return fuzzy.fuzzy_join(b.select("Piece", "Id"), "Piece", a, "Title", "Parts", weighted=True)


def report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reports.with_classes(_report(spark, sf_dir, keep=True))
    return done.groupBy("Status", "status_class", "delta_class").agg(F.count("*").alias("n_keys"))


def level_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_classes(insights.risk_scores(D.spec(), _report(spark, sf_dir))).groupBy("Risk Level", "level_class").agg(F.count("*").alias("n_keys"))


def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_classes(_detail(spark, sf_dir)).groupBy("Bank_duplicate", "Ledger_duplicate").agg(F.count("*").alias("n_rows"))


def insights_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reconcile(D.spec(), D.base(spark, sf_dir), {"Bank": D.bank(spark, sf_dir), "Ledger": D.ledger(spark, sf_dir)}, D.AS_OF)
    return insights.metric_table(D.spec(), done.detail, written(done.discrepancies, "report"), generated_at=f"{D.AS_OF:%Y-%m-%d %H:%M:%S}")


def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest delta is found while the report is written, so the report is worked out once."""
    report, top = observed(_report(spark, sf_dir), "report", F.max(F.abs("Delta")).alias("max_gap"))
    return insights.by_risk(insights.risk_scores(D.spec(), report, known=top))


def written_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, header and status counts from what is collected while the two tables are written."""
    view, report, known = insights.with_figures(D.spec(), _detail(spark, sf_dir), _report(spark, sf_dir))
    header = [insights.header_stats(view, report, s, known).select(F.lit(s).alias("summary"), "*") for s in (True, False)]
    parts = [insights.executive_summary(D.spec(), view, report, known), insights.status_breakdown(view, report, known)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, header[0].unionByName(header[1]))


def header_without_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header figures by the status of a report with all keys."""
    return insights.header_stats(_detail(spark, sf_dir), _report(spark, sf_dir, keep=True), summary=False)


def aging_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_classes(insights.aging(D.spec(), _detail(spark, sf_dir))).select("Age Bucket", "Risk Level", "level_class")


def outlier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.by_size(insights.iqr_outliers(disc_sums(spark, sf_dir), "Lines Amount"))


def iqr_all_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures where no discrepancy is left: those of the base amounts in the view."""
    spec = D.spec(refs=(D.LEDGER,))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.select(F.col("o_orderkey").alias("Invoice"), F.col("o_totalprice").alias("Amount"))
    refs = [(D.LEDGER, orders.select(F.col("o_orderkey").alias("Ref"), F.col("o_custkey").alias("Customer"), F.col("o_totalprice").alias("Open Amount")))]
    amounts, column = insights.amounts_of(spec, match.detail(spec, base, refs, D.AS_OF), discrepancy.discrepancies(spec, base, refs))
    return insights.iqr_summary(amounts, column)


def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each report that a job writes."""
    done = reconcile(D.spec(), D.base(spark, sf_dir), {"Bank": D.bank(spark, sf_dir), "Ledger": D.ledger(spark, sf_dir)}, D.AS_OF)
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    counts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("report"), F.count("*").alias("n_rows")) for n in done.write(folder)]
    return reduce(DataFrame.unionByName, counts)


def report_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the discrepancy report, the risk report and the insights that a job writes, read back."""
    done = reconcile(D.spec(), D.base(spark, sf_dir), {"Bank": D.bank(spark, sf_dir), "Ledger": D.ledger(spark, sf_dir)}, D.AS_OF)
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    done.write(folder)
    shown = [("discrepancy_report", "Invoice #", "Status"), ("risk_analysis", "Invoice #", "Risk Level"), ("reconciliation_insights", "Metric", "Value")]
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("report"), F.col(k).alias("item"), F.col(v).alias("said")) for n, k, v in shown])


def report_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk report as read back from a committed set of reports."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    report = written(_report(spark, sf_dir), "report")
    reports.commit_reports({"discrepancy_report": report, "risk_analysis": insights.risk_scores(D.spec(), report)}, folder, "first")
    return reports.committed(spark, folder)["risk_analysis"]


def _as_csv(spark: SparkSession, sf_dir: str) -> str:
    """Customers as delimited text with doubled quotes, line breaks and backslashes in cells, as spreadsheets export them."""
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}.csv"
    c, quoted = F.col("c_custkey"), lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.when(c % 4 == 0, F.concat(F.lit('say "hi", then '), "c_name")).when(c % 4 == 1, F.concat(F.lit("two\nlines of "), "c_name")).when(c % 4 == 2, F.concat("c_name", F.lit("\\"))).otherwise("N/A")
    line = F.concat_ws(",", c.cast("string"), quoted(note), quoted(F.col("c_name")), F.col("c_acctbal").cast("string"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # each file of a folder has a header, so there is one file for each partition
    head = F.lit("Key,Note,Name,Balance\n")
    first = F.row_number().over(W.partitionBy(F.spark_partition_id()).orderBy(c)) == 1
    customers.select(F.concat(F.when(first, head).otherwise(""), line).alias("value")).write.text(path)
    return path


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, _as_csv(spark, sf_dir))


def csv_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, _as_csv(spark, sf_dir), ["Balance", "Key"])


def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in fourteen spellings, read back."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm", "MMM d, yyyy", "d MMM yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "d/M/yy", "dd.MM.yyyy", "yyyyMMdd", "yyyy.MM.dd", "d/M/yyyy h:mm a", "EEE, d MMM yyyy", "d-M-yyyy"]
    text = F.element_at(F.array(*[F.date_format(d, f) for f in forms]), (k % len(forms) + 1).cast("int"))
    read = V.parse_date(text)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format(read, "yyyy-MM-dd HH:mm:ss").alias("day"))


def date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with a time, in ten rarer spellings: month and year alone, ordinals, times before and among the date."""
    k, w = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey") % 24, mins=F.col("o_orderkey") % 60)
    forms = ["d'th' MMMM yyyy", "MMM yyyy", "yyyy-MM", "MM/yyyy", "ddMMMyyyy", "h:mm a dd/MM/yyyy", "HH:mm yyyy-MM-dd", "yyyy-MM-dd HH", "EEE MMM d HH:mm:ss yyyy", "yyyyMMdd'T'HHmmss"]
    text = F.element_at(F.array(*[F.date_format(w, f) for f in forms]), (k % len(forms) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format(V.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("day"))


def issues_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a job that goes on without a reference that cannot be read to its end, and with a file some of whose rows are short."""
    broken = D.bank(spark, sf_dir).withColumn("Total", F.when(F.col("Invoice No").endswith("77"), F.raise_error(F.lit("unreadable cell"))).otherwise(F.col("Total")))
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}.csv"
    # one column that holds whole lines, under a header of three names
    line = F.concat_ws(",", F.col("Ref").cast("string"), "Customer", F.when(F.col("Ref") % 20 != 1, F.col("Open Amount").cast("decimal(18,2)").cast("string")))
    D.ledger(spark, sf_dir).select(line.alias("Ref,Customer,Open Amount")).write.option("header", True).option("sep", "\x01").csv(path)
    done = reconcile(D.spec(), D.base(spark, sf_dir), {"Bank": broken, "Ledger": path}, D.AS_OF, isolate=True)
    figures = done.detail.groupBy("Match Source").agg(F.count("*").alias("n_rows"), F.count("Ledger_Open Amount").alias("n_amounts"))
    return figures.crossJoin(F.broadcast(done.issues)).withColumn("issue", F.when(F.col("source") == "Bank", F.substring_index("issue", ":", 1)).otherwise(F.col("issue")))


def detail_full_null_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full job in which rows without a key meet nothing and none is lost."""
    lose = lambda df, c: df.withColumn(c, F.when(~F.col(c).cast("string").contains("77"), F.col(c)))
    base, refs = lose(D.base(spark, sf_dir), "Invoice"), [(r, lose(df, r.match)) for r, df in _refs(spark, sf_dir)]
    view = match.detail(D.FULL_SPEC, base, refs, D.AS_OF, null_key=None)
    return view.groupBy(F.col("Invoice").isNull().alias("no_key"), "Bank_Match_Count", "Ledger_Match_Count", "Match Source").agg(F.count("*").alias("n_rows"))


def source_reliability_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As shipped: the match count is one of a reference's columns, so every row counts as covered."""
    return insights.source_reliability(D.spec(), _detail(spark, sf_dir))


def risk_with_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk with the age part, from the largest age of each key in the view."""
    view = match.keyed(_detail(spark, sf_dir), "Invoice").select(match.KEY, "Age (Days)")
    return insights.risk_scores(D.spec(), _report(spark, sf_dir), view)


def risk_first_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk with the age part, from the first age of each key in the order of a file's rows; every key stands in two rows."""
    k, copy = F.col("o_orderkey"), F.col("copy")
    path = f"{shared_dir(spark)}/ages-{uuid.uuid4().hex}.csv"
    twice = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    day = F.when((k % 9 != 0) | (copy == 1), F.date_sub(F.lit(D.AS_OF).cast("date"), (k * (copy + 1) % 200).cast("int")))
    mixed = twice.orderBy((k * 7919 + copy * 104729) % 1000003, k)
    mixed.select(k.cast("string").alias("Invoice"), F.date_format(day, "yyyy-MM-dd").alias("Date")).write.option("header", True).csv(path)
    ages = match.placed_ages(readers.read_table(spark, path), "Invoice", "Date", D.AS_OF)
    return insights.risk_scores(D.spec(), _report(spark, sf_dir), ages)


def header_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.header_stats(_detail(spark, sf_dir), _report(spark, sf_dir))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 keys of the sorted report, as a screen shows them."""
    return reports.preview(discrepancy.problems_first(_report(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_key, parse_amount, parse_date, age_bucket, date_cleanup, canonical_date, strict_subset, issues, detail_left, detail_full, detail_left_hot_key, detail_bucketed, match_count, match_source, dup_summary,
        exact_join_raw, missing_in_ref, missing_in_base, found_in_ref, disc_sums, disc_status_1ref, disc_status_2ref, disc_full, disc_left, mismatched_fields, compare_fields,
        schema_text, schema_number, schema_date, exec_summary, data_summary, status_breakdown, risk_scores, iqr_stats, iqr_outliers, aging, source_reliability, top_discrepancies,
        patterns, fuzzy_best, fuzzy_join, fuzzy_tokens, fuzzy_partial, report_classes, level_classes, duplicate_flags, insights_table, header_stats, preview,
        risk_order, written_figures, header_without_summary, aging_classes, outlier_order, iqr_all_match, report_sink, report_contents, report_commit, csv_scan, csv_pruned, date_spellings, date_orders, issues_isolated, detail_full_null_apart, source_reliability_default, risk_with_age, risk_first_age,
    )
}
