"""Insights over a detail view and its discrepancy report.

Every insight is a DataFrame. Figures over the whole table (a maximum, quartiles)
are one-row aggregates that are broadcast back, never windows over everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BUCKETS, UNKNOWN, amount, exact_avg, exact_sum, money, name, round2
from ..sources.spec import JobSpec, fallback_amount
from ..sources.tables import observed, written
from .quantiles import quantiles

# Points of each status in the risk score; others get OTHER_POINTS. Levels by score.
STATUS_POINTS = {"MATCH": 0, "PARTIAL (Some Refs Missing)": 10, "MISSING IN REF": 20, "MISSING IN SOA": 25, "MISMATCH (Partial)": 20, "Underpaid (Short)": 15, "Overpaid (Excess)": 15, "NO DATA": 25}
OTHER_POINTS = 15
LEVELS = [(25, "🟢 Low"), (50, "🟡 Medium"), (75, "🟠 High"), (100, "🔴 Critical")]


def _cell(df: DataFrame, column: str, **how: bool) -> Column:
    return amount(name(column), df.schema[column].dataType, **how)


def _base_amount(spec: JobSpec, view: DataFrame) -> str | None:
    return spec.base.amount if spec.base.amount in view.columns else fallback_amount(view.columns)


def _percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x), F.lit("%"))


def _total(spec: JobSpec, view: DataFrame) -> list[Column]:
    """Figures of the view that the summary needs."""
    column = _base_amount(spec, view)
    value = F.coalesce(_cell(view, column), F.lit(0.0)) if column else F.lit(0.0)
    return [F.count("*").alias("total_records"), F.coalesce(exact_sum(value), F.lit(0.0)).alias("base_total")]


def _found() -> list[Column]:
    """Figures of the report that the summary needs."""
    gap = F.abs("Delta")
    return [
        F.count("*").alias("discrepancy_count"),
        F.coalesce(round2(exact_sum(gap)), F.lit(0.0)).alias("total_discrepancy_value"),
        F.coalesce(round2(exact_avg(gap)), F.lit(0.0)).alias("avg_discrepancy"),
        F.coalesce(round2(F.max(gap)), F.lit(0.0)).alias("max_discrepancy"),
        F.max(gap).alias("max_gap"),
    ]


def _of_status() -> list[Column]:
    """Rows of each status in the report, as status<i> in the order of STATUS_POINTS."""
    return [F.count(F.when(F.col("Status") == s, 1)).alias(f"status{i}") for i, s in enumerate(STATUS_POINTS)]


def with_figures(spec: JobSpec, view: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """View and report as tables, and one row of what other insights need to know of them.

    The figures are collected while the tables are written; given as ``known``, they save
    an insight its own pass over either.
    """
    view, of_view = observed(view, "detail", *_total(spec, view), *_sources(spec, view)[1])
    report, of_report = observed(report, "report", *_found(), *_of_status(), *_patterns(spec, report)[0])
    return view, report, of_view.crossJoin(F.broadcast(of_report))


def _judged(spec: JobSpec, figures: DataFrame) -> DataFrame:
    """Adds match_count, match_rate, health_score and ref_count to one row with the figures of ``_total`` and ``_found``."""
    both = figures.withColumn("match_count", F.col("total_records") - F.col("discrepancy_count"))
    both = both.withColumn("match_rate", F.when(F.col("total_records") > 0, F.bround(F.col("match_count") / F.col("total_records") * 100, 1)).otherwise(0.0))
    total = F.col("total_discrepancy_value")
    penalty = F.when((total > 0) & (F.col("base_total") != 0), F.least(F.lit(20.0), F.when(F.col("base_total") != 0, total / F.abs("base_total")) * 100))
    health = F.when(penalty.isNotNull(), F.greatest(F.lit(0.0), F.col("match_rate") - penalty)).otherwise(F.col("match_rate"))
    return both.withColumn("health_score", F.bround(health, 1)).withColumn("ref_count", F.lit(len(spec.refs)).cast("long"))


def _figures(view: DataFrame, of_view: list[Column], report: DataFrame, of_report: list[Column], known: DataFrame | None) -> DataFrame:
    """One row of figures: those known, or else from one pass over each table."""
    return view.agg(*of_view).crossJoin(F.broadcast(report.agg(*of_report))) if known is None else known


def executive_summary(spec: JobSpec, view: DataFrame, report: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row. ``match_count`` is detail rows less report rows, as the figures are defined."""
    both = _judged(spec, _figures(view, _total(spec, view), report, _found(), known))
    return both.select("total_records", "match_count", "discrepancy_count", "match_rate", "total_discrepancy_value", "avg_discrepancy", "max_discrepancy", "health_score", "ref_count")


def _sources(spec: JobSpec, view: DataFrame) -> tuple[list[str], list[Column]]:
    """Sources, and the columns n<i>, v<i> with the rows and value of each, in one pass over the view."""
    column = _base_amount(spec, view)
    zero = F.lit(0.0)
    parts = [("SOA (Master)", F.count("*"), exact_sum(F.coalesce(_cell(view, column), zero)) if column else zero)]
    for ref in spec.refs:
        own = next((c for c in view.columns if c.startswith(ref.name) and any(k in c.lower() for k in ("amount", "total", "balance"))), None)
        count = f"{ref.name}_Match_Count"
        if own:
            parts.append((ref.name, F.count(name(own)), exact_sum(F.coalesce(_cell(view, own), zero))))
        else:
            parts.append((ref.name, F.count(F.when(name(count) > 0, 1)) if count in view.columns else F.lit(0).cast("long"), zero))
    return [s for s, _, _ in parts], [x.alias(f"{k}{i}") for i, (_, n, v) in enumerate(parts) for k, x in (("n", n), ("v", F.coalesce(v, zero)))]


def _source_rows(sources: list[str]) -> Column:
    rate = lambda i: F.lit("100.0%") if i == 0 else _percent(F.col("match_rate"))
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("Source"), F.col(f"n{i}").alias("Total Invoices"), round2(F.col(f"v{i}")).alias("Total Value"), rate(i).alias("Match Rate vs SOA")) for i, s in enumerate(sources)])


def data_summary(spec: JobSpec, view: DataFrame, report: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows, value and rate of each source, in one pass over the view."""
    sources, figures = _sources(spec, view)
    both = _judged(spec, _figures(view, [*_total(spec, view), *figures], report, _found(), known))
    return both.select(F.explode(_source_rows(sources)).alias("r")).select("r.*")


def status_breakdown(view: DataFrame, report: DataFrame, known: DataFrame | None = None) -> DataFrame:
    if known is not None:
        counts = [(F.col("total_records") - F.col("discrepancy_count") if s == "MATCH" else F.col(f"status{i}"), s) for i, s in enumerate(STATUS_POINTS)]
        rows = F.array(*[F.struct(F.lit(s).alias("Status"), n.alias("Count")) for n, s in counts])
        return known.select(F.explode(rows).alias("r")).select("r.*").where((F.col("Count") > 0) | (F.col("Status") == "MATCH"))
    counts = report.where(F.col("Status") != "MATCH").groupBy("Status").agg(F.count("*").alias("Count"))
    rest = view.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(report.agg(F.count("*").alias("found"))))
    return rest.select(F.lit("MATCH").alias("Status"), (F.col("rows") - F.col("found")).alias("Count")).unionByName(counts)


def risk_scores(spec: JobSpec, report: DataFrame, age: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Score 0 to 100 of each report row from delta, status and missing references.

    The report is read twice, for its largest delta and for its rows; once where that is ``known``.

    The age part is 0 by definition; ``age`` (key, days) turns on up to 20 points
    for rows older than 120 days, in proportion below. Of several ages of a key the
    largest counts or, where a third column tells the rows' places, the first one known.
    """
    key = report.columns[0]
    top = report.agg(F.max(F.abs("Delta")).alias("__max")) if known is None else known.select(F.col("max_gap").alias("__max"))
    scored = report.crossJoin(F.broadcast(top))
    delta = F.when(F.col("__max") > 0, F.bround(F.abs("Delta") / F.col("__max") * 40, 1)).otherwise(0.0)
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_POINTS.items() for x in kv])[F.col("Status")], F.lit(OTHER_POINTS))
    ratio = 1 - F.col("Ref_Count") / max(len(spec.refs), 1)
    missing = F.bround(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * 15, 1)
    aged = F.lit(0.0)
    if age is not None:
        days, *order = map(name, age.columns[1:])
        chosen = F.min_by(days, F.when(days.isNotNull(), order[0])) if order else F.max(days)
        days = age.groupBy(name(age.columns[0]).alias(key)).agg(chosen.alias("__days"))
        scored = scored.join(days, key, "left")
        aged = F.coalesce(F.bround(F.least(F.greatest(F.col("__days"), F.lit(0)), F.lit(120)) / 6, 1), F.lit(0.0))
    score = F.bround(F.least(F.greatest(delta + status + missing + aged, F.lit(0.0)), F.lit(100.0)), 0).cast("int")
    level = reduce(lambda w, x: w.when(F.col("Risk Score") <= x[0], x[1]), LEVELS[1:], F.when(F.col("Risk Score") <= LEVELS[0][0], LEVELS[0][1]))
    return scored.withColumn("Risk Score", score).select(name(key), "Risk Score", level.alias("Risk Level"), "Status", "Delta")


def by_risk(scores: DataFrame) -> DataFrame:
    """For showing: the highest risk first, then by key."""
    return scores.orderBy(F.desc("Risk Score"), name(scores.columns[0]))


SHARES = (0.5, 0.25, 0.75)


def _spread(x: Column, approximate: bool, table: DataFrame, column: str) -> list[Column]:
    """Figures of a column's distribution; exact quartiles are selected by passes over ``table``, which has the column."""
    found = [F.percentile_approx(x, p, 10_000) if approximate else None for p in SHARES]
    if not approximate:
        found = [F.lit(v).cast("double") for v in quantiles(table, column, SHARES)]
    return [F.count(x).alias("n"), exact_avg(x).alias("mean"), found[0].alias("median"), F.stddev_samp(x).alias("std_dev"), found[1].alias("q1"), found[2].alias("q3")]


def _bounded(figures: DataFrame) -> DataFrame:
    s = figures.withColumn("iqr", F.col("q3") - F.col("q1"))
    return s.withColumn("lower_bound", F.col("q1") - 1.5 * F.col("iqr")).withColumn("upper_bound", F.col("q3") + 1.5 * F.col("iqr"))


def iqr_stats(report: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row of distribution figures; none if there are fewer than four amounts.

    The amounts are written once and quartiles selected from them (see quantiles);
    ``approximate`` takes quartiles from a bounded-size sketch instead, in one pass.
    """
    table = report if approximate else written(report.select(name(column)), "amounts")
    return _bounded(table.agg(*_spread(name(column), approximate, table, column)).where(F.col("n") >= 4))


def amounts_of(spec: JobSpec, view: DataFrame, report: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """The table and column whose amounts are looked at: the report's, or the view's where no discrepancy is left."""
    if not report.isEmpty() if known is None else known.first()["discrepancy_count"]:
        return report, spec.base_label if spec.base_label in report.columns else fallback_amount(report.columns)
    column = _base_amount(spec, view)
    if column is None:
        return view, None
    key = spec.base.match if spec.base.match in view.columns else view.columns[0]
    return view.select(name(key), _cell(view, column).alias(column)), column


def iqr_outliers(report: DataFrame, column: str, stats: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Amounts outside the bounds, with their side and z-score."""
    stats = iqr_stats(report, column, approximate) if stats is None else stats
    x = name(column)
    out = report.crossJoin(F.broadcast(stats)).where((x < F.col("lower_bound")) | (x > F.col("upper_bound")))
    side = F.when(x > F.col("upper_bound"), "⬆ Above Upper").otherwise("⬇ Below Lower")
    z = F.when(F.col("std_dev") != 0, round2((x - F.col("mean")) / F.when(F.col("std_dev") != 0, F.col("std_dev"))))
    return out.select(name(report.columns[0]), x, side.alias("Deviation"), z.alias("Z-Score"))


def by_size(outliers: DataFrame) -> DataFrame:
    """For showing: the largest amount first, whatever its sign, then by key."""
    key, column = outliers.columns[:2]
    return outliers.orderBy(F.desc(F.abs(name(column))), name(key))


_ROUNDED = ("mean", "median", "std_dev", "q1", "q3", "iqr", "lower_bound", "upper_bound")


def iqr_summary(report: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """The figures rounded, with number and share of outliers."""
    # amounts alone are read several times, the report once
    report = report.select(name(column)) if approximate else written(report.select(name(column)), "amounts")
    stats = _bounded(report.agg(*_spread(name(column), approximate, report, column)).where(F.col("n") >= 4))
    count = iqr_outliers(report, column, stats).agg(F.count("*").alias("outlier_count"))
    return stats.crossJoin(F.broadcast(count)).select(*[round2(F.col(c)).alias(c) for c in _ROUNDED], "outlier_count", F.bround(F.col("outlier_count") / F.col("n") * 100, 1).alias("outlier_pct"))


def aging(spec: JobSpec, view: DataFrame) -> DataFrame:
    """Rows and value per age bucket. Here brackets are not read as negative."""
    column = _base_amount(spec, view)
    value = F.coalesce(_cell(view, column, accounting=False, inner_space=False), F.lit(0.0)) if column else F.lit(0.0)
    bucket = F.col("Age Bucket")
    risk = F.when(bucket == BUCKETS[0], "🟢 Safe").when(bucket == BUCKETS[1], "🟡 Attention Required").when(bucket.isin(BUCKETS[2:]), "🔴 High Risk").otherwise("⚪ Unknown")
    order = F.array_position(F.array(*[F.lit(b) for b in [*BUCKETS, UNKNOWN]]), bucket)
    out = view.where(bucket.isNotNull()).groupBy("Age Bucket").agg(F.count("*").alias("Total Invoices"), exact_sum(value).alias("__value"))
    return out.select("Age Bucket", "Total Invoices", money(round2(F.col("__value"))).alias("Total Value"), risk.alias("Risk Level"), order.cast("int").alias("ord"))


def _grade(accuracy: Column, coverage: Column) -> Column:
    by_coverage = F.when(coverage >= 95, "A").when(coverage >= 80, "B").when(coverage >= 60, "C").otherwise("D")
    by_both = (
        F.when((accuracy >= 95) & (coverage >= 90), "A+").when((accuracy >= 90) & (coverage >= 80), "A").when((accuracy >= 80) & (coverage >= 70), "B").when(accuracy >= 70, "C").otherwise("D")
    )
    return F.when(accuracy.isNull(), by_coverage).otherwise(by_both)


def source_reliability(spec: JobSpec, view: DataFrame, exclude_counts: bool = False) -> DataFrame:
    """Coverage, accuracy and grade per reference, in one pass over the view.

    The match count is one of a reference's columns and is never null in a left
    job, so coverage is 100 % there; ``exclude_counts`` leaves it out.
    """
    base = _base_amount(spec, view)
    strict = lambda c: name(c).try_cast("double") if isinstance(view.schema[c].dataType, T.StringType) else name(c).cast("double")
    figures, rows = [F.count("*").alias("n")], []
    for i, ref in enumerate(spec.refs):
        own = [c for c in view.columns if c.startswith((f"{ref.name}_", f"{ref.name} "))]
        if exclude_counts:
            own = [c for c in own if c != f"{ref.name}_Match_Count"]
        if not own:
            continue
        figures.append(F.count(F.when(reduce(lambda a, b: a | b, [name(c).isNotNull() for c in own]), 1)).alias(f"p{i}"))
        amt = f"{ref.name}_{base}"
        if amt not in view.columns:
            amt = next((c for c in own if any(k in c.lower() for k in ("amount", "total", "value"))), None)
        if base and amt:
            gap = F.abs(strict(base) - strict(amt))
            figures += [F.count(gap).alias(f"b{i}"), F.count(F.when(gap < 0.01, 1)).alias(f"e{i}"), exact_avg(gap).alias(f"d{i}")]
        else:
            figures += [F.lit(0).cast("long").alias(f"b{i}"), F.lit(0).cast("long").alias(f"e{i}"), F.lit(None).cast("double").alias(f"d{i}")]
        n, p, b, e, d = F.col("n"), *[F.col(f"{k}{i}") for k in "pbed"]
        coverage = F.when(n > 0, F.bround(p / n * 100, 1)).otherwise(0.0)
        accuracy = F.when(b > 0, F.bround(e / b * 100, 1))
        rows.append(F.struct(F.lit(ref.name).alias("Source"), coverage.alias("Coverage"), p.alias("Present"), (n - p).alias("Missing"), F.when(b > 0, e).alias("Exact Matches"), accuracy.alias("Accuracy"), F.when(b > 0, round2(d)).alias("Avg Deviation"), _grade(accuracy, coverage).alias("Grade")))
    return view.agg(*figures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_discrepancies(spec: JobSpec, report: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest differences; equal ones by key."""
    key = report.columns[0]
    columns = [c for c in (key, spec.base_label, *[f"{r.name} Amount" for r in spec.refs], "Delta", "Status") if c in report.columns]
    return report.where(F.col("Status") != "MATCH").orderBy(F.desc(F.abs("Delta")), name(key)).limit(n).select(*[name(c) for c in columns])


# Names and wording of the patterns, and the shares from which they hold.
def _patterns(spec: JobSpec, report: DataFrame) -> tuple[list[Column], Column | None]:
    """Counters of all sources in one pass over the report, and the array of patterns that hold by them."""
    base = name(spec.base_label)
    sources = [r.name for r in spec.refs if f"{r.name} Amount" in report.columns]
    if not sources:
        return [], None
    figures = [F.count("*").alias("rows")]
    for i, s in enumerate(sources):
        ref = name(f"{s} Amount")
        d = base - ref
        share = F.when((base != 0) & ref.isNotNull(), d / F.when(base != 0, base))
        figures += [
            F.count(d).alias(f"both{i}"), F.count(F.when(d > 0.01, 1)).alias(f"up{i}"), F.count(F.when(d < -0.01, 1)).alias(f"down{i}"), exact_avg(d).alias(f"gap{i}"),
            F.count(share).alias(f"shares{i}"), F.stddev_samp(share).alias(f"spread{i}"), F.avg(share).alias(f"share{i}"), F.count(F.when(base.isNotNull() & (ref % 100 == 0), 1)).alias(f"round{i}"),
        ]
    found = []
    for i, s in enumerate(sources):
        n, both, up, down, gap, shares, spread, share, even = F.col("rows"), *[F.col(f"{k}{i}") for k in ("both", "up", "down", "gap", "shares", "spread", "share", "round")]
        enough, lost = both >= 3, n - both
        under = enough & (up > 0.8 * both)
        over = enough & ~under & (down > 0.8 * both)
        mean, text = round2(F.abs(gap)), lambda c, digits: F.format_string(f"%.{digits}f", c)
        row = lambda when, kind, say, severity, affected: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(s).alias("source"), F.concat(F.lit(s), *say).alias("description"), severity.alias("severity"), affected.alias("affected")))  # noqa: E731, B023
        found += [
            row(under, "Systematic Underpayment", [F.lit(" consistently reports LOWER amounts than SOA (avg gap: $"), text(mean, 2), F.lit(")")], F.when(mean > 100, "High").otherwise("Medium"), up),
            row(over, "Systematic Overpayment", [F.lit(" consistently reports HIGHER amounts than SOA (avg gap: $"), text(mean, 2), F.lit(")")], F.when(mean > 100, "High").otherwise("Medium"), down),
            row(enough & (shares > 3) & (spread < 0.02) & (F.abs(share) > 0.01), "Fixed Percentage Offset", [F.lit(" deviates by a consistent "), text(F.bround(share * 100, 1), 1), F.lit("% from SOA — possible fee/tax difference")], F.lit("Medium"), shares),
            row(enough & (lost > 0.3 * n) & (n > 5), "Data Gap", [F.lit(" is missing "), lost.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" invoices ("), F.bround(lost / F.when(n > 0, n) * 100, 0).cast("int").cast("string"), F.lit("%)")], F.when(lost > 0.5 * n, "High").otherwise("Medium"), lost),
            row(enough & (both > 5) & (even > 0.5 * both), "Estimated Amounts", [F.lit(" has "), even.cast("string"), F.lit(" amounts that are round numbers — may be estimates rather than actuals")], F.lit("Low"), even),
        ]
    return figures, F.array_compact(F.array(*found))


def patterns(spec: JobSpec, report: DataFrame) -> DataFrame:
    """Systematic differences of a source: one row per pattern that holds."""
    figures, found = _patterns(spec, report)
    if found is None:
        return report.sparkSession.createDataFrame([], "type string, source string, description string, severity string, affected long")
    return report.agg(*figures).select(F.explode(found).alias("p")).select("p.*")


def header_stats(view: DataFrame, report: DataFrame, summary: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Rows, matches and issues. Without a ``summary`` matches are the report's rows that are marked so, as in a report with all keys."""
    total, n, good = F.col("total_records"), F.col("discrepancy_count"), F.col(f"status{list(STATUS_POINTS).index('MATCH')}")
    figures = _figures(view, [F.count("*").alias("total_records")], report, [F.count("*").alias("discrepancy_count"), *_of_status()], known)
    matches, issues = (total - n, n) if summary else (good, n - good)
    return figures.select(total.alias("total_rows"), matches.alias("matches"), issues.alias("issues"))


def metric_table(spec: JobSpec, view: DataFrame, report: DataFrame, generated_at: str = "", with_patterns: bool = True, approximate: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(ord, Metric, Value): all insights as one long table of texts; ord gives the order of rows.

    One pass over the view and one over the report, or none where the figures are ``known``,
    give all but the distribution of amounts, for which these are read again.
    """
    c = F.col
    sources, of_sources = _sources(spec, view)
    of_patterns, found = _patterns(spec, report) if with_patterns else ([], None)
    statuses = [(i, s) for i, s in enumerate(STATUS_POINTS) if s != "MATCH"]
    amounts, column = amounts_of(spec, view, report, known)
    figures = _figures(view, [*_total(spec, view), *of_sources], report, [*_found(), *of_patterns, *_of_status()], known)
    if column:
        amounts = amounts.select(name(amounts.columns[0]), name(column))
        amounts = amounts if approximate else written(amounts, "amounts")
        stats = _bounded(amounts.agg(*_spread(name(column), approximate, amounts, column)))
        outside = iqr_outliers(amounts, column, stats.where(c("n") >= 4)).agg(F.count("*").alias("outlier_count"))
        figures = figures.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(outside))
    else:
        figures = figures.select("*", F.lit(0).alias("n"), F.lit(0).alias("outlier_count"), *[F.lit(None).cast("double").alias(x) for x in _ROUNDED])
    line = lambda ord, metric, value: F.struct((ord if isinstance(ord, Column) else F.lit(ord)).cast("int").alias("ord"), (metric if isinstance(metric, Column) else F.lit(metric)).alias("Metric"), value.cast("string").alias("Value"))  # noqa: E731, A002
    label = lambda r, what: F.concat(F.lit("["), r["Source"], F.lit(f"] {what}"))
    summary = [
        ("Total Records Processed", c("total_records")), ("Match Rate", _percent(c("match_rate"))), ("Matched Invoices", c("match_count")), ("Discrepancies Found", c("discrepancy_count")),
        ("Total Discrepancy Value", money(c("total_discrepancy_value"))), ("Average Discrepancy", money(c("avg_discrepancy"))), ("Maximum Discrepancy", money(c("max_discrepancy"))),
        ("Reconciliation Health Score", F.concat(F.format_string("%.1f", c("health_score")), F.lit("/100"))), ("Reference Sources", c("ref_count")), ("Generated At", F.lit(generated_at)),
    ]
    enough = c("n") >= 4
    spread = [("Mean Amount", money(round2(c("mean")))), ("Median Amount", money(round2(c("median")))), ("Std Deviation", money(round2(c("std_dev")))), ("Outlier Count", c("outlier_count")), ("Outlier Percentage", _percent(F.bround(c("outlier_count") / F.when(enough, c("n")) * 100, 1)))]
    parts = [
        F.array(*[line(i, m, v) for i, (m, v) in enumerate(summary)]),
        F.flatten(F.transform(_source_rows(sources), lambda r: F.array(line(100, label(r, "Invoices"), r["Total Invoices"]), line(101, label(r, "Value Sum"), money(r["Total Value"])), line(102, label(r, "Match Rate"), r["Match Rate vs SOA"])))),
        F.array(line(200, "MATCH", c("match_count"))),
        F.array_compact(F.array(*[F.when(c(f"status{i}") > 0, line(200, s, c(f"status{i}"))) for i, s in statuses])),
        F.array_compact(F.array(*[F.when(enough, line(400 + i, m, v)) for i, (m, v) in enumerate(spread)])),
    ]
    if found is not None:
        parts.append(F.transform(found, lambda p: line(300, F.concat(F.lit("["), p["severity"], F.lit("] "), p["type"]), p["description"])))
    return _judged(spec, figures).select(F.explode(F.flatten(F.array(*parts))).alias("r")).select("r.*")
