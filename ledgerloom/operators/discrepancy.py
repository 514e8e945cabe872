"""Discrepancy report: amounts per key and source, their differences and a status.

Base and references become one long table of entries, so a single grouping by
key (with partial sums before the shuffle) gives every amount, however many
references there are; a hot key costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import NULL_KEY, amount, name, round2
from ..sources.readers import strict_subset
from ..sources.spec import FULL, JobSpec
from .match import KEY, Refs, keyed

BASE = "__base"
ALL_MATCH = "✓ All Match"
CENT = 0.01


def entries(spec: JobSpec, base: DataFrame, refs: Refs, null_key: str | None = NULL_KEY) -> DataFrame:
    """(source, key, amount): base amounts (0 where unreadable) and the readable amounts of references."""
    kind = base.schema[spec.base.amount].dataType
    parts = [keyed(base, spec.base.match, null_key).select(F.lit(BASE).alias("source"), KEY, F.coalesce(amount(name(spec.base.amount), kind), F.lit(0.0)).alias("amount"))]
    for ref, df in refs:
        subset, column = strict_subset(df, ref)
        if column:
            value = amount(name(column), subset.schema[column].dataType)
            parts.append(keyed(subset, ref.match, null_key).select(F.lit(ref.name).alias("source"), KEY, value.alias("amount")).where(F.col("amount").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def sources_with_amounts(spec: JobSpec, refs: Refs) -> list[str]:
    """References with any readable amount; only they get a column. One job, in which each look stops at the first one found."""
    looks = []
    for ref, df in refs:
        subset, column = strict_subset(df, ref)
        if column:
            looks.append(subset.where(amount(name(column), subset.schema[column].dataType).isNotNull()).limit(1).select(F.lit(ref.name).alias("source")))
    found = {r["source"] for r in reduce(DataFrame.unionByName, looks).collect()} if looks else set()
    return [ref.name for ref, _ in refs if ref.name in found]


def sums(spec: JobSpec, long: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row per key: base amount, one amount per source, the sources' names and the number of entries."""
    of = lambda s: F.col("source") == s
    grouped = long.groupBy(KEY).agg(
        F.count(F.when(of(BASE), 1)).alias("__in_base"),
        round2(F.sum(F.when(of(BASE), F.col("amount")))).alias(spec.base_label),
        *[round2(F.sum(F.when(of(s), F.col("amount")))).alias(f"{s} Amount") for s in sources],
        F.count(F.when(~of(BASE), 1)).alias("Ref_Count"),
        *[F.count(F.when(of(s), 1)).alias(f"__n_{s}") for s in sources],
    )
    if spec.how != FULL:
        grouped = grouped.where(F.col("__in_base") > 0)
    named = F.concat_ws(", ", *[F.when(name(f"__n_{s}") > 0, s) for s in sorted(sources)]) if sources else F.lit("")
    return grouped.select(
        F.col(KEY).alias(spec.key_label),
        name(spec.base_label),
        *[name(f"{s} Amount") for s in sources],
        F.coalesce(F.nullif(named, F.lit("")), F.lit("-")).alias("Ref_Sources"),
        "Ref_Count",
    )


def _largest(values: Sequence[Column]) -> Column:
    """greatest() that also takes one column; nulls are skipped."""
    return F.greatest(*values) if len(values) > 1 else values[0]


def judged(spec: JobSpec, per_key: DataFrame, sources: Sequence[str]) -> DataFrame:
    """per_key with Delta and Status; the first rule that applies decides both."""
    base = F.coalesce(name(spec.base_label), F.lit(0.0))
    zero = F.abs(base) < CENT
    if not sources:
        return per_key.withColumn("Delta", F.when(zero, 0.0).otherwise(base)).withColumn("Status", F.when(zero, "NO DATA").otherwise("MISSING IN REF"))
    refs = [name(f"{s} Amount") for s in sources]
    deltas = [base - r for r in refs]
    present = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in refs])
    largest = F.coalesce(_largest([F.abs(d) for d in deltas]), F.lit(0.0))
    # of equally large differences the first source's counts
    worst = round2(F.coalesce(*[F.when(F.abs(d) == largest, d) for d in deltas], F.lit(0.0)))
    ref_abs = F.coalesce(_largest([F.abs(r) for r in refs]), F.lit(0.0))
    staged = per_key.select("*", zero.alias("__zero"), present.alias("__present"), largest.alias("__largest"), worst.alias("__worst"), ref_abs.alias("__ref"), base.alias("__amount"))
    all_refs = F.col("__present") >= len(sources)
    none, zero, close = F.col("__present") == 0, F.col("__zero"), F.col("__largest") < CENT
    rules = [
        (none & zero, "NO DATA", F.lit(0.0)),
        (none, "MISSING IN REF", F.col("__amount")),
        (zero & (F.col("__ref") >= CENT), "MISSING IN SOA", -F.col("__ref")),
        (close & ~all_refs, "PARTIAL (Some Refs Missing)", F.lit(0.0)),
        (close, "MATCH", F.lit(0.0)),
        (~all_refs, "MISMATCH (Partial)", F.col("__worst")),
        (F.col("__worst") > 0, "Underpaid (Short)", F.col("__worst")),
    ]
    chain = lambda pick, last: reduce(lambda w, r: w.when(r[0], pick(r)), rules[1:], F.when(rules[0][0], pick(rules[0]))).otherwise(last)
    out = staged.withColumn("Delta", round2(chain(lambda r: r[2], F.col("__worst")))).withColumn("Status", chain(lambda r: F.lit(r[1]), F.lit("Overpaid (Excess)")))
    return out.drop("__zero", "__present", "__largest", "__worst", "__ref", "__amount")


def with_mismatched_fields(report: DataFrame) -> DataFrame:
    """The report knows amounts only, so ``Amount`` is the one field it can name; see compare.fields for others."""
    return report.withColumn("Mismatched Fields", F.when(F.abs("Delta") >= CENT, "Mismatch: Amount").otherwise(ALL_MATCH))


def discrepancies(spec: JobSpec, base: DataFrame, refs: Refs, null_key: str | None = NULL_KEY, keep_matches: bool = False, sources: Sequence[str] | None = None) -> DataFrame:
    """Report of all keys that need attention (or all keys)."""
    sources = sources_with_amounts(spec, refs) if sources is None else list(sources)
    report = judged(spec, sums(spec, entries(spec, base, refs, null_key), sources), sources)
    if spec.how != FULL:
        report = with_mismatched_fields(report)
    return report if keep_matches else report.where(F.col("Status") != "MATCH")


def problems_first(report: DataFrame) -> DataFrame:
    """For showing: rows with a problem first, then by Status and Delta, key last."""
    clean = F.col("Status") == "MATCH"
    if "Mismatched Fields" in report.columns:
        clean = clean & (F.col("Mismatched Fields") == ALL_MATCH)
    return report.orderBy(clean, "Status", "Delta", name(report.columns[0]))
