"""Comparison of fields across sources, row by row on the detail view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import amount, as_text, canonical_date, canonical_text, name, round2, strip
from ..sources.spec import FieldSpec, JobSpec
from .discrepancy import ALL_MATCH

BASE_NAMES = ("SOA", "Master")


def _plain(view: DataFrame, column: str) -> Column:
    text = strip(F.coalesce(as_text(name(column), view.schema[column].dataType), F.lit("")))
    for mark in (" 00:00:00", "nan", "nat"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def fields(spec: JobSpec, view: DataFrame, base_columns: Sequence[str]) -> DataFrame:
    """view with ``Field Comparison``: base columns that a reference returns under the same name but with other values.

    One value inside the other is a partial match. A column is named once, though
    several references may differ in it. Each step is a projection of its own, so
    that no cell is cleaned twice.
    """
    own = {c.lower().strip(): c for c in base_columns}
    pairs = [
        (own[low], f"{ref.name}_{c}")
        for ref in spec.refs
        for c in ref.returns
        if (low := c.lower().strip()) in own and low != ref.match.lower().strip() and f"{ref.name}_{c}" in view.columns
    ]
    if not pairs:
        return view.withColumn("Field Comparison", F.lit(ALL_MATCH))
    sides = dict.fromkeys(c for pair in pairs for c in pair)
    cleaned = {c: f"__plain{i}" for i, c in enumerate(sides)}
    out = view.select("*", *[_plain(view, c).alias(x) for c, x in cleaned.items()])
    out = out.select(*[name(c) for c in view.columns], *[canonical_date(F.col(x)).alias(x) for x in cleaned.values()])
    kinds = []
    for i, (mine, theirs) in enumerate(pairs):
        a, b = F.col(cleaned[mine]), F.col(cleaned[theirs])
        differ = (a != "") & (b != "") & (a != b)
        kinds.append(F.when(differ, F.when(a.contains(b) | b.contains(a), "p").otherwise("m")).alias(f"__kind{i}"))
    out = out.select(*[name(c) for c in view.columns], *kinds)
    listed = lambda kind: F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"__kind{i}") == kind, mine) for i, (mine, _) in enumerate(pairs)]))), ", ")
    out = out.select(*[name(c) for c in view.columns], listed("m").alias("__wrong"), listed("p").alias("__part"))
    said = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    text = F.concat_ws(" | ", said("Mismatch: ", "__wrong"), said("Partial: ", "__part"))
    return out.withColumn("Field Comparison", F.coalesce(F.nullif(text, F.lit("")), F.lit(ALL_MATCH))).drop("__wrong", "__part")


NUMERIC = ("Number", "Currency")


def present_values(kind: str, values: Sequence[Column]) -> Column:
    """The values of a field that are there, as an array."""
    return F.array_compact(F.array(*(values if kind in NUMERIC else [F.when(~v.isin("", "nan"), v) for v in values])))


def schema_status(kind: str, n: int, present: Column) -> Column:
    """Status of one field of ``n`` sources from the values that are there."""
    distinct = F.size(F.array_distinct(F.transform(present, round2 if kind in NUMERIC else canonical_text)))
    nested = F.lit(False)
    if kind == "Text":
        upper = lambda v: F.upper(strip(v))
        longest = F.get(F.sort_array(F.transform(present, lambda v: F.struct(F.length(upper(v)).alias("n"), upper(v).alias("v"))), asc=False), F.lit(0))["v"]
        nested = F.aggregate(present, F.lit(True), lambda ok, v: ok & longest.contains(upper(v)))
    count = F.size(present)
    return F.when(count == 0, "NO DATA").when(count < n, "MISSING DATA").when(distinct == 1, "MATCH").when(nested, "PARTIAL MATCH").otherwise("MISMATCH")


def schema_report(spec: JobSpec, view: DataFrame, wanted: Sequence[FieldSpec] | None = None) -> DataFrame:
    """Key, then for each field one column per source and a status. A column that is not there is always empty.

    Typed values, arrays of those that are there, and statuses are projections one
    after the other, so that no cell is read twice.
    """
    values, arrays, out = [name(spec.base.match).alias(spec.key_label)], [], [name(spec.key_label)]
    for i, field in enumerate(wanted if wanted is not None else spec.fields):
        numeric, own = field.type in NUMERIC, []
        for source, column in field.mappings.items():
            target = column if source in BASE_NAMES and column in view.columns else f"{source}_{column}"
            if target not in view.columns:
                own.append(F.lit(None).cast("double" if numeric else "string"))
                continue
            kind = view.schema[target].dataType
            label = f"{field.name} ({source})"
            values.append((amount(name(target), kind) if numeric else strip(F.coalesce(as_text(name(target), kind), F.lit("")))).alias(label))
            own.append(name(label))
            out.append(name(label))
        if own:
            arrays.append(present_values(field.type, own).alias(f"__present{i}"))
            out.append(schema_status(field.type, len(own), F.col(f"__present{i}")).alias(f"{field.name} Status"))
    return view.select(*values).select("*", *arrays).select(*out)
