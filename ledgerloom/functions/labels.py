"""Classes of report rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duplicate_flag(count: Column) -> Column:
    return F.coalesce(count > 1, F.lit(False))


def delta_class(delta: Column) -> Column:
    return F.when(delta < -0.01, "negative").when(delta > 0.01, "positive").otherwise("neutral")


def status_class(status: Column) -> Column:
    bad = status.rlike("MISSING|MISMATCH|Underpaid|Overpaid")
    return F.when(bad, "bad").when(status.contains("MATCH"), "good").when(status.contains("PARTIAL"), "warn").otherwise("neutral")


def risk_class(level: Column) -> Column:
    return F.when(level.contains("Low"), "low").when(level.contains("Medium"), "medium").when(level.contains("High"), "high").otherwise("other")


def aging_class(level: Column) -> Column:
    return F.when(level.contains("Safe"), "safe").when(level.contains("Attention"), "attention").when(level.contains("Risk"), "risk").otherwise("other")
