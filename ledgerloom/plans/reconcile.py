"""A whole reconciliation job: spec and tables in, lazy report DataFrames out.

``write`` writes the detail view and the discrepancy report first and makes the other
reports from what it wrote and from the figures that it collected meanwhile, so the joins
of a job are done once and its summaries need no pass of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import NULL_KEY
from ..operators import compare, discrepancy, insights
from ..operators.match import detail
from ..operators.reports import commit_reports, write_reports
from ..sources.readers import lacks
from ..sources.spec import JobSpec, RefSpec
from ..sources.staging import staged
from ..sources.tables import scratch, written


@dataclass
class Reconciliation:
    """Reports of a job. ``discrepancies`` is None without an amount column, ``schema`` without fields."""

    spec: JobSpec
    detail: DataFrame
    discrepancies: DataFrame | None
    schema: DataFrame | None
    issues: DataFrame

    as_of: dt.datetime | None = None
    #: one row, as with_figures gives it, where view and report are written
    known: DataFrame | None = None

    def reports(self, approximate: bool = False) -> dict[str, DataFrame]:
        """All reports by name. ``approximate`` takes quartiles from a sketch."""
        out = {"detailed_view": self.detail}
        if self.discrepancies is not None:
            stamp = f"{self.as_of or dt.datetime.now():%Y-%m-%d %H:%M:%S}"
            out["discrepancy_report"] = discrepancy.problems_first(self.discrepancies)
            out["reconciliation_insights"] = insights.metric_table(self.spec, self.detail, self.discrepancies, stamp, approximate=approximate, known=self.known)
            out["risk_analysis"] = insights.by_risk(insights.risk_scores(self.spec, self.discrepancies, known=self.known))
            amounts, column = insights.amounts_of(self.spec, self.detail, self.discrepancies, self.known)
            if column:
                out["outliers"] = insights.by_size(insights.iqr_outliers(amounts, column, approximate=approximate))
        if self.schema is not None:
            out["normalized_comparison"] = self.schema
        if "Age Bucket" in self.detail.columns:
            out["aging"] = insights.aging(self.spec, self.detail)
        out["issues"] = self.issues
        return out

    def write(self, folder: str, kind: str = "parquet", approximate: bool = False, run: str | None = None) -> list[str]:
        """Names of the reports written, which are those that have rows.

        With the name of a ``run`` all are committed together, see commit_reports; read them by ``committed``.
        Tables written on the way are removed at the end.
        """
        with scratch(self.detail.sparkSession):
            if self.discrepancies is None:
                view, report, known = written(self.detail, "detail"), None, None
            else:
                view, report, known = insights.with_figures(self.spec, self.detail, self.discrepancies)
            schema = compare.schema_report(self.spec, view) if self.schema is not None else None
            reports = replace(self, detail=view, discrepancies=report, schema=schema, known=known).reports(approximate)
            return write_reports(reports, folder, kind) if run is None else commit_reports(reports, folder, run, kind)


def _usable(spark: SparkSession, refs: Sequence[RefSpec], tables: Mapping[str, DataFrame | str], isolate: bool) -> tuple[list[tuple[RefSpec, DataFrame]], list[tuple[str, str]]]:
    """References that can take part, and (source, issue) rows of what is wrong with any."""
    usable, found = [], []
    for ref in refs:
        source = tables.get(ref.name)
        if source is None:
            df, wrong = None, ["no table"]
        elif isolate or isinstance(source, str):
            df, wrong = staged(spark, ref, source)
        else:
            lost = lacks(source, ref)
            df, wrong = (None, [lost]) if lost else (source, [])
        found += [(ref.name, w) for w in wrong]
        if df is not None:
            usable.append((ref, df))
    return usable, found


def reconcile(spec: JobSpec, base: DataFrame, refs: Mapping[str, DataFrame | str], as_of: dt.datetime | None = None, null_key: str | None = NULL_KEY, sources: Sequence[str] | None = None, heavy_rows: int | None = None, isolate: bool = False, buckets: int | None = None) -> Reconciliation:
    """A reference with missing columns is listed in ``issues`` and left out of the joins; ``heavy_rows`` and ``buckets`` as in detail.

    A reference given by its path, or any with ``isolate``, is first read on its own into the
    shared folder: one that cannot be read to its end becomes an issue as well, the others go on,
    and the job's joins read the written columns only.
    """
    as_of = as_of or dt.datetime.now()
    usable, found = _usable(base.sparkSession, spec.refs, refs, isolate)
    view = detail(spec, base, usable, as_of, null_key, heavy_rows=heavy_rows, buckets=buckets)
    report = discrepancy.discrepancies(spec, base, usable, null_key, sources=sources) if spec.base.amount in base.columns else None
    schema = compare.schema_report(spec, view) if spec.fields else None
    issues = base.sparkSession.createDataFrame(found, "source string, issue string")
    return Reconciliation(spec, view, report, schema, issues, as_of)
