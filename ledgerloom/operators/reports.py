"""Reports as tables: class columns, previews and the sink."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import aging_class, delta_class, duplicate_flag, risk_class, status_class
from ..functions.values import as_text, name

PREVIEW_ROWS = 200
MANIFEST = "run string, at timestamp, report string, kind string, schema string, n_rows long"


def with_classes(df: DataFrame) -> DataFrame:
    """df with a class column for each column that has one: delta, status, risk or aging level, duplicate count."""
    out = []
    for c in df.columns:
        x = name(c)
        if c == "Delta":
            out.append(delta_class(x).alias("delta_class"))
        elif c == "Status" or c.endswith(" Status"):
            out.append(status_class(x).alias(f"{c.lower().replace(' ', '_')}_class"))
        elif c == "Risk Level":
            out.append((aging_class(x) if "Age Bucket" in df.columns else risk_class(x)).alias("level_class"))
        elif c.endswith("_Match_Count"):
            out.append(duplicate_flag(x).alias(f"{c.removesuffix('_Match_Count')}_duplicate"))
    return df.select("*", *out)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows for a screen, with missing cells empty."""
    return df.limit(rows).select(*[F.coalesce(as_text(name(c), df.schema[c].dataType), F.lit("")).alias(c) for c in df.columns])


def _save(df: DataFrame, path: str, kind: str) -> DataFrame:
    """df as a dataset, read back."""
    csv = kind == "csv"
    (df.write.mode("overwrite").option("header", True) if csv else df.write.mode("overwrite")).format(kind).save(path)
    back = df.sparkSession.read.schema(df.schema).format(kind)
    return (back.option("header", True) if csv else back).load(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """One dataset per report; returns the names of those that have rows."""
    # looked at after writing, so that no report is worked out twice
    return [title for title, df in reports.items() if df.columns and not _save(df, f"{folder}/{title}", kind).isEmpty()]


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(run, at, report, kind, schema, n_rows) of every report of a finished run; None before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit_reports(reports: Mapping[str, DataFrame], folder: str, run: str, kind: str = "parquet") -> list[str]:
    """All reports of a run or none: as datasets under the run's own name, listed in the manifest by one last write.

    Until then, and if that is never reached, readers see the run before. A run that is in
    the manifest is not done again; one that is not starts anew. Returns the reports that
    have rows. Two drivers must not write one run at the same time.
    """
    if not reports:
        return []
    spark = next(iter(reports.values())).sparkSession
    found = _manifest(spark, folder)
    if found is not None:
        listed = [(r["report"], r["n_rows"]) for r in found.where(F.col("run") == run).select("report", "n_rows").collect()]
        if listed:
            return [title for title, n in listed if n]
    rows = []
    for title, df in reports.items():
        if df.columns:
            n = _save(df, f"{folder}/run={run}/{title}", kind).count()
            rows.append((run, title, kind, df.schema.json(), n))
    at = dt.datetime.now(dt.timezone.utc)
    spark.createDataFrame([(r, at, *rest) for r, *rest in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return [title for _, title, _, _, n in rows if n]


def committed(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """Reports of a finished run by name, by default of the last one; none if there is no such run."""
    found = _manifest(spark, folder)
    if found is None:
        return {}
    if run is None:
        run = found.agg(F.max_by("run", F.struct("at", "run"))).first()[0]
    out = {}
    for r in found.where(F.col("run") == run).orderBy("report").collect():
        back = spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).format(r["kind"])
        out[r["report"]] = (back.option("header", True) if r["kind"] == "csv" else back).load(f"{folder}/run={run}/{r['report']}")
    return out
