"""Reading source tables and cutting references down to what a job needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import name
from .spec import RefSpec, amount_column

# Texts that stand for a missing cell in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of a file is UTF-8, checked by the executors."""
    return spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]


#: Quotes inside a quoted cell are doubled; a backslash is a sign like any other.
DIALECT = {"header": True, "quote": '"', "escape": '"'}


def dialect(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether a quoted cell goes over several lines) of a file, by one pass over its lines.

    Only where some line has an odd number of quotes need records be looked for across
    lines, which keeps Spark from splitting the file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False))).first()
    return ("UTF-8" if row[0] else "ISO-8859-1"), row[1]


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**DIALECT).csv(path).columns


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str | None = None, multi_line: bool | None = None, odd: str | None = None) -> DataFrame:
    """A CSV (UTF-8, else Latin-1; cells as text, missing ones null) or Parquet table, only ``columns`` of it.

    A CSV is read once more to find ``encoding`` and ``multi_line``, unless both are given.
    Short rows lack their last cells, long ones lose what goes beyond the header; ``odd`` names
    a column for a CSV that marks both.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        if encoding is None or multi_line is None:
            found = dialect(spark, path)
            encoding, multi_line = encoding or found[0], found[1] if multi_line is None else multi_line
        reader = spark.read.options(**DIALECT).option("encoding", encoding).option("multiLine", multi_line)
        df = reader.csv(path)
        cells = [F.when(~name(c).isin(MISSING), name(c)).alias(c) for c in df.columns]
        if odd is not None:
            whole = T.StructType([T.StructField(c, T.StringType()) for c in (*df.columns, odd)])
            # a parser that skips columns does not see how many cells a row has
            df = reader.schema(whole).option("columnNameOfCorruptRecord", odd).option("columnPruning", False).csv(path)
            cells.append(name(odd).isNotNull().alias(odd))
        df = df.select(*cells)
    else:
        raise ValueError(f"unsupported file format: {kind}")
    if columns is None:
        return df
    wanted = {*columns, odd}
    return df.select(*[name(c) for c in df.columns if c in wanted])


def place() -> Column:
    """Where a row of a table read from files stands: file, block and row within the block, whatever tasks read it.

    Rows of one block keep their order within a task, and files are ordered by name, as Spark numbers what it writes.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def strict_subset(df: DataFrame, ref: RefSpec) -> tuple[DataFrame, str | None]:
    """Match column, return columns and the amount column (looked for among all), nothing else."""
    amount = amount_column(df.columns)
    keep = dict.fromkeys([ref.match, *ref.returns, *([amount] if amount else [])])
    return df.select(*[name(c) for c in keep]), amount


def extracted(ref: RefSpec) -> list[str]:
    """Columns that a reference adds to the detail view, the match column included."""
    return list(ref.returns) if ref.match in ref.returns else [ref.match, *ref.returns]


def prefixed(df: DataFrame, source: str) -> DataFrame:
    return df.select(*[name(c).alias(f"{source}_{c}") for c in df.columns])


def lacks(df: DataFrame, ref: RefSpec) -> str | None:
    """What keeps a reference out of a job, seen from its columns."""
    lost = [c for c in (ref.match, *ref.returns) if c not in df.columns]
    return f"missing column: {', '.join(lost)}" if lost else None


def problems(refs: Sequence[tuple[RefSpec, DataFrame]]) -> list[tuple[str, str]]:
    """(source, issue) of references that cannot take part; the others are not held up by them."""
    return [(ref.name, lost) for ref, df in refs if (lost := lacks(df, ref))]
