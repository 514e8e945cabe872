"""References read once, each on its own, so that one that fails holds up no other."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import name
from .readers import lacks, read_table
from .spec import RefSpec, amount_column
from .tables import shared_dir, written

ODD = "__odd_row"
REASON_LENGTH = 300


def _reason(fault: Exception) -> str:
    """The first line that says something, without a stack."""
    lines = [x.strip() for x in str(fault).splitlines() if x.strip()]
    return (lines[0] if lines else type(fault).__name__)[:REASON_LENGTH]


def staged(spark: SparkSession, ref: RefSpec, source: DataFrame | str) -> tuple[DataFrame | None, list[str]]:
    """(the columns that a job needs of a reference, written to the shared folder; what was wrong with it).

    ``source`` is a table or the path of a CSV or Parquet one. It is read from beginning to
    end here, once, so whatever makes reading fail (no such file, damaged blocks, a cell that
    cannot be converted) shows here and not in the job's joins: such a reference is None.
    Rows of a CSV with too few or too many cells stay and are counted.
    """
    shared_dir(spark)  # a session without a shared folder is no fault of the reference
    try:
        df = read_table(spark, source, odd=ODD) if isinstance(source, str) else source
        lost = lacks(df, ref)
        if lost:
            return None, [lost]
        # in the table's own order, by which its amount column is chosen
        needed = {ref.match, *ref.returns, amount_column([c for c in df.columns if c != ODD]), ODD}
        table = written(df.select(*[name(c) for c in df.columns if c in needed]), "reference")
    except (PySparkException, Py4JError, ValueError) as fault:
        spark.range(1).count()  # a session that has ended is no fault of the reference either
        return None, [f"cannot be read: {_reason(fault)}"]
    if ODD not in table.columns:
        return table, []
    odd = table.where(name(ODD)).agg(F.count("*")).first()[0]
    return table.drop(ODD), [f"rows with too few or too many cells: {odd}"] if odd else []
