"""Tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: The folder of the job that is being done, inside ``scratch``.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local session without the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once and survives lost executors."""
    path = f"{_folder.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, DataFrame]:
    """df as written, and one row of figures over all its rows, collected by the tasks that write it.

    The figures sit in the last stage, whose partitions count once however often a task is
    tried, so they are those of the rows in the table.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    table = written(df.observe(seen, *figures), name)
    schema = df.agg(*figures).schema
    return table, df.sparkSession.createDataFrame([tuple(seen.get[c] for c in schema.names)], schema)


def bucketed(df: DataFrame, name: str, by: Sequence[str], n: int | None = None) -> DataFrame:
    """df as written, in n buckets (as many as shuffle partitions, if not said) by the given columns.

    Joins and groupings on exactly these columns then need no exchange. A bucket is read by
    one task, so values with very many rows must be dealt to pieces by another column.
    """
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{_folder.get() or shared_dir(spark)}/{table}"
    # by the same hash as the buckets, so each is one file
    df.repartition(n, *by).write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    # the files stay and out knows them; the catalog need not keep the name
    spark.sql(f"drop table {table}")
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to one folder that is removed at the end, so nothing may be read from them later."""
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
