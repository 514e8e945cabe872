"""Places of rows in a sorted order of each group, without a task that holds a whole group.

Rows are dealt by range of (group, order), numbered inside their range, and shifted by
the rows of the group in earlier ranges. The table of ranges has a row for each range
and group that meet: at most as many as there are ranges and groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

#: Rows of one range.
RANGE_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count of its (written) rows allows."""
    return F.broadcast(df) if df.count() <= rows else df


def same(a: DataFrame, b: DataFrame, pairs: dict[str, str]) -> Column:
    """Columns of a equal those of b, null to null."""
    out = F.lit(True)
    for x, y in pairs.items():
        out = out & a[x].eqNullSafe(b[y])
    return out


def ranges_of(df: DataFrame, rows: int = RANGE_ROWS) -> int:
    """How many ranges a (written) table is dealt to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def laid_out(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """A (written) table in ranges of (group, order), nulls first; ``part`` is a row's range, ``at`` its place there.

    A row number breaks ties, so that equal rows need not share a range.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)] + [F.col("__row")]
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges_of(df), *keys).sortWithinPartitions(*keys)
    # the lower 33 bits count the rows of a partition in their order
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(dealt.select(*df.columns, F.spark_partition_id().alias("part"), place.alias("at")), name)


def spans(laid: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """(group, part, first, n, total): for each group and range that meet, the group's rows before the range, in it, and in all."""
    each = laid.groupBy(*group, "part").agg(F.min("at").alias("__lo"), F.count("*").alias("n"))
    before = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return written(
        each.select(*group, "part", "__lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n", F.sum("n").over(W.partitionBy(*group)).alias("total")), name
    )


def positions(laid: DataFrame, found: DataFrame, group: Sequence[str]) -> DataFrame:
    """laid with each row's place in its group (``pos``, from 0), and the further columns of found (spans)."""
    other = found.select(*[F.col(c).alias(f"__{c}") for c in (*group, "part")], "__lo", "first", *[c for c in found.columns if c not in (*group, "part", "__lo", "first", "n")])
    joined = laid.join(small(other), same(laid, other, {c: f"__{c}" for c in (*group, "part")}))
    return joined.select(*laid.columns, (F.col("first") + F.col("at") - F.col("__lo")).alias("pos"), *[c for c in other.columns if not c.startswith("__") and c != "first"])
