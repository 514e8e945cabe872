"""Selected quantiles against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import insights
from ledgerloom.operators.quantiles import quantiles
from ledgerloom.plans import queries as Q

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def plain(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low, high = math.floor(place), math.ceil(place)
    return values[low] if low == high or values[low] == values[high] else (high - place) * values[low] + (place - low) * values[high]


R = random.Random(4)
TABLES = {
    "few": [3.0, 1.0, 2.0],
    "one": [7.5],
    "spread": [R.gauss(0, 1) * 10 ** R.randint(-3, 300) for _ in range(3000)],
    "equal": [5.0] * 2000,
    "hot": [1.0] * 900 + [2.0] * 900 + [R.random() for _ in range(1200)],
}


@pytest.mark.parametrize("table", list(TABLES))
def test_against_sorted_values(spark, table):
    values = TABLES[table]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "`an amount` double").repartition(3)
    assert quantiles(df, "an amount", SHARES, few=5) == [plain(values, p) for p in SHARES]


def test_empty(spark):
    assert quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_many_rows_need_several_rounds(spark):
    df = spark.range(300_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    want = df.agg(*[F.percentile("x", F.lit(p)) for p in SHARES]).first()
    assert quantiles(df, "x", SHARES, few=10) == list(want)


def test_quartiles_are_not_counted_in_one_task(spark, small):
    report = Q.disc_sums(spark, small)
    plan = insights.iqr_stats(report, "Lines Amount")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
