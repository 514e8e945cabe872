import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.functions import values as V


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    ("given", "key"),
    [
        ("  abc ", "ABC"), ("'00123", "123"), ("''5", "'5"), ("123.0", "123"), ("123.0.0", "123.0"), ("000", "0"), ("00a", "00A"), ("' 7", " 7"), ("", ""), (None, "NAN"), ("nan", "NAN"), (" 12\t", "12"), ("inv-001", "INV-001"),
    ],
)
def test_clean_key(spark, given, key):
    assert apply(spark, [given], V.clean_key) == [key]


def test_null_keys_can_stay_apart(spark):
    assert apply(spark, [None, "a"], lambda c: V.clean_key(c, None)) == [None, "A"]


def test_number_keys(spark):
    from pyspark.sql import types as T

    assert apply(spark, [1e7, 12.5, None, float("nan")], lambda c: V.clean_key(V.as_text(c, T.DoubleType())), "double") == ["10000000", "12.5", "NAN", "NAN"]


@pytest.mark.parametrize(
    ("text", "amount"),
    [
        ("1,234.50", 1234.5), ("$ 5", 5.0), ("(12.5)", -12.5), ("($1,000)", -1000.0), ("", None), ("n/a", None), ("nan", None), ("1d", None), ("1_000", 1000.0), ("-3", -3.0), (" 7 ", 7.0), (None, None), ("inf", float("inf")), ("1e3", 1000.0),
    ],
)
def test_parse_amount(spark, text, amount):
    assert apply(spark, [text], V.parse_amount) == [amount]


def test_amount_for_aging_reads_no_brackets(spark):
    assert apply(spark, ["(100)", "$1,000", "1 000"], lambda c: V.parse_amount(c, accounting=False, inner_space=False)) == [None, 1000.0, None]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2023-01-02", (2023, 1, 2)), ("02/01/2023", (2023, 1, 2)), ("1/2/2023", (2023, 2, 1)), ("13-02-2023", (2023, 2, 13)), ("Jan 5 2023", (2023, 1, 5)), ("20230107", (2023, 1, 7)), ("2023/03/04", (2023, 3, 4)), ("01/13/2023", (2023, 1, 13)),
        ("2023/01/02 10:30:00", (2023, 1, 2)), ("02/01/2023 10:30", (2023, 1, 2)), ("Jan 5, 2023", (2023, 1, 5)), ("5 Jan 2023", (2023, 1, 5)), ("05-Jan-2023", (2023, 1, 5)), ("January 5, 2023", (2023, 1, 5)), ("1/2/23", (2023, 2, 1)),
        ("02.01.2023", (2023, 1, 2)), ("Thu, 05 Jan 2023", (2023, 1, 5)), ("31/12/99", (1999, 12, 31)), ("2023-13-01", (2023, 1, 13)), ("2/1/2023 3:05 PM", (2023, 1, 2)), ("2023", (2023, 1, 1)), ("a/b/c", None), ("May 2023 x", None),
        ("31/02/2023", None), ("soon", None), ("", None), (None, None), ("2023-01-02 10:20:30", (2023, 1, 2)),
    ],
)
def test_parse_date(spark, text, day):
    got = apply(spark, [text], V.parse_date)[0]
    assert (got and (got.year, got.month, got.day)) == day


def test_time_of_a_date(spark):
    got = apply(spark, ["2023/01/02 10:30:05", "02/01/2023 3:05 PM", "Jan 5, 2023 12:10 AM"], V.parse_date)
    assert got == [dt.datetime(2023, 1, 2, 10, 30, 5), dt.datetime(2023, 1, 2, 15, 5), dt.datetime(2023, 1, 5, 0, 10)]


#: Spellings as statements have them: orders, month and year alone, names, ordinals, times before, after and among the date, runs of digits.
SPELLINGS = """
5th January 2023|Jan 2023|2023-01|01/2023|05Jan2023|3:00 PM 01/02/2023|10:30 2023-01-02|2023-01-02 10|January 2nd, 2023|2nd of January 2023|Monday 2 January 2023|2023 Jan 5|Jan-2023|2023/1|13/2023
2023-01-02 10:30:00.123456|2023-01-02 3 PM|2023-01-02 3PM|3pm 2 Jan 2023|5-Jan-23|Jan 5 23|May 2023 x|20230105T103000|20230105103000|202301051030|20230105T1030|20230105 10:30|20231305|310123|123456|230105|1/2|5 Jan|Jan 5|Jan|12
5.1.23|23-01-02|99-12-31|2 Jan 2023 10:30:05.5|2023-01-02 25:00|2023-01-02 10:60|Sept 5 2023|Sep. 5, 2023|1 2 2023|2023 1 2|Jan 5th, '23|02/01/2023 10h30|1st Mar 2020 1:02 am|Tue Jan 3 10:30:00 2023|31-1-2023|30/2023|0/1/2023
2/30/2023|12/31/2023|1672531200|44927|44927.0|2023.1|1.2023|2023 January|5 January, 2023|5/Jan/2023|2023-Jan-05|Jan/05/2023|2023-01-02T10|2023-01-02T10:30|32 Jan 2023|Jan 32 2023|Jan 99|1 2023|1-2023|2023-13|2023 13|2023-1-2
2023/1/2 10|2023/01/02 3 PM|2023.01.02 10:30|2023-01-13 3 PM|Jan 23|23 Jan|2023 5 Jan|5 2023 Jan|99/12/31|45-1-2|3:00PM 1/2/2023|10:30:00 5 Jan 2023|5 Jan 2023 at 10:30|5 Jan 2023, 10:30|Jan. 2023|January, 2023|2023-01-02 10:30 am
02/01/2023 10|5 Jan 2023 10|5.Jan.2023|1/Jan/23|Thursday, January 5, 2023|Thu 5 Jan 2023|2023-01-02 24:00|5 Jan 2023 13:00 PM|5 Jan 2023 0:30 AM|5 Jan 2023 0:30 PM|Thursday|5 th Jan 2023|5TH JAN 2023|Jan 5 , 2023|2023/Jan|1.1.2023 0:00:00
1/2/2023T10:30|31/2023|0/2023|12/2023|2023/12/1|Jan-05-23|Jan/23|23/Jan|5-1-45
Thu, 05 Jan 2023 10:00:00 GMT|2023-01-02T10:30:00Z|2023-01-02T10:30:00+02:00|Tue Jan  3 10:30:00 UTC 2023|2023-01-02 10:30 +0200|5 Jan 2023 10:30Z|2023-01-02Z|2023-01-02 UTC
"""


@pytest.mark.filterwarnings("ignore")
def test_dates_are_read_as_by_the_usual_mixed_parser(spark):
    texts = [t for line in SPELLINGS.strip().splitlines() for t in line.split("|")]
    stamp = lambda t: pd.to_datetime(pd.Series([t]), errors="coerce", format="mixed", dayfirst=True)[0]
    plain = lambda w: None if pd.isna(w) else (w.tz_convert(None) if w.tzinfo else w).to_pydatetime()
    assert list(zip(texts, apply(spark, texts, V.parse_date))) == [(t, plain(stamp(t))) for t in texts]


@pytest.mark.filterwarnings("ignore")
def test_written_dates_are_read_back_in_every_order(spark):
    """All orders of day, month (number, short or whole name) and year with all separators and times agree with that parser."""
    orders = ["{d} {b} {y}", "{b} {d} {y}", "{y} {b} {d}", "{d}{s}{m}{s}{y}", "{m}{s}{d}{s}{y}", "{y}{s}{m}{s}{d}", "{d}{s}{b}{s}{y}", "{d}{s}{m}{s}{t}"]
    texts = []
    for i, (d, m, y) in enumerate([(5, 1, 2023), (29, 2, 2024), (12, 12, 1999), (31, 10, 2001), (30, 2, 2023)]):
        for order in orders:
            for s in "-/.":
                for clock in ("{}", "{} 09:05", "{} 9:05:07 PM", "11:59 {}"):
                    texts.append(clock.format(order.format(d=d, m=m, y=y, t=f"{y % 100:02}", s=s, b=["Jan", "February", "dec", "OCT", "Feb"][i])))
    texts = sorted(set(texts))
    stamp = lambda t: pd.to_datetime(pd.Series([t]), errors="coerce", format="mixed", dayfirst=True)[0]
    want = [(t, None if pd.isna(w) else w.to_pydatetime()) for t, w in ((t, stamp(t)) for t in texts)]
    assert list(zip(texts, apply(spark, texts, V.parse_date))) == want


def test_age(spark):
    now = dt.datetime(2023, 5, 1)
    days = lambda c: V.age_days(V.parse_date(c), now)
    texts = ["2023-05-02", "2023-04-01", "2023-03-31", "2023-03-02", "2023-03-01", "2023-01-01", "2022-12-31", "x"]
    assert apply(spark, texts, days) == [-1, 30, 31, 60, 61, 120, 121, None]
    assert apply(spark, texts, lambda c: V.age_bucket(days(c))) == ["0-30", "0-30", "31-60", "31-60", "61-90", "91-120", "121+", "Unknown"]


def test_date_text(spark):
    assert apply(spark, ["2023-01-01 00:00:00", "2023-01-01 01:00:00", "nan", "NaT", None], V.date_text) == ["2023-01-01", "2023-01-01 01:00:00", "", "", ""]
    assert V.is_date_column("Width") and V.is_date_column("Due Date") and not V.is_date_column("Total")


def test_canonical_forms(spark):
    assert apply(spark, ["2023/1/2", "2-1-2023", " Ab ", "99/99/2023", "1/2/23"], V.canonical_date) == ["2023-01-02", "2023-01-02", "ab", "2023-99-99", "1/2/23"]
    assert apply(spark, ["2023-01-02 00:00:00", "abc", "3/2/2023"], V.canonical_text) == ["2023-01-02", "ABC", "2023-02-03"]


def test_rounding_is_half_even(spark):
    assert apply(spark, [0.125, 2.675, 1.005, -0.125], V.round2, "double") == [0.12, 2.68, 1.0, -0.12]


def test_fuzzy_text_and_money(spark):
    assert apply(spark, ["INV#001!", " É-x "], V.fuzzy_text) == ["inv 001", "é x"]
    assert apply(spark, [1234.5, -2.0, 0.0], V.money, "double") == ["$1,234.50", "$-2.00", "$0.00"]


def test_labels(spark):
    statuses = ["MISSING IN REF", "MATCH", "PARTIAL (Some Refs Missing)", "MISMATCH (Partial)", "NO DATA", "PARTIAL MATCH", "Underpaid (Short)"]
    assert apply(spark, statuses, L.status_class) == ["bad", "good", "warn", "bad", "neutral", "good", "bad"]
    assert apply(spark, [-1.0, 1.0, 0.01, 0.0], L.delta_class, "double") == ["negative", "positive", "neutral", "neutral"]
    assert apply(spark, ["🟢 Low", "🟡 Medium", "🟠 High", "🔴 Critical"], L.risk_class) == ["low", "medium", "high", "other"]
    assert apply(spark, ["🟢 Safe", "🟡 Attention Required", "🔴 High Risk", "⚪ Unknown"], L.aging_class) == ["safe", "attention", "risk", "other"]
    assert apply(spark, [0, 1, 2, None], L.duplicate_flag, "int") == [False, False, True, False]


@pytest.mark.parametrize(("given", "total"), [([], None), ([None], None), ([0.1] * 10, 1.0), ([1e13, *[0.01] * 1000], 1e13 + 10), ([1e25, -1e25, 0.5], 0.5), ([float("inf"), 1.0], float("inf"))])
def test_exact_sum(spark, given, total):
    frame = spark.createDataFrame([(v,) for v in given], "v double").coalesce(1)
    assert frame.agg(V.exact_sum(F.col("v"))).first()[0] == total
    assert frame.agg(V.exact_avg(F.col("v"))).first()[0] == (total / len(given) if total is not None else None)
