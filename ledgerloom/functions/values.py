"""Column expressions that turn raw cells into keys, amounts, dates and labels.

All are built from Spark's own functions, so they stay inside compiled stages.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_KEY = "NAN"
BUCKETS = ["0-30", "31-60", "61-90", "91-120", "121+"]
UNKNOWN = "Unknown"

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
#: A year-first date whose order is year, month, day: nothing but an ISO time follows it.
YEAR_FIRST = r"^\d{4}([-/. ]?)\d{1,2}\1\d{1,2}([ T]\d{1,2}(:?\d{2}(:?\d{2}(\.\d+)?)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"
#: A time of day, with half and zone, at any place of a date text.
CLOCK = r"(?:^|[\sT,]+)(?:at\s+)?(\d{1,2})(?:\s*([AaPp])[Mm]|[:h](\d{2})(?::(\d{2}(?:\.\d{1,9})?))?(?:\s*([AaPp])[Mm])?)(?:\s?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?(?=$|[\s,])"
#: What a date text says besides its date: weekday, ordinal ending, "of", mark of a short year.
NOISE = r"(?i)\b(mon|tue(s)?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?\b\.?|(?<=\d)\s?(st|nd|rd|th)\b|\bof\b|'(?=\d{2}\b)"


def name(column: str) -> Column:
    """A column by its literal name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def as_text(value: Column, kind: T.DataType) -> Column:
    """A cell as text; whole floating numbers without exponent or decimals."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        plain = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        return F.when(F.isnan(value), F.lit(None)).when(whole, value.cast("bigint").cast("string")).otherwise(plain)
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")


def clean_key(text: Column, null_key: str | None = NULL_KEY) -> Column:
    """Comparable key: outer space, one leading quote, one trailing ``.0`` and leading zeros go; upper case.

    A null key becomes ``null_key``, so null keys meet each other; with None they stay null.
    """
    key = F.regexp_replace(F.regexp_replace(strip(text), "^'", ""), r"\.0$", "")
    digits = F.coalesce(F.nullif(F.regexp_replace(key, "^0+", ""), F.lit("")), F.lit("0"))
    key = F.upper(F.when(key.rlike(r"^[0-9]+$"), digits).otherwise(key))
    return key if null_key is None else F.coalesce(key, F.lit(null_key))


def number(text: Column) -> Column:
    """Plain number syntax only; null for anything else, NaN included."""
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    value = F.when(plain.rlike(r"[dDfF]$") & ~F.lower(plain).rlike(r"inf$"), F.lit(None)).otherwise(plain).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_amount(text: Column, accounting: bool = True, inner_space: bool = True) -> Column:
    """Amount of a text with thousands commas, dollar signs and, if ``accounting``, negative brackets."""
    bare = strip(F.regexp_replace(text, r"[,$ ]" if inner_space else r"[,$]", ""))
    if accounting:
        bare = F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return number(bare)


def amount(value: Column, kind: T.DataType, **how: bool) -> Column:
    return F.when(~F.isnan(value.cast("double")), value.cast("double")) if isinstance(kind, T.NumericType) else parse_amount(value.cast("string"), **how)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _year_month_day(parts: Column, day_second: Column) -> Column:
    """``y-m-d`` from the parts of a date text: day first where ambiguous, month first where only that fits; null if neither.

    ``day_second`` tells that a leading year is followed by the day where both orders fit.
    """
    a, b, c = each = [F.get(parts, i) for i in range(3)]
    # by position of the part
    value = [x.try_cast("int") for x in each]
    full, number, named = ([x.rlike(p) for x in each] for p in (r"^\d{4}$", r"^\d{1,2}$", MONTH))
    month = [((F.position(F.lower(F.substring(x, 1, 3)), F.lit("".join(MONTHS))) + 2) / 3).cast("int").cast("string") for x in each]
    # a two-digit year lies less than fifty years ahead
    soon = F.year(F.current_date()) - 1950
    year = [F.when(f, x).when(n, (v + F.when(v >= soon, 1900).otherwise(2000)).cast("string")) for x, v, f, n in zip(each, value, full, number)]
    dash, first = F.lit("-"), F.lit("1")
    date = lambda y, m, d: F.concat(y, dash, m, dash, d)
    # no day or month: four digits, or two above 31
    only_year = [f | (n & (v > 31)) for f, n, v in zip(full, number, value)]
    turned = F.when(day_second | ~full[0], value[2] <= 12).otherwise(value[1] > 12)
    day_month_year = date(year[2], b, a)
    three = (
        F.when(only_year[0] & number[1] & number[2], F.when(turned, date(year[0], c, b)).otherwise(date(year[0], b, c)))
        .when(only_year[0] & named[1], date(year[0], month[1], c))
        .when(only_year[0] & named[2], date(year[0], month[2], b))
        .when(named[0] & number[1], date(year[2], month[0], b))
        .when(number[0] & named[1], date(year[2], month[1], a))
        .when(number[0] & full[1] & named[2], date(b, month[2], a))
        .when(number[0] & number[1], F.when((value[1] <= 12) | (value[0] > 12), day_month_year).otherwise(date(year[2], a, b)))
    )
    two = (
        F.when(named[0] & only_year[1], date(year[1], month[0], first))
        .when(full[0] & named[1], date(a, month[1], first))
        .when(full[0] & number[1], date(a, b, first))
        .when(number[0] & full[1], date(b, a, first))
    )
    n = F.size(parts)
    return F.when(n == 3, three).when(n == 2, two).when((n == 1) & full[0], date(a, first, first))


def _spelled_date(text: Column) -> Column:
    """Timestamp of a stripped date text in any order of its parts, its time before, after or among them."""
    day_second = ~text.rlike(YEAR_FIRST)
    # digits in one run, and an hour alone behind a whole date
    t = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2}))(\d{2})$", "$1-$2-$3 $4:$5:$6")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2}))$", "$1-$2-$3 $4:$5")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{2})(\d{2})(\d{2})$", "$1 $2 $3")
    t = F.regexp_replace(t, r"^(\d{1,2}[-/.\s]+(?:\d{1,2}|[A-Za-z]+)[-/.\s]+\d{4}) (\d{1,2})$", "$1 $2:00")

    def read(t: Column) -> Column:
        day = F.regexp_replace(F.regexp_replace(t, CLOCK, " "), NOISE, "")
        day = F.regexp_replace(day, r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)", " ")
        day = F.regexp_replace(day, r"^[\s.,]+|[\s.,]+$", "")
        ymd = F.when(~day.rlike(r"^\d{1,2}\.\d{4}$"), _let(F.split(day, r"[\s.,/-]+"), lambda parts: _year_month_day(parts, day_second)))
        hour, half, minute, second, later_half, zone = (F.regexp_extract(t, CLOCK, i) for i in range(1, 7))
        half, h = F.lower(F.concat(half, later_half)), hour.try_cast("int")
        h = F.when(half == "", h).when(h <= 12, h % 12 + F.when(half == "p", 12).otherwise(0))
        or_zero = lambda x: F.when(x == "", "00").otherwise(x)
        offset = F.when(zone.rlike("^[A-Z]"), "Z").otherwise(F.regexp_replace(zone, r"(\d{2}):?(\d{2})", "$1:$2"))
        clock = F.when(hour == "", "").otherwise(F.concat(F.lit(" "), h.cast("string"), F.lit(":"), or_zero(minute), F.lit(":"), or_zero(second), offset))
        return F.concat(ymd, clock).try_cast("timestamp")

    return _let(t, read)


def parse_date(text: Column) -> Column:
    """Timestamp of a date text in mixed formats, with or without a time, day first where ambiguous; null if none fits.

    Parts may stand in any order that leaves no doubt; a month without a day means its
    first day. Texts without a year, a time alone and ``now`` or ``today`` are no dates.
    """
    t = strip(text)
    # the common orders in compiled code; what they leave goes through the parts
    iso = F.regexp_replace(t, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)", "$3-$2-$1")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2})$", "$1:00")
    iso = F.when(iso.rlike(ISO), iso.try_cast("timestamp"))
    return F.coalesce(iso, _spelled_date(t))


def age_days(when: Column, as_of: dt.datetime | Column) -> Column:
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(when)) / F.lit(86_400_000_000)).cast("int")


def age_bucket(days: Column) -> Column:
    out = F.when(days <= 30, BUCKETS[0])
    for label, top in zip(BUCKETS[1:], (60, 90, 120, None)):
        out = out.when(days <= top if top else days.isNotNull(), label)
    return out.otherwise(UNKNOWN)


def is_date_column(column: str) -> bool:
    """By name only, so ``Width`` is one too."""
    return any(k in column.lower() for k in ("date", "dt"))


def date_text(text: Column) -> Column:
    """Date cell for display: midnight is cut off, missing is empty."""
    return F.regexp_replace(F.when(text.isin("nan", "NaT"), "").otherwise(F.coalesce(text, F.lit(""))), r"\s+00:00:00$", "")


def _iso_literal(text: Column, otherwise: Column) -> Column:
    ymd, dmy = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    part = lambda p, i, n: F.lpad(F.regexp_extract(text, p, i), n, "0")
    joined = lambda p, order: F.concat_ws("-", part(p, order[0], 4), part(p, order[1], 2), part(p, order[2], 2))
    return F.when(text.rlike(ymd), joined(ymd, (1, 2, 3))).when(text.rlike(dmy), joined(dmy, (3, 2, 1))).otherwise(otherwise)


def canonical_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of a date literal (not validated), else the text in lower case."""
    t = strip(text)
    return _iso_literal(t, F.lower(t))


def canonical_text(text: Column) -> Column:
    """Comparable form of a text field: no midnight, ISO dates, else upper case."""
    t = F.replace(strip(text), F.lit(" 00:00:00"), F.lit(""))
    return _iso_literal(t, F.upper(t))


def round2(x: Column) -> Column:
    return F.bround(x, 2)


def exact_sum(x: Column) -> Column:
    """Sum of the numbers as they are written, so cents are right however many rows there are and in whatever order they come; null if there are none.

    Doubles are added as decimals (to ten places, below 10^18); larger or infinite ones in the plain way.
    """
    fixed = x.try_cast("decimal(28,10)")
    near, far = F.sum(fixed).cast("double"), F.sum(F.when(fixed.isNull(), x.cast("double")))
    return F.coalesce(near + far, near, far)


def exact_avg(x: Column) -> Column:
    n = F.count(x)
    return exact_sum(x) / F.when(n > 0, n)


def fuzzy_text(text: Column) -> Column:
    """Lower case with every other sign than letters and digits as space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", " ")))


def money(x: Column) -> Column:
    return F.concat(F.when(x < 0, "$-").otherwise("$"), F.format_number(F.abs(x), 2))
