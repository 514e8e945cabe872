"""Detail view: the base table with every reference joined to it on cleaned keys.

Per-key facts of a reference (row count, whether it matched) are grouped on its own
side, with partial sums, so a hot key costs one partial row per task; the joined
table is not grouped again. All joins of a job are on one key, so each table is
shuffled once at most.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import NULL_KEY, age_bucket, age_days, as_text, clean_key, date_text, is_date_column, name, parse_date
from ..sources.readers import extracted, place, strict_subset
from ..sources.spec import FULL, JobSpec, RefSpec
from ..sources.tables import bucketed, written

KEY = "__key"
Refs = Sequence[tuple[RefSpec, DataFrame]]


def keyed(df: DataFrame, match: str, null_key: str | None = NULL_KEY) -> DataFrame:
    """df with its cleaned key; with ``null_key`` None, rows without a key meet nothing."""
    return df.withColumn(KEY, clean_key(as_text(name(match), df.schema[match].dataType), null_key))


def aged(df: DataFrame, date: str | None, as_of: dt.datetime) -> DataFrame:
    """Age bucket and age in days of a date column, put first."""
    if not date or date not in df.columns:
        return df
    days = age_days(parse_date(as_text(name(date), df.schema[date].dataType)), as_of)
    return df.select(age_bucket(days).alias("Age Bucket"), days.alias("Age (Days)"), "*")


def placed_ages(base: DataFrame, match: str, date: str, as_of: dt.datetime, null_key: str | None = NULL_KEY) -> DataFrame:
    """(key, days, place) of the rows of a base read from files, for the first age of each key."""
    rows = base.select(name(match), name(date), place().alias("__place"))
    return keyed(aged(rows, date, as_of), match, null_key).select(KEY, "Age (Days)", "__place")


def _rows(spec: RefSpec, df: DataFrame, null_key: str | None) -> DataFrame:
    """A reference's rows ready to join, with prefixed columns."""
    subset, _ = strict_subset(df, spec)
    return keyed(subset, spec.match, null_key).select(KEY, *[name(c).alias(f"{spec.name}_{c}") for c in extracted(spec)])


def _facts(spec: RefSpec, rows: DataFrame, on: Sequence[str] = (KEY,)) -> DataFrame:
    """Of each key of a reference the number of rows and whether it counts as matched."""
    first = name(f"{spec.name}_{extracted(spec)[0]}").isNotNull()
    return rows.where(F.col(KEY).isNotNull()).groupBy(*on).agg(F.count("*").alias(f"__n_{spec.name}"), F.max(first).alias(f"__hit_{spec.name}"))


def _apart(spec: RefSpec, rows: DataFrame) -> DataFrame:
    """Rows without a key, each a key of its own."""
    first = name(f"{spec.name}_{extracted(spec)[0]}").isNotNull()
    return rows.where(F.col(KEY).isNull()).withColumn(f"__n_{spec.name}", F.lit(1).cast("long")).withColumn(f"__hit_{spec.name}", first)


#: Heavy keys that may be broadcast.
FEW_KEYS = 100_000


def heavy_keys(view: DataFrame, rows: int) -> DataFrame | None:
    """(key, pieces) of the keys of more than ``rows`` rows, to be broadcast where they are few; None without any."""
    counted = view.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    found = written(counted.select(F.col(KEY).alias("__heavy"), F.ceil(F.col("n") / rows).alias("__pieces")), "heavy-keys")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= FEW_KEYS else found


def _dealt(df: DataFrame, heavy: DataFrame, copies: bool) -> DataFrame:
    """df with ``__piece``: rows of a heavy key are dealt to its pieces, or copied to each of them; 0 for other keys."""
    joined = df.join(heavy, F.col(KEY) == F.col("__heavy"), "left")
    last = F.coalesce("__pieces", F.lit(1)) - 1
    # rows without a key meet nothing, so they may be anywhere
    among = F.when(F.col(KEY).isNull(), FEW_KEYS).otherwise(last + 1)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), last)) if copies else F.pmod(F.monotonically_increasing_id(), among)
    return joined.withColumn("__piece", piece).drop("__heavy", "__pieces")


def detail(spec: JobSpec, base: DataFrame, refs: Refs, as_of: dt.datetime, null_key: str | None = NULL_KEY, skipped: Sequence[str] = (), heavy_rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Wide view, one row for each base row and match.

    With ``buckets``, each table is read and its keys cleaned once, and written in so many
    buckets by key; whatever is then asked of the view joins without an exchange. It pays
    where a view is used several times.

    With ``heavy_rows``, base rows of a key that has more are dealt to pieces of about so
    many, and the reference rows of these keys alone are copied to each piece, so no task
    joins a whole hot key. The keys are found by a count with partial sums.

    Left: rows of the base. Full: first the distinct keys of all tables, then base
    and references joined to them, which gives the rows of chained full joins but
    keeps one partitioning. With ``null_key`` None, rows without a key meet nothing and
    each stays a row. ``skipped`` references stay in the summary texts only.
    """
    view = keyed(aged(base, spec.base.date, as_of), spec.base.match, null_key)
    shown = [c for c in view.columns if c != KEY]
    tables = [(r, _rows(r, df, null_key)) for r, df in refs]
    alone = []
    heavy = heavy_keys(view, heavy_rows) if heavy_rows else None
    on, hot = [KEY], None
    if heavy is not None:
        on = [KEY, "__piece"]
        view = _dealt(view, heavy, copies=False)
    # facts are grouped before a hot key is copied to its pieces, or after that in place
    dealt = lambda df: df if heavy is None else _dealt(df, heavy, copies=True)
    if buckets:
        view = bucketed(view, "base", on, buckets)
        tables = [(ref, bucketed(dealt(rows), "reference", on, buckets)) for ref, rows in tables]
        sides = [(ref, rows, _facts(ref, rows, on)) for ref, rows in tables]
    else:
        sides = [(ref, dealt(rows), dealt(_facts(ref, rows))) for ref, rows in tables]
    if spec.how == FULL:
        view = view.withColumn("__base", F.lit(True))
        keys = view.select(*on)
        for _, _, facts in sides:
            keys = keys.union(facts.select(*on))
        if heavy is not None:
            # the base has rows of every heavy key, so these need no list of keys
            kept = lambda df, how: df.join(heavy, F.col(KEY) == F.col("__heavy"), how)
            hot, view, keys = kept(view, "left_semi"), kept(view, "left_anti"), kept(keys, "left_anti")
        if null_key is None:
            alone = [view.where(F.col(KEY).isNull()).drop("__piece"), *[_apart(ref, rows) for ref, rows, _ in sides]]
        view = keys.where(F.col(KEY).isNotNull()).distinct().join(view, on, "left")
        view = view if hot is None else view.unionByName(hot)
    for _, rows, facts in sides:
        view = view.join(facts, on, "left").join(rows, on, "left")
    for rows in alone:
        view = view.drop("__piece").unionByName(rows.drop("__piece"), allowMissingColumns=True)
    known = F.coalesce(F.col("__base"), F.lit(False)) if spec.how == FULL else F.lit(True)
    columns = []
    hits, counts = {}, {}
    for ref, _, _ in sides:
        n, hit = name(f"__n_{ref.name}"), name(f"__hit_{ref.name}")
        # a key that only a later reference brings has no count here
        known = known | n.isNotNull()
        count = F.when(known, F.coalesce(n, F.lit(0)))
        columns += [name(f"{ref.name}_{c}") for c in extracted(ref)] + [count.alias(f"{ref.name}_Match_Count")]
        hits[ref.name], counts[ref.name] = F.coalesce(hit, F.lit(False)), F.coalesce(n, F.lit(0))
    ordered = [r.name for r in spec.refs]
    matched = F.concat_ws(", ", *[F.when(hits[r], r) for r in ordered if r in hits]) if hits else F.lit("")
    said = [F.when(counts.get(r, F.lit(0)) == 0, f"{r}: no entry").otherwise(F.concat(F.lit(f"{r}: "), counts.get(r, F.lit(0)).cast("string"), F.lit("x"))) for r in ordered]
    own = [F.coalesce(as_text(name(c), base.schema[c].dataType), F.col(KEY)).alias(c) if spec.how == FULL and c == spec.base.match else name(c) for c in shown]
    out = view.select(*own, *columns, matched.alias("Match Source"), *([F.concat_ws(", ", *said).alias("Duplicate Summary")] if said else []))
    return out.select(*[date_text(as_text(name(c), out.schema[c].dataType)).alias(c) if is_date_column(c) else name(c) for c in out.columns])


def exact_join(base: DataFrame, refs: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Left joins on raw values: (reference, table, base column, reference column) each; reference columns are prefixed."""
    out = base
    for source, df, on, column in refs:
        side = df.select(*[name(c).alias(f"{source}_{c}") for c in df.columns])
        out = out.join(side, name(on) == name(f"{source}_{column}"), "left")
    return out


def missing_in_ref(base: DataFrame, match: str, ref: DataFrame, ref_match: str) -> DataFrame:
    """Base rows whose cleaned key the reference lacks."""
    return keyed(base, match).join(keyed(ref, ref_match).select(KEY), KEY, "left_anti").drop(KEY)


def found_in_ref(base: DataFrame, match: str, ref: DataFrame, ref_match: str) -> DataFrame:
    return keyed(base, match).join(keyed(ref, ref_match).select(KEY), KEY, "left_semi").drop(KEY)
