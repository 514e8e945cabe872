"""Line dedup by site-relative frequency.

Within each host, the number of pages that contain a line is divided by the
host's number of pages; lines above ``ratio`` (and on at least ``min_pages``
pages) are boilerplate and dropped from every page of that host.

Defined cases: a page is a row, so repeated rows count as pages, unless
``copies_once`` is set: then a page is a distinct text of its host. Null text stays
null and has no lines; blank lines are never counted or dropped; null hosts form
one host of their own. A page of nothing but boilerplate keeps its row with an
empty text. Other columns pass through. Lines are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

RATIO = 0.02
MIN_PAGES = 3
#: Words of a line that is a passage: it needs two texts of a host, not a share of them.
PASSAGE = 50


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _key(host: str) -> Column:
    return F.struct(F.col(host).isNull().alias("none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))


def _line_hashes(text: str) -> Column:
    full = F.filter(_lines(text), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))


def _page(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(site, line, n_pages, n_site): the hashes of lines above the ratio.

    With ``copies_once``, exact copies of a text on one host count as one page.

    Counts are summed on each map task before the shuffle, so a hot host or line
    sends one row per task.
    """
    lines = pages.select(_key(host).alias("site"), _page(text).alias("page"), F.explode(_line_hashes(text)).alias("line"))
    sites = pages.select(_key(host).alias("site"), _page(text).alias("page"))
    if copies_once:
        lines, sites = lines.distinct(), sites.distinct()
    per_line = (
        lines.groupBy("site", "line")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    per_site = sites.groupBy("site").agg(F.count("*").alias("n_site"))
    return per_line.join(per_site, "site").where(F.col("n_pages") > ratio * F.col("n_site"))


def passages(pages: DataFrame, host: str, text: str, key: str, n_words: int = PASSAGE) -> DataFrame:
    """(site, line, keep): lines of at least ``n_words`` words in two or more distinct texts of a host.

    ``keep`` is the text with the smallest key; it (and its exact copies) keeps the line.
    """
    long = F.filter(_lines(text), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= n_words)
    lines = F.array_distinct(F.transform(long, lambda x: F.xxhash64(x)))
    first = F.struct(F.col("key").isNull().alias("none"), "key", "page")
    return (
        pages.select(_key(host).alias("site"), _page(text).alias("page"), F.col(key).alias("key"), F.explode(lines).alias("line"))
        .groupBy("site", "line")
        .agg(F.min(first).alias("first"), F.min("page").alias("low"), F.max("page").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("site", "line", F.col("first.page").alias("keep"))
    )


def drop_repeats(pages: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", n_words: int = PASSAGE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with long lines that repeat on a host left in its first text only, at any share of its pages."""
    found = written(passages(pages, host, text, key, n_words), "passages")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    marked = pages.withColumn("__site", _key(host)).withColumn("__page", _page(text))
    lines = marked.select("__site", "__page", F.explode(_line_hashes(text)).alias("line")).withColumnRenamed("__site", "site")
    drops = (
        lines.join(found, ["site", "line"])
        .where(F.col("__page") != F.col("keep"))
        .groupBy(F.col("site").alias("__site"), "__page")
        .agg(F.collect_set("line").alias("__drop"))
    )
    drops = written(drops, "passage-drops")
    if drops.count() <= broadcast_rows:
        drops = F.broadcast(drops)
    marked = marked.join(drops, ["__site", "__page"], "left")
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("__drop"), F.xxhash64(x)))
    return marked.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*pages.columns)


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    key: str = "doc_id",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_rows: int = BROADCAST_ROWS,
    copies_once: bool = False,
) -> DataFrame:
    """pages with the boilerplate lines taken out of ``text``.

    Up to ``broadcast_rows`` boilerplate lines are broadcast, so texts are not
    shuffled; beyond that the lines are joined by shuffle and their hashes brought
    back to the page by ``key``.
    """
    columns = pages.columns
    found = written(boilerplate(pages, host, text, ratio, min_pages, copies_once).select("site", "line"), "boilerplate")
    marked = pages.withColumn("__site", _key(host))
    if found.count() <= broadcast_rows:
        per_site = found.groupBy(F.col("site").alias("__site")).agg(F.collect_list("line").alias("__drop"))
        marked = marked.join(F.broadcast(per_site), "__site", "left")
    else:
        lines = marked.select(F.col(key).alias("__key"), F.col("__site").alias("site"), F.explode(_line_hashes(text)).alias("line"))
        per_page = (
            lines.join(found, ["site", "line"])
            .groupBy("__key", F.col("site").alias("__page_site"))
            .agg(F.collect_set("line").alias("__drop"))
        )
        marked = marked.join(per_page, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__site") == F.col("__page_site")), "left")
    # the page's own part of the host's list, by one hash set, so that lines aren't held against the whole list
    marked = marked.withColumn("__hit", F.when(F.col("__drop").isNotNull(), F.array_intersect(_line_hashes(text), "__drop")))
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__hit"), F.xxhash64(x)))
    cleaned = F.when(F.col("__hit").isNull() | (F.size("__hit") == 0), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return marked.withColumn(text, cleaned).select(*columns)
