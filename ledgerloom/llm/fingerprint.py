"""Document fingerprints: one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once; the top bits choose one of 256 bins and
the smallest hash in a bin is its value. An empty bin takes the value of a
filled one: hashes of (empty bin, attempt) name bins until one is filled, so each
empty bin draws its donor independently, as optimal densification asks. After 24
attempts the filled bins are ranked by a hash instead, so a donor is always found. The low 8 bits of each value are stored as hex. Of two fingerprints, the
share of equal bins is corrected for chance agreement of 8-bit values.

Defined cases: null text counts as empty; a text without words has the empty
fingerprint, which is like itself (1.0) and unlike any other (0.0); a text of
fewer than five words is one shingle. Words are runs of non-space characters,
lower-cased. Repeated rows get rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import rolling_hashes

SHINGLE = 5
BITS_OF_BIN = 8
BINS = 1 << BITS_OF_BIN
STORED_BITS = 8
#: Hashes of (empty bin, attempt) to try before all filled bins are ranked by hash.
PROBES = 24
HEX = [f"{v:0{STORED_BITS // 4}x}" for v in range(1 << STORED_BITS)]


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BITS_OF_BIN)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The largest hash of each bin: sorted in with the shingles, it marks a bin as empty.
EMPTY = [_signed((b + 1 << 64 - BITS_OF_BIN) - 1) for b in range(BINS)]


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the densified low bytes (array of 256), or an empty array."""
    words, grams, least = f"__{out}_words", f"__{out}_grams", f"__{out}_least"
    df = df.withColumn(words, F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""), lambda w: F.xxhash64(w)))
    size = F.size(words)
    shingles = F.when(size >= SHINGLE, rolling_hashes(F.col(words), SHINGLE)).otherwise(F.array(F.xxhash64(F.col(words))))
    df = df.withColumn(grams, F.sort_array(F.concat(shingles, F.lit(EMPTY))))
    # sorted by hash, so the first of each bin is its minimum, and every bin has one
    df = df.withColumn(least, F.filter(grams, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(grams), i - 1)))))
    df = df.withColumn(least, F.transform(least, lambda x: F.when(x.bitwiseAND(EMPTY[0]) != EMPTY[0], x.bitwiseAND((1 << STORED_BITS) - 1).cast("int"))))

    def probe(i: Column, attempt: int) -> Column:
        return F.get(F.col(least), F.pmod(F.xxhash64(i, F.lit(attempt)), F.lit(BINS)).cast("int"))

    def nearest(i: Column) -> Column:
        filled = F.filter(F.transform(least, lambda x, j: F.struct(F.xxhash64(i, j), x.alias("x"))), lambda s: s["x"].isNotNull())
        return F.array_min(filled)["x"]

    dense = F.transform(least, lambda x, i: F.coalesce(x, *[probe(i, t) for t in range(PROBES)], nearest(i)))
    return df.withColumn(out, F.when(size > 0, dense).otherwise(F.array().cast("array<int>"))).drop(words, grams, least)


def packed(bins: Column) -> Column:
    """The bins' low bits as one lowercase hex string."""
    return F.array_join(F.transform(bins, lambda v: F.get(F.lit(HEX), v)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two densified arrays, 0 to 1, corrected for b-bit chance matches."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / BINS
    chance = 2.0**-STORED_BITS
    corrected = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(corrected)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return with_bins(docs.select("doc_id", "text"), "text", "bins").select("doc_id", packed(F.col("bins")).alias("fingerprint"))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds next_<column> from the following row in descending doc_id order; the first follows the last.

    The rows are dealt to ranges of doc_id whose bounds are doc_ids themselves, so
    the first row of a range is known and also goes to the range before it. One
    shuffle, no window over the whole table. Equal doc_ids follow each other in the
    order of ``columns``. A null doc_id has no place in the order and no next row.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / buckets) for i in range(1, buckets + 1)]), F.lit(100 * buckets))
    bounds = sorted({*(docs.agg(cuts).first()[0] or []), *(x for x in docs.agg(F.max("doc_id")).first() if x is not None)}, reverse=True)
    if not bounds:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    at = F.lit(bounds)
    # how many bounds are >= doc_id, by binary search
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    taken = lambda n, s: (n + s <= len(bounds)) & (F.get(at, n + s - 1) >= F.col("doc_id"))
    count = F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when(taken(n, s), n + s).otherwise(n))
    placed = docs.withColumn("__at", F.coalesce(count, F.lit(0)) - 1).withColumn("__bound", F.get(at, F.greatest(F.col("__at"), F.lit(0))) == F.col("doc_id"))
    place = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    last = F.lit(len(bounds) - 1)
    places = F.filter(
        F.array(
            F.when(F.col("doc_id").isNotNull(), place(F.col("__at"), 0)).otherwise(place(F.lit(-1), 0)),
            F.when(F.col("__bound") & (F.col("__at") > 0), place(F.col("__at") - 1, 1)),
            F.when(F.col("__bound") & (F.col("__at") == 0), place(last, 1)),
        ),
        lambda p: p.isNotNull(),
    )
    dealt = placed.withColumn("__place", F.explode(places)).withColumn("__bucket", F.col("__place.bucket"))
    order = W.partitionBy("__bucket").orderBy(F.col("__place.guest"), F.desc("doc_id"), *columns)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)))
    return dealt.where(F.col("__place.guest") == 0).select(*docs.columns, *[f"next_{c}" for c in columns])


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n_chars / 3) characters
    replaced by as many first ones of the next document (all, if it has fewer).
    """
    own = with_bins(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "bins")
    both = with_next(own, ["text", "bins"]).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    both = with_bins(both.withColumn("edited", edited), "edited", "edited_bins")
    nothing = F.array().cast("array<int>")
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.coalesce("next_bins", nothing)).alias("near_next"),
    )
