"""A corpus cleaning pipeline over documents, as a list of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Repeated rows are separate documents to the classifier;
line dedup counts copies once; near-dedup keeps one row of each group, an exact repeat included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_dedup, pieces, quality, simhash
from ledgerloom.llm.shared import read, small_batches, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of sf_dir, where docs have them."""
    small_batches(spark)
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model, out="__quality").where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a set share of a source's distinct texts go; whole copies are left to near-dedup.

    Lines of 50 words or more stay in one text of a source.
    """
    docs = line_dedup.drop_repeats(docs, host="source", text="text", key="doc_id")
    return line_dedup.drop_boilerplate(docs, host="source", text="text", key="doc_id", copies_once=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group stays, of equally long ones the smallest doc_id.

    Line dedup has left a long passage in one document only; the longest of near copies is the one that has it.
    """
    small_batches(spark)
    return simhash.one_of_each(docs, longest=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left."""
    small_batches(spark)
    return pieces.encode(docs, keep=["doc_id"]).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: The classifier is learned and the pieces are chosen by scores, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
