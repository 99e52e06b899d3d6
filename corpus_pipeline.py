"""From documents to training sequences: toxic documents go, one of each group of near copies stays, repeated passages
are cut, sources are mixed to target weights, and the rest is packed into sequences,
stretch by stretch of the mixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.mixing import mix
from cohortry.llm.near_dedup import near_duplicates
from cohortry.llm.packing import pack
from cohortry.llm.queries import toxicity_model
from cohortry.llm.substring_dedup import drop_repeats
from cohortry.llm.toxicity import without_toxic
from cohortry.llm.written import numbered_as_written
from cohortry.sources.tables import load
from cohortry.sources.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STRETCH_ROWS = 1024  # documents packed together: 16 blocks of the mix


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic, unchanged.

    A text without a word of an example, a null or an empty one among them, has no such neighbours and stays. An empty table stays empty.
    """
    return without_toxic(docs, toxicity_model(spark, sf_dir)).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, unchanged; those without id or words stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has; ``n_chars`` follows the text.

    A null text is empty afterwards. A document of which nothing is left stays as an empty one.
    """
    kept = drop_repeats(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in an order in which sources follow their target weights.

    A null source is a source of its own; texts and ids may be null or repeated. An empty table stays empty.
    """
    return mix(docs).orderBy("slot", "row_in_block").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a training sequence of at most 4096 tokens.

    Each stretch of the written order is packed for itself, so sequences in order of their ids follow the mix.
    A null text is an empty one and has a piece with the closing token alone. An empty table gives no pieces.
    """
    numbered = numbered_as_written(docs, "__row")
    return pack(numbered.withColumn("__stretch", F.expr(f"__row div {STRETCH_ROWS}")), stretch="__stretch")


STAGES = [
    ("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources), ("packed", packed),
]

#: The first stage learns from labelled examples, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
