"""From raw documents to token ids: five stages, each a Parquet table made from all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm.bpe import encode
from reelmill.llm.common import written
from reelmill.llm.linededup import dedup_lines
from reelmill.llm.mixing import Mix, take_mix
from reelmill.llm.nearcopies import near_copies
from reelmill.llm.queries import domain_of
from reelmill.llm.simhash import keep_one
from reelmill.llm.toxicity import without_toxic
from reelmill.session import table

#: English twice the other languages, at nine tenths of the tokens; no document is taken twice.
MIX = Mix(weights=tuple((f"d{d}/en", 2.0) for d in range(4)), budget=0.9, epochs=1, seed="pipeline-1", levels=("__domain", "lang", "source"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text is predicted toxic go.

    Null and empty texts, null ids and repeated rows are judged like any other; an empty table stays empty.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; every document stays, with the text that is left.

    Rows with a null id count for no line and lose none; a null text becomes an empty one.
    """
    made = dedup_lines(docs)
    kept = F.col("__lines.kept")
    return made.withColumns({"text": kept, "n_chars": F.length(kept).cast("long")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are alike to 0.8 or more, directly or over others.

    That is the one of the least id, and of rows that share it the least text; rows with a null id stay.
    """
    return keep_one(docs, near_copies(docs, similarity=0.8))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each domain, language and source, the documents that its share of the budget takes.

    Null values are a child of their own; rows that share an id, or have none, are taken together within their leaf.
    """
    return take_mix(docs.withColumn("__domain", domain_of(F.col("source"))), MIX).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to; null and empty texts have no ids."""
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: SQL can't express a fitted model; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
