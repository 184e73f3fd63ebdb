"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage gets the documents that its predecessor kept, written as Parquet and read again. The stages return the columns of
their input, whatever else it has; names that operators use inside are set apart first. Rows without text, or with an empty one, end
at the first stage (they have no language); rows without doc_id, repeated rows and rows of one doc_id with several texts
are handled as the operators state it; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import decontamination, language, packing, paragraphs, simhash
from ashlar.llm.common import stage, table

#: Documents whose language scores below this are rejected, like those without a letter.
LEAST_SCORE = 0.4


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from the stage's own input."""
    # Written once, so that workers are handed the long texts in small batches.
    labelled = stage(language.identify(docs, language.train(docs)), "labelled")
    return labelled.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Groups are op7's: fingerprints of four-word shingles, linked at up to 4 differing bits.
    """
    return simhash.first_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and verbatim runs of over 50 words that an earlier document holds."""
    return paragraphs.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_identified),
    ("SimHash near-dedup", keep_first_of_group),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has neither the network nor XXH64; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
