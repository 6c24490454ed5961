"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.llm import decontaminate, mixing, quality_rules, simhash, token_files
from retrace.llm.queries import tokenizer_path
from retrace.llm.scratch import new_path, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, lines above the limits are taken out of the others."""
    return quality_rules.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, a similarity of about 0.8)."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources' blocks are placed; the files keep that order."""
    return mixing.interleaved(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture, read back with a checksum of each document's ids."""
    path = new_path(spark, "token-files")
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    token_files.write(docs, path, tokenizer_path(), order=order)
    return token_files.checksums(token_files.read(spark, path))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to weights", mix),
    ("token-id output", token_output),
]

#: near-duplicate groups and token ids are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
