"""From raw documents to token ids: language, lines, near duplicates, benchmark overlap, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import table, written
from noviscan.llm.byte_bpe import bpe_round_trip
from noviscan.llm.decontamination import drop_contaminated
from noviscan.llm.jaccard_join import keep_one_of_each
from noviscan.llm.language_id import keep_identified
from noviscan.llm.line_dedup import drop_repeated_lines


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: documents with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and the ids turned
    back: the hash of their bytes, and whether these are the text's."""
    equal = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return bpe_round_trip(docs).select(
        *docs.columns, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), equal.alias("decoded_equal")
    )


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Models, edit distances and token ids are beyond SQL; the tests follow every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
