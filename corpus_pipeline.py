"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, binary output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's result as Parquet in the shared folder
and reads it again as the next one's documents. A stage's own scratch tables are deleted as
soon as its result is written; what else the application has written stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm import common, decontaminate, lang_id, mixing, near_dup, token_output

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go; lang of the others is the predicted one.

    The model learns from the rows that ``op9_lang_id`` learns from.
    """
    held = F.coalesce(common.crc32_mod("doc_id", 4) == 2, F.lit(True))
    model = lang_id.fit(docs, ~held)
    found = lang_id.predict(docs.select(*DOCUMENT), model, list(DOCUMENT), text_too=True)
    return found.where(~F.col("lang_rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the least doc_id of each class stays."""
    return near_dup.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents in which a test item stands go."""
    return decontaminate.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents as often as the mixture takes them."""
    return mixing.mixed(docs)


def binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output: doc_id, start, n_tokens and ids_crc32, read back."""
    return token_output.encode_documents(docs)


STAGES = [("language ID", languages), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmarks), ("mixing sources to target weights", mixture), ("token-ID / binary output", binary)]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again before the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.own_scratch(spark) as scratch:
            docs = common.kept(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
        common.purge(scratch)
    return STAGES[-1][1](spark, docs, sf_dir)
