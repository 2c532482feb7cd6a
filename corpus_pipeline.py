"""The corpus pipeline: language ID, line dedup, near-duplicate removal, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. No
stage samples or caps its input. Counting them twice is avoided by writing each stage's rows once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import jaccard, langid, lines, packing, suffixes
from rankspark.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least closeness (1: equal profiles, 0: no n-gram in common) to the best language that a document must have. On sf0.01
#: the first three words of every document have at least 0.46, whole documents 0.41; random letters, base64 and languages
#: that are not learned and not related have up to 0.24.
CLOSENESS = 0.27


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or unlike every language; the others get the predicted language.

    Null and empty texts have no letter; without one non-null language every document goes; rows with null or repeated ids are
    judged one by one.
    """
    judged = langid.identify(docs, F.col("lang").isNotNull(), keep=COLUMNS)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("closeness") >= CLOSENESS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove line chunks that occurred before.

    A null text stays null, with null ``n_chars``; of repeated rows, and rows with null or equal ids, see ``lines``.
    """
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Rows with a null id all stay; rows that repeat an id stay or go together; a null or empty text is linked with nothing.
    """
    firsts = jaccard.linked(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every byte that a repeated string of 200 bytes covers; the documents stay.

    A null text comes back empty; repeated rows lose all bytes of their windows, as each is a text of its own.
    """
    out = suffixes.remove_repeats(docs, 200, keep_text=True, carry=("lang", "source"))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 ids.

    A null or empty text is its end id alone; rows with null or repeated ids are documents of their own; other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("repeated_strings", repeat_stage), ("packing", packing_stage)]
#: SQL cannot express the stages (rank profiles, tokenization); a test runs planted cases, the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
