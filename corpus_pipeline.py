"""Corpus preparation in stages, each one call of a training-data operator.

A stage takes the documents that its predecessor kept and returns the columns
of ``documents``; the last one returns packed pieces. Rows of one ``doc_id`` are
judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.llm.common import table, written
from rateline.llm.decontaminate import decontaminate, row_hash
from rateline.llm.language import UNKNOWN, identify_languages, train, training_rows
from rateline.llm.line_dedup import dedup_lines
from rateline.llm.packing import pack
from rateline.llm.simhash import near_duplicates

#: Documents whose language the field is less sure of are rejected; of four languages, a guess has 0.25.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that the field tells from the others. It learns from all that have ``lang``; without any, nothing is rejected but texts without a letter."""
    model = train(training_rows(docs))
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = identify_languages(docs, model, keep=tuple(docs.columns))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on 10 sites or more, but for each line's first place."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their 5-word shingles, the row of the least ``doc_id`` (nulls last), and of these of the least text hash; of rows of that same id and text, the one whose other columns are least."""
    row = row_hash("text")
    first = near_duplicates(docs).where("is_first").select(F.col("doc_id").alias("first"), "text_hash").distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first")) & (row == F.col("text_hash")), "left_semi")
    if kept.groupBy("doc_id", row.alias("row")).count().where("count > 1").isEmpty():
        return kept
    return kept.groupBy("doc_id", row.alias("row")).agg(F.min(F.struct(*docs.columns)).alias("least")).select("least.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 10 words with the benchmark."""
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad"), "text_hash")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad")) & (row_hash("text") == F.col("text_hash")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens at most."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: A trained field, SimHash and token ids have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
