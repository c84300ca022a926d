"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes all documents that the one before it kept, and is a job of its own: its result is written to the shared folder and read again.
All but the last return the columns of ``documents``.

Defined cases, for every stage: rows with the same doc_id count as one document in the stages that drop documents, which keep or drop them together
(quality alone judges each row by its text); a null doc_id is an id like any other; null and empty texts are documents; other columns may have any names and are kept as
they are; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, pii, quality
from tidemark.llm._spark import clear, shared_dir, table, written
from tidemark.llm.decontaminate import leaks
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.queries import PREDICT_AT, word_bpe
from tidemark.plans.session import ship


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects: a score under ``PREDICT_AT``.

    Equal texts are judged alike; null and empty texts have a score too.  Without labels, all scores are the prior share and nothing is dropped or
    everything is, by the same threshold."""
    ship(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= PREDICT_AT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the one with the smallest id: five-word shingles, similarity 0.8.

    Documents without words are in no group and stay.  Rows of the id that a group keeps all stay, also those that are repeated.  Where an id has several texts,
    its rows stay if one of them is kept."""
    ship(spark)
    mark = fresh(docs, "kept")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item: a window of its size with similarity 0.8.  Without items nothing is dropped."""
    ship(spark)
    mark = fresh(docs, "leaks")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(mark)), "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in place of personal data; n_chars, where there is one, follows the new text (null for a null text).  No row goes."""
    ship(spark)
    spans = fresh(docs, "spans")
    clean = pii.redact(pii.find(docs, pii.fit(docs), out=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add n_tokens and ids (little-endian unsigned 32-bit), in place of columns of these names.  Null and empty texts have none."""
    ship(spark)
    return bpe.encode(docs, word_bpe())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("personal_data", hide_personal_data),
    ("tokens", encode_tokens),
]

#: SQL cannot say the classifier, the random field or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = written(spark)
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{name}")
        clear(spark, before)  # what the stage's operators stored is not read again
        docs = spark.read.schema(out.schema).parquet(f"{place}/{name}")
    return docs
