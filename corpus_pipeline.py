"""A training-text pipeline: five stages of the text operators, from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
run() writes each stage's result to the shared folder and reads it again as the next one's docs.

Cases, in every stage: columns of any other name are kept as they are, n_chars (where there is one) follows a
changed text, and an empty table gives an empty result. Null and empty texts have no words, so quality rules
reject them; the other stages keep such rows, each as a class, clean, without spans and without ids. Rows with a
null doc_id take part like others. Equal rows are judged alike; of a class one row stays, the one of the least
doc_id (null last, ties: any one of them, as they differ in nothing that is compared).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import decontaminate, near_dup, pii, piece_codec, quality
from boxwright.llm.common import shipped, staged

PIECES = "piece_bpe_32k.model"


def _counted(docs: DataFrame) -> DataFrame:
    """docs whose n_chars, if any, are those of text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and the failing lines of the others."""
    shipped(spark)
    return _counted(quality.keep_good(docs))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: the document with the least doc_id of each class stays."""
    shipped(spark)
    return near_dup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, shipped(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: each span in text becomes its kind."""
    shipped(spark)
    return _counted(pii.redact(docs))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text decoded from them, beside the columns of documents."""
    shipped(spark)
    return piece_codec.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality rules", keep_good_documents),
    ("near duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_leaks),
    ("personal data", redact_personal_data),
    ("pieces", to_pieces),
]

#: SQL can express neither the signatures nor the piece codec; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
