"""A training-data pipeline over `documents`: each stage reads what its predecessor wrote.

Every stage but the last returns the columns of documents. Toxicity and decontamination drop the rows they reject, line
dedup shortens texts (and their n_chars), near dedup keeps the smallest id of each group, and the last stage adds the
sampled pieces and what they decode to. Rows with a null id pass every stage but toxicity unjudged; rows repeated under
one id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from casegraph.llm.common import prepare, table
from casegraph.llm.queries import tokenizer
from casegraph.session import scratch_path, use_utc

#: The pipeline learns a grammar and samples segmentations; it is tested against a brute-force version.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.acceptable(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cleaned = line_dedup.cleaned(line_dedup.build(docs), docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, similarity 0.8 or more."""
    prepare(spark)
    copies = near_dedup.groups(docs, width=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def into_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("sentencepiece", into_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
