"""A training-corpus pipeline of five stages: toxicity, line dedup, near-duplicates, decontamination, packing.

Every stage works on all rows that the one before it kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import decontam, linededup, packing, resemblance, simhash, toxicity
from gradeloom.llm.common import discard, new_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model learns from all labelled rows among them (a bounded sample).

    Null and empty texts are scored like any other, rows that are repeated fare alike, and an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay in one document only; documents of which nothing is left go.

    Null and empty texts stay, rows that are repeated fare alike (the document that keeps a line keeps it in each), and an empty table
    stays empty.
    """
    return linededup.strip(docs, n_chars_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints or by five-word resemblance the document with the least id stays (null ids last).

    Null and wordless texts are copies of each other, of repeated rows one stays, and an empty table stays empty.
    """
    return simhash.keep_first(docs, least=resemblance.RESEMBLANCE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts stay, rows that are repeated fare alike, an empty table stays empty."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places. Null and empty texts have the end alone, repeated rows are packed each, no rows give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Learned scores and tokenizer ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = new_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        if k:
            discard(spark, f"{at}/{k - 1}")  # its successor is written
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
