"""Corpus preparation: five stages over documents, each written as Parquet and read again.

All but the last stage return the columns of documents, whatever their names, and no others.
Null, empty and very short texts go in the first stage (under 50 words). Documents of null
lang form a stratum, rows of null doc_id pass as others do; repeated rows of one doc_id and
text become one row at near duplicates, and rows of one doc_id are decontaminated together.
Very long texts pass whole. An empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontam, packing, pii, rules, simhash
from strandlake.llm.common import delete_at_end, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.stage(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.stage(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: Fingerprint components and tokenisation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    delete_at_end(spark, base)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
