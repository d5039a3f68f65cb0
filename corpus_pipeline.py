"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; its result is
written as Parquet and read again as the next one's documents.  All stages but the last return the columns of
``documents``.

1. quality rules: documents that fail a base rule or score below the threshold go.
2. near duplicates: one document of each class stays, that with the least id.
3. repeated passages: bytes of passages that also stand elsewhere go from the texts; n_chars is counted anew.
4. mixing: documents are taken as often as the sources' target weights ask for, some of them not at all.
5. packing: token pieces of the mix, with their sequence and place in it.

Cases as in the operators: null and empty texts fail the quality rules; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.llm.common import prepare, scratch_path, table
from relaylens.llm.mixing import mixed_documents
from relaylens.llm.near_duplicates import one_of_each
from relaylens.llm.packing import pack
from relaylens.llm.quality_rules import quality
from relaylens.llm.repeats import without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality(docs, table(spark, sf_dir, "labels")).where("kept").select("document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# No stage's random, hashed or learned decisions can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
