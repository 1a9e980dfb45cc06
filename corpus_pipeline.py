"""A corpus pipeline of five operators of ``shoplytics.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, the next one's docs.  All but the last return the columns of documents.

1. toxicity - learns from the labels of documents still there; rejected documents go.
2. near_duplicates - five-word shingles, similarity 0.8: one document of each group stays.
3. pii - every span found is replaced by its kind.
4. mixing - each document as often (0 to 3 times) as the mix of sources takes it.
5. packing - words of documents placed in sequences of bounded length.

``run`` applies them in order.  Between stages, documents are written as Parquet to the
shared checkpoint folder and read again: a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shoplytics.llm import mixing, neardup, packing, pii
from shoplytics.llm import toxicity as tox
from shoplytics.session import checkpoint_dir, ship_package
from shoplytics.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return tox.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", private),
          ("mixing", mixed), ("packing", packed)]

#: A learned classifier comes first, so SQL cannot give run()'s rows; the tests hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
