"""From raw documents to sharded training data; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.llm import decontam, mixing, neardup, quality, shards
from ripestream.llm.common import addressed, stage, table
from ripestream.session import ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay inside the adaptive fences of their language and source."""
    ship_package(spark)
    return quality.rate(docs, prefix="__q_").where("__q_kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): that of the smallest doc_id."""
    ship_package(spark)
    address = ("__file", "__at")
    known = addressed(docs, "documents", *address)
    gone = neardup.cluster(known, k=5, percent=80, address=address).where(~F.col("chosen")).select(*address)
    return known.join(gone, list(address), "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage (or a whole shorter item) of the benchmark."""
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), out="__leaks")
    return found.where("__leaks.n_hit = 0").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources weigh 5, 2, 1, repeating, and no document comes more than three times."""
    ship_package(spark)
    return mixing.mix(docs, prefix="__m_").where("__m_copies > 0").withColumn("__m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m_copies")))).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 40 shards of equal bytes, numbered within each."""
    ship_package(spark)
    return shards.shard(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
