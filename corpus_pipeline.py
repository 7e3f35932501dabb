"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm import decontamination, files, minhash, mixing, sharding, toxicity
from sceneloom.llm.common import table, work_dir

SHARDS = 40


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, a similarity of 0.8."""
    return minhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents of some repeat, of others a part stays."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in random order in shards of equal size."""
    return sharding.shard(docs, SHARDS)


#: Each stage's rows are written and read again before the next one.
STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: SQL cannot express the models, the minhashes or the seeded hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What the stages make between is written to the shared folder, and deleted once the next one is."""
    docs, at = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    *between, (_, last) = STAGES
    for i, (_, stage) in enumerate(between):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            files.delete_folder(f"{at}/{i - 1}")
    return last(spark, docs, sf_dir)
