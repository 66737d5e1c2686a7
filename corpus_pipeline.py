"""From raw documents to a shuffled training set, in five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontaminate, group_join, mixing, quality, shards
from tallyspark.llm.entries import MIX_WEIGHTS, mix_levels, table
from tallyspark.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score below 0.3 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents linked at 0.8 or more on five-word shingles, the one with the smallest id stays."""
    return group_join.keep_first(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: nine tenths of all tokens, by target weights, no document twice."""
    mixed = mixing.mix(docs, levels=mix_levels(), weights=MIX_WEIGHTS, budget_percent=90, max_epochs=1, seed=5)
    return mixed.select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a uniform shuffle into 40 shards, with `shard` and `slot`."""
    return shards.shuffle_to_shards(docs, 40, seed=11)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The classifier's fit and the drawn matrix have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None
