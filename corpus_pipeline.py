"""From raw documents to shards: toxicity, near duplicates, benchmark passages, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakscope.llm import toxic_grammar
from leakscope.llm.common import stored, table
from leakscope.llm.contain import drop_contaminated_rows
from leakscope.llm.kd_shards import shard
from leakscope.llm.mix import mix
from leakscope.llm.order_minhash import drop_near_duplicates


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar does not score as toxic. The model is learned from the
    given documents and `labels`."""
    return toxic_grammar.drop_toxic(docs, toxic_grammar.learn(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id, or
    where no document of the group has a doc_id, one of them."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without ids."""
    return drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mix", to_target_weights),
    ("shards", into_shards),
]

#: Learned weights, sampled sketches and histogram cuts have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
