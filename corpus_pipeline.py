"""A training corpus from `documents`: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daygrain.llm import mixing, packing, quality, secrets, simhash
from daygrain.llm.common import drop_staged, staged, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more, by a factorisation machine fitted on the labelled ones."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: candidates by SimHash, verified, of texts whose shingles of five words have a Jaccard
    similarity of 0.8 or more; links that fingerprints miss come from an exact join, so that none is lost."""
    return simhash.distinct(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them, 0 to 2 times."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens."""
    return packing.pack(docs, most_kept=1_000_000)  # the stages before it share its workers' memory


STAGES = [("quality", good), ("near_duplicates", apart), ("secrets", clean), ("mixing", mixed), ("packing", packed)]

#: Trained scores and token ids can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
