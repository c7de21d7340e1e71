"""A training corpus from the table documents: good texts, one of each group, without private data, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, quality_fm, shingles, surrogates
from quire.llm.common import remove_dir, stored, table
from quire.llm.queries import OPEN_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more,
    found by SimHash and BK-trees."""
    return shingles.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data is replaced by surrogates, by the key of surrogates.KEY_SETTING or, where that is unset, an open one."""
    return surrogates.replace_pii(docs, spark.conf.get(surrogates.KEY_SETTING, OPEN_KEY))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their texts, packed into sequences."""
    return packing.pack(docs, texts=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("source_mix", source_mix), ("packing", packed)]

#: Classifier, components, surrogates and packing are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What each keeps is written as Parquet to the shared folder and read back by the
    next one, so lineage ends there and later stages read only the columns they need; it is removed once the next is
    written, or a stage fails. The last table, which the result reads, stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        try:
            docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        finally:
            if last:
                remove_dir(last)
        last = path
    return docs
