"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage works on all rows its predecessor kept and its decisions take
effect. All stages but the last return the columns of ``documents``; the last
adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import decontaminate, hilbert, language_id, mixing, simhash
from txnrisk.llm.common import fresh, read_table, saved

#: SQL has no XXH64, no hypervectors and no Hilbert index; the stages are tested against brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents like a learned language, a null ``lang`` filled with it; rejected are those without a letter and those unlike every one in letters or trigrams."""
    lang, score, known = fresh(docs, "_lang_pred"), fresh(docs, "_score"), fresh(docs, "_known")
    labelled = language_id.predict(docs, language_id.fit(docs), lang_pred=lang, score=score, known=known)
    return labelled.filter(F.col(known)).withColumn("lang", F.coalesce("lang", lang)).drop(lang, score, known)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: four-word shingles, at most four differing bits."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: five-word shingles, containment 0.8 or more."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw whose tokens follow the tempered source and language shares."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot`` along a Hilbert curve over size, source and doc_id."""
    return hilbert.sharded(docs)


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("hilbert_shards", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
