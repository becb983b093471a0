"""From raw documents to training shards, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again:

1. language_id: documents in which no language is found (null or letterless text) go;
2. near_duplicates: of each group linked by similarity 0.8 over 5-word shingles, the document of the least doc_id stays;
3. decontaminate: documents of which benchmark windows cover a twentieth of the words go;
4. mix_sources: documents come as often as the schedule takes their first word: never, once or twice; each file in the
   order of its slots;
5. shards: what is left is dealt to 24 shards of near equal bytes, with a gapless slot in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, langid, mixing, neardup, sharding
from pagemill.llm.queries import fold
from pagemill.llm.storage import Stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs, langid.fit_profiles(docs.where(fold(4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.mix_sources(docs), one_order=False)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.pack_shards(docs, n_shards=24, keep_text=True)


STAGES = [(f.__name__, f) for f in (language_id, near_duplicates, decontaminate, mix_sources, shards)]
ORACLE_SQL = None  # the hashes behind the shuffle and the packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables behind it only its input stays, until storage.release(spark)."""
    docs, stash = table(spark, sf_dir, "documents"), Stash(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stash.keep(stage(spark, docs, sf_dir), name)
        if k:
            stash.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
