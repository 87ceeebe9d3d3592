"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotweave.llm import exact_dedup, near_join, packing, toxicity, winnowing
from lotweave.llm.common import written
from lotweave.llm.registry import table

#: Near duplicates: word shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Words that a packing task remembers; Python workers still hold memory of the stages before.
MEMO_WORDS = 200_000
#: Rows of an Arrow batch. The JVM holds a batch twice for each task, outside its heap, and the worker about three times.
ARROW_ROWS = 1_000
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage):
    """``stage`` in a session whose Arrow batches hold at most ``ARROW_ROWS`` whole texts; a smaller setting stays."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = int(spark.conf.get(ARROW_SETTING))
        if not 0 < own <= ARROW_ROWS:
            spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on ``labels`` does not call toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each text that is equal but for white space."""
    return exact_dedup.dedup(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class that near-duplicate links form."""
    return near_join.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs, memo_words=MEMO_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: A trained model and a tokenizer decide the rows; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
