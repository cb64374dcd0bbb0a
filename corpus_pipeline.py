"""A corpus pipeline in five stages: toxicity, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read as the next one's docs.
All but the last return the columns of their docs, whatever else those hold. Null and empty texts pass toxicity and near-dedup, are empty after substring
dedup and leave there, as texts without words do. Null ids pass all stages; rows that repeat an id are documents with several texts. An empty table stays empty.

Stages run in the same executors one after the other. Each begins by giving back the memory that the ones before it have left in their JVMs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import collect_garbage, discard, materialize
from gradeloom.llm.minhash import near_duplicates
from gradeloom.llm.mixing import mixed_documents
from gradeloom.llm.queries_byte_bpe import byte_bpe_digests
from gradeloom.llm.queries_toxicity import THRESHOLD
from gradeloom.llm.substring import substring_dedup
from gradeloom.llm.toxicity import scored, train


def afresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run_afresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run_afresh


@afresh
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose score is at least the threshold. Learns as op9 does, from the rows that are left of ``docs``."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, docs.columns).where(F.col("toxic_score") < THRESHOLD).select("row.*")


@afresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Rows that repeat a doc_id stay as they are; null ids stay."""
    gone = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@afresh
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that stand earlier in the corpus go; texts that lose nothing stay as they are; texts without words left go."""
    return substring_dedup(docs, as_text=True).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


@afresh
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_documents(docs)


@afresh
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, a row per document taken."""
    return byte_bpe_digests(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("pareto_mixing", mix_sources), ("byte_bpe", encode)]

#: Three stages have no SQL: a trained classifier, a tokenizer, and near-duplicates over whole tables. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
