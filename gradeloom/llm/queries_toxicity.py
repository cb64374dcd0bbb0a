"""Query op9_toxicity. No SQL: it is tested by held-out accuracy."""

from pyspark.sql import functions as F

from .toxicity import held_out, score, train

THRESHOLD = 0.7


def toxicity(docs, labels, threshold: float = THRESHOLD, **args):
    scored = score(docs, train(docs, labels, **args))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
