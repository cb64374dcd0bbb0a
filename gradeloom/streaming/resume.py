"""Scoring as a stream: a checkpoint keeps what is done, so a stopped run goes on where it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.plan import ScorePlan


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(records: DataFrame, plan: ScorePlan, out: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """All files present now, then it ends; run it again for new ones. Every record is written once."""
    scored = plan.score(records, id_col=id_col)
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_entropy(records: DataFrame, cluster: str) -> DataFrame:
    """Counts by cluster for an update-mode stream; entropy follows from them."""
    return records.groupBy(F.expr(f"try_cast({cluster} as int)").alias("cluster")).count()


def windowed_scores(events: DataFrame, ts: str, value: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean and count by event-time window and key; events later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
