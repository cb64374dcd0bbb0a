"""Tables and SQL fragments that queries share. Scores are rounded where sums of doubles may end in another last digit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import conversation_pairs

SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"[^{SPACES}]+"
GRAM = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]"

REC = """rec as (select conv_id::varchar || '-' || turn::varchar id, text instruction, coalesce(sys, '') input, nt output
  from (select *, lead(role) over (partition by conv_id order by turn) nr, lead(text) over (partition by conv_id order by turn) nt,
    max(case when role = 'system' then text end) over (partition by conv_id) sys from conversations) where role = 'user' and nr = 'assistant')"""
T1 = "instruction || chr(10) || case when input <> '' then input || chr(10) else '' end || output"
T2 = "concat_ws(chr(10), nullif(instruction, ''), nullif(input, ''), nullif(output, ''))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pairs(table(spark, sf_dir, "conversations"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def rounded(c, places: int = 6):
    return F.round(c, places)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
