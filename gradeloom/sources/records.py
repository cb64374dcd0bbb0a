"""Records in and out: tolerant JSON lines, ids, id lists, embeddings, conversation pairs, shards."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "id string, instruction string, input string, output string"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, tolerant: bool = True, max_lines: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema, so no pass to infer one. Malformed lines are left out, or kept with ``_corrupt_record`` set."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = spark.read.text(path).select(parsed.alias("r")).where("r is not null").select("r.*")
    if tolerant:
        df = df.where("_corrupt_record is null").drop("_corrupt_record")
    return df.limit(max_lines) if max_lines is not None else df


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """The good lines, and for each bad one what a scorer answers for it: id ``unknown``, score 0, the error with the line."""
    rows = read_jsonl(spark, path, schema, tolerant=False)
    good = rows.where("_corrupt_record is null").drop("_corrupt_record")
    bad = rows.where("_corrupt_record is not null").select(F.lit("unknown").alias("id"), F.lit(0.0).alias("score"), F.concat(F.lit("malformed line: "), "_corrupt_record").alias("error"))
    return good, bad


def read_words(path: str) -> list[str]:
    """Words of a small local file, one a line; empty lines and those that begin with # are left out, later repeats too."""
    with open(path, encoding="utf-8") as f:
        return list(dict.fromkeys(w for line in f if (w := line.strip()) and not w.startswith("#")))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Judge prompts (mode, metric, template) from files named MODE_metric.txt."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract(name, r"^(QA|Q)_", 1).alias("mode"), F.regexp_extract(name, r"^(?:QA|Q)_(.+)\.txt$", 1).alias("metric"), F.decode("content", "UTF-8").alias("template")).where("mode <> '' and metric <> ''")


def count_valid(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.try_parse_json("value").isNotNull()).count()


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines; ``append`` adds files. Commits are atomic, so no half lines need repair."""
    df.write.mode(mode).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def write_ids(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(F.col(id_col).cast("string")).write.mode("append").text(path)


def with_positions(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """0-based positions in an order, without gathering rows in one task: range partitions are sorted and numbered each, and
    offset by the counts of those before them (a row per partition). The sorted rows are a table in the shared folder, so that numbers and counts see the same partitions."""
    from ..operators.grid import shared_table

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = shared_table(ranged, "positions")
    task, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_task", before.alias("_before"))
    return placed.withColumn("_task", task).join(offsets, "_task").select(*df.columns, (F.col("_before") + own).alias(name))


def add_ids(df: DataFrame, order: list[Column | str], id_col: str = "id", overwrite: bool = False) -> DataFrame:
    """Missing ids become the row's 0-based position; with ``overwrite`` all do."""
    placed = with_positions(df if id_col in df.columns else df.withColumn(id_col, F.lit(None).cast("string")), order, "_pos")
    given = F.lit(None).cast("string") if overwrite else F.col(id_col).cast("string")
    return placed.withColumn(id_col, F.coalesce(given, F.col("_pos").cast("string"))).drop("_pos")


def normalized_id(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """A record per user turn directly followed by an assistant turn; the system turn is the input."""
    w = W.partitionBy("conv_id").orderBy("turn")
    system = F.max(F.when(F.col("role") == "system", F.col("text"))).over(W.partitionBy("conv_id"))
    rows = conversations.select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("output"), F.coalesce(system, F.lit("")).alias("input"))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("instruction"), "input", "output")


def document_records(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Matrix files (.npy) as (file, pos, vec): read by Spark as binary files, one task a file; order by file and pos."""
    import io

    import numpy as np
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                m = m.reshape(len(m), -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], names=["file", "pos", "vec"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, pos long, vec array<double>")


def union_shards(*shards: DataFrame) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def split_shards(df: DataFrame, parts: int, pos: str = "pos") -> DataFrame:
    """Contiguous ranges of ceil(n / parts) rows, as a column ``shard``."""
    n = df.count()
    return df.withColumn("shard", F.floor(F.col(pos) / max(1, -(-n // parts))).cast("int"))


def read_details(spark: SparkSession, path: str, metric: str, id_col: str = "id") -> DataFrame:
    """Evaluation details (parquet with a nested ``metrics``): id and 1 - metric; null where it is missing."""
    return spark.read.parquet(path).select(id_col, (1 - F.col("metrics")[metric].cast("double")).alias("fail_rate"))


def write_details(df: DataFrame, path: str) -> None:
    """Evaluation details as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """A small table of results (metrics, means, errors) as one JSON file. It is counted first: at most 10,000 rows."""
    if results.limit(10_001).count() > 10_000:
        raise ValueError("results have more than 10,000 rows; write them as details")
    results.coalesce(1).write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str, details: bool = False) -> None:
    """The summary as one JSON file, with ``details`` the rows beside it."""
    write_results(summary(df), f"{path}/summary")
    if details:
        write_jsonl(df, f"{path}/details")


def summary(df: DataFrame) -> DataFrame:
    """Means of all numeric columns whose names hold "score"."""
    numeric = [c for c, t in df.dtypes if "score" in c and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.agg(*(F.avg(c).alias(c) for c in numeric))
