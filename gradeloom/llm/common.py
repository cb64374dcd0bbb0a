"""What the corpus operators share: Arrow maps over documents, intermediate tables, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python map handles at once; bounds its memory besides the longest text.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set to a local one only where the cluster names none."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        import tempfile

        found = f"file://{tempfile.gettempdir()}/gradeloom-shared"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts lineage and survives lost executors.

    The files go by ``discard``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave; of others nothing. Only for tables that nothing unwritten is still read from."""
    for t in tables:
        if path := t.__dict__.get("written_at"):
            fs, at = _folder(t.sparkSession, path)
            fs.delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of few rows and bytes keep both sides of an Arrow map small.

    Arrow's batch limits belong to the session and are read when a plan runs, so they stay set for what follows; results don't depend on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * SLICE))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _state() -> dict:
    """This package's functions travel by value, so their module globals are new in every task; a module of the worker's own lasts."""
    return sys.modules.setdefault("gradeloom_worker_state", types.ModuleType("gradeloom_worker_state")).__dict__


def trim() -> None:
    """Give freed memory back to the system, which allocators else keep: a few milliseconds after each large piece of work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Full collections in the JVMs of the executors, which give back the heap that earlier work has grown; else it stays as large, used or not.

    A job with a task for each core reaches all executors that are idle. Twice, as most of it goes with the second (weak references, buffers outside the heap).
    """
    n = spark.sparkContext.defaultParallelism
    for _ in range(2):
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def forget() -> None:
    """Drop what the worker keeps, and give its memory back: the next stage's tasks run in the same processes."""
    state = _state()
    if state.pop("value", None) is None:
        return
    state.pop("key", None)
    gc.collect()
    trim()


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept between the tasks of a Python worker; another key takes its place."""
    state = _state()
    state["used"] = True
    if state.get("key") != key:
        forget()
        state["value"], state["key"] = make(), key
    return state["value"]


def arrow_map(df: DataFrame, schema: str, rows: Callable[..., Callable[[list[tuple]], list[tuple]]], *args, slice_rows: int = SLICE) -> DataFrame:
    """``rows(*args)`` runs once a task and gives a function from a list of row tuples to a list of result tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _state()["used"] = False
        each = rows(*args)
        if not _state()["used"]:
            forget()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                if out := each(list(zip(*(c.to_pylist() for c in part.columns), strict=True))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a < b, with the same components: of a node's smaller neighbours only the least stays one, and the others are tied to that instead.

    Where many nodes have the same few smaller neighbours, what those are tied to is said once.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = e.join(e.groupBy("b").agg(F.min("a").alias("least")), "b")
    return e.select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def components(edges: DataFrame, what: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long), as (node, comp): comp is the smallest node reachable.

    The edges are thinned once. Each round takes the least label of a node's neighbours, then the label of that label. Both are joins
    that adaptive execution may split where a node has very many edges, followed by a pre-aggregated minimum.
    A round's labels are a table in the shared folder, so lineage doesn't grow. Empty edges: no rows.
    """
    thin = materialize(thinned(edges), f"{what}-thin")
    both = thin.union(thin.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, f"{what}-edges")
    discard(thin)
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
    old = materialize(first, f"{what}-0")
    for k in range(1, most_rounds):
        labels = old.select("node", "comp")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp")
        to = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jump = labels.join(to, "comp").select("node", F.col("up").alias("comp"))
        least = near.union(jump).groupBy("node").agg(F.min("comp").alias("m"))
        new = labels.join(least, "node", "left").select("node", F.least("comp", "m").alias("comp"), (F.col("m") < F.col("comp")).alias("moved"))
        new = materialize(new, f"{what}-{k}")
        discard(old)
        if new.where("moved").isEmpty():
            discard(both)
            return new.select("node", "comp")
        old = new
    raise RuntimeError("components did not settle")
