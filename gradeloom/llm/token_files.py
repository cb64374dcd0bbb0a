"""Token ids as ORC files: integer run-length encoding, row indexes, a Bloom filter on document ids.

Files are in ascending document id, nulls first: documents are range-partitioned and sorted, and each partition's rows
carry its number and their place in it, so file k holds what precedes file k + 1. Start offsets over the
whole corpus need only the token total of each file. Stripes are small enough that one file is read by many tasks; a filter
on doc_id prunes files, stripes and row groups by their statistics and Bloom filters.

Encoding calls the tokenizers library; ``batch_tokenizer`` encodes each distinct word of some megabytes of texts once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batch_tokenizer import BatchTokenizer
from .common import SLICE, forget, kept_in_worker, materialize, shared_dir, small_batches, trim

FILE_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
BROADCAST_ROWS = 100_000
#: Bytes of texts that a task encodes together; bounds its memory besides the longest text.
ENCODED_AT_ONCE = 16 << 20


def _encoded(data, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept_in_worker(("tokenizer", zlib.crc32(data.value)), lambda: BatchTokenizer(data.value))
        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, held, size
            docs, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
            lists = t.encode(docs.column(1).combine_chunks(), end_id)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            ends = at + np.cumsum(n)
            columns = [docs.column(0).combine_chunks(), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), lists]
            whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "n_tokens", "ids"])
            yield from (whole.slice(k, SLICE) for k in range(0, len(n), SLICE))
            at = int(ends[-1])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= ENCODED_AT_ONCE:
                yield from flush()
        if sum(b.num_rows for b in held):
            yield from flush()
        trim()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, stripe_mb: int = 16) -> None:
    """Every text of ``docs`` (doc_id, text), each closed by ``end_id``. Rows that repeat an id are ordered by a hash of their texts."""
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # An id that stands on many rows, or none, is spread by the text, and equal rows by their place; these are few bytes beside the text.
    docs = docs.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    docs = docs.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    options = {"compression": "snappy", "orc.stripe.size": stripe_mb << 20, "orc.create.index": "true", "orc.row.index.stride": 1000, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    docs.mapInArrow(_encoded(data, end_id), FILE_SCHEMA).write.options(**options).orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per file
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(totals.select("part", before.alias("base")), "token-files")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        lists = b.column(3)
        ids, ends = lists.flatten().to_numpy().astype("<u4", copy=False), lists.value_lengths().to_numpy().cumsum().tolist()
        crc = [zlib.crc32(ids[i:k]) for i, k in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """Writes the files and digests what is read back. A null or empty text has just the end id."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, out)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return read_tokens(spark, out).mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
