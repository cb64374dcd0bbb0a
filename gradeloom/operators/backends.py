"""Model backends: a batch of texts in, numbers out. A protocol, a deterministic stub and the map that runs one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Made once a task (a model loads once); then called with lists of texts, it gives a list of arrays of doubles for each.
BackendFactory = Callable[[], Callable[[list[str]], list[list[float]]]]


def stub_factory(width: int = 6) -> BackendFactory:
    def make():
        return lambda texts: [[(int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:4], 16) % 2001 - 1000) / 250.0 for i in range(width)] for t in texts]

    return make


def with_model(df: DataFrame, text: str, backend: BackendFactory, out: str = "model_output", id_col: str = "id", batch: int = 64) -> DataFrame:
    """id and the backend's array for each text. Batches of similar length come from ordering by length before the call, if that pays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model([x or "" for x in part.column(1).to_pylist()]), pa.list_(pa.float64()))], names=[id_col, out])

    return df.select(df[id_col].cast("string").alias(id_col), text).mapInArrow(run, f"{id_col} string, {out} array<double>")


def append_models(df: DataFrame, asked: dict[str, tuple[Column, Callable, str]], batch: int = 64) -> DataFrame:
    """All columns of ``df`` and each backend's answers, in one map without joins. ``asked``: new column -> (text, backend, kind): array<double>, or string for generated text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n, makers = len(df.columns), [b for _, b, _ in asked.values()]
    fields = [*df.columns, *asked]
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(kind)) for k, (_, _, kind) in asked.items())])
    kinds = [to_arrow_schema(schema).field(k).type for k in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [make() for make in makers]
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                answers = [pa.array(m([x or "" for x in part.column(n + i).to_pylist()]), kind) for i, (m, kind) in enumerate(zip(models, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *answers], names=fields)

    return df.select("*", *(text.alias(k) for k, (text, _, _) in asked.items())).mapInArrow(run, schema)
