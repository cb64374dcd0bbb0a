"""Exact top-k search of a stated query set against all rows, in cells of a two-level dual tree.

The upper level is fixed: candidates and queries are dealt to cells by their nearest pivots, which are a farthest-first net of a sample
(at most ``SAMPLE`` rows of smallest hash, fewer of very long vectors; every row is dealt to a cell, and the cells' radii are those of all their rows). A
cell has about ``CELL_ROWS`` rows, or is one of ``MOST_CELLS``; larger ones are dealt to parts by a hash of the id, so
that a task's memory is that of two parts. The lower level is a dual-tree search over cover trees in each pair of parts.

1. Each query cell is searched in the candidate cells of best bound, until they hold enough rows. The worst kth score of its queries is the cell's bar.
2. The driver compares the bounds of all pairs of cells (numbers for at most MOST_QUERY_CELLS x MOST_CELLS) with the bars; only pairs that reach them
   are joined, and searched with each query's kth score as its floor.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths never meet. Rows that
repeat an id count one by one, but a query never meets a row of its own id. Whole scores outside the range of a long end at its limits.
An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .cover_tree import bounds, net, search

CELL_ROWS, PART_ROWS, QUERY_ROWS = 2048, 8192, 2048
MOST_CELLS, MOST_QUERY_CELLS, SAMPLE, SAMPLE_NUMBERS = 1024, 512, 8192, 1 << 22
HITS = "query_id long, vec_id long, score long"
KEY = ("dim", "q_cell", "q_part", "cell", "part")


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            ids = queries.column("id").to_numpy()
            found, _ = search(ids, _matrix(queries), rows.column("id").to_numpy(), _matrix(rows), k, floor=queries.column("floor").to_numpy())
            out = [(int(q), i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for q, hits in zip(ids, found, strict=True) for s, i in hits]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def _dealt(pivots, query_pivots, every: int):
    """Map: (id, dim, v) with the nearest pivot and the distance to it; for queries among the query pivots too."""

    def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
        return at, np.sqrt(((x - p[at]) ** 2).sum(1))

    def run(batches):
        for b in batches:
            ids, dims, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            cell, q_cell, far, q_far = np.zeros(len(ids), np.int32), np.full(len(ids), -1, np.int32), np.zeros(len(ids)), np.zeros(len(ids))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                cell[at], far[at] = nearest(x, pivots.value[d])
                asked = ids[at] % every == 0
                if asked.any():
                    q_cell[at[asked]], q_far[at[asked]] = nearest(x[asked], query_pivots.value[d])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(cell), pa.array(far), pa.array(q_cell), pa.array(q_far)], names=["id", "dim", "v", "cell", "far", "q_cell", "q_far"])

    return run


def _pivots(rows: DataFrame, cell_rows: int, most: int) -> dict[int, np.ndarray]:
    """For each vector length a farthest-first net of a sample: at most ``SAMPLE`` rows by a hash of the id."""
    out: dict[int, np.ndarray] = {}
    for dim, n in sorted(map(tuple, rows.groupBy("dim").count().collect())):
        cells = max(1, min(most, -(-n // cell_rows)))
        most_rows = 1 if cells == 1 else max(cells, min(SAMPLE, SAMPLE_NUMBERS // dim))
        x = _matrix(rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id", F.lit(5)), "id").select("v").limit(most_rows).toArrow())
        found = net(x, x[0], 0.0, cells)
        centers = [x[0]] if cells == 1 else found[0] if found else _farthest(x, cells)
        out[dim] = np.array(centers)
    return out


def _farthest(x: np.ndarray, n: int) -> list[np.ndarray]:
    near, out = np.sqrt(((x - x[0]) ** 2).sum(1)), [x[0]]
    while len(out) < n:
        out.append(x[int(near.argmax())])
        near = np.minimum(near, np.sqrt(((x - out[-1]) ** 2).sum(1)))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for all rows whose id is divisible by ``every``. ``report`` gets the numbers of cell pairs: all, first, later, dropped."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = materialize(rows.select("id", F.size("v").alias("dim"), "v"), "top-k-rows")
    asked = rows.where(F.col("id") % every == 0)
    query_pivots = _pivots(asked, QUERY_ROWS, MOST_QUERY_CELLS)
    if not query_pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _pivots(rows, CELL_ROWS, MOST_CELLS)
    share = spark.sparkContext.broadcast
    rows = rows.mapInArrow(_dealt(share(pivots), share(query_pivots), every), "id long, dim int, v array<double>, cell int, far double, q_cell int, q_far double")
    rows = materialize(rows, "top-k-cells")
    asked = rows.where("q_cell >= 0")
    counted = lambda df, cell, far: {(r[0], r[1]): (r[2], r[3] * (1 + 1e-9) + 1e-6) for r in df.groupBy("dim", cell).agg(F.count("*"), F.max(far)).collect()}  # noqa: E731  a row per cell
    have, wanted = counted(rows, "cell", "far"), counted(asked, "q_cell", "q_far")
    parts = lambda n: -(-n // PART_ROWS)

    pairs: list[tuple] = []  # dim, q_cell, cell, q_parts, parts, bound, in the first step
    for dim, qs in query_pivots.items():
        q_cells, p_cells = (np.array(sorted(c for d, c in x if d == dim)) for x in (wanted, have))
        radius = lambda x, cs, d=dim: np.array([x[d, c][1] for c in cs.tolist()])
        b = bounds(qs[q_cells], radius(wanted, q_cells), pivots[dim][p_cells], radius(have, p_cells))
        for i, q in enumerate(q_cells.tolist()):
            held = 0
            for j in np.argsort(-b[i], kind="stable").tolist():
                c = int(p_cells[j])
                pairs.append((dim, q, c, parts(wanted[dim, q][0]), parts(have[dim, c][0]), float(b[i, j]), held <= max(k, CELL_ROWS)))
                held += have[dim, c][0]

    def searched(some: list[tuple], queries: DataFrame) -> DataFrame:
        p = F.broadcast(spark.createDataFrame([x[:5] for x in some], "dim int, q_cell int, cell int, q_parts int, parts int"))  # at most MOST_QUERY_CELLS x MOST_CELLS rows a vector length
        a = queries.join(p, ["dim", "q_cell"]).select("id", "v", "floor", "dim", "q_cell", F.pmod(F.xxhash64("id"), "q_parts").cast("int").alias("q_part"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        new = lambda c: F.col(c).alias(c)  # noqa: E731  both sides may come from one table
        b = rows.drop("q_cell").join(p, ["dim", "cell"]).select(new("id"), new("v"), new("dim"), "q_cell", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"), "cell", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part"))
        return a.groupBy(*KEY).cogroup(b.groupBy(*KEY)).applyInArrow(_cell(k), HITS)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    queries = asked.select("id", "v", "dim", "q_cell")
    first, rest = [p for p in pairs if p[6]], [p for p in pairs if not p[6]]
    hits = searched(first, queries.withColumn("floor", F.lit(float("-inf"))))
    if rest:
        hits = materialize(hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "top-k-first")
        kth = hits.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
        # A long near the end of its range may round upwards as a double.
        floor = F.coalesce(F.col("kth") - F.abs("kth") * 1e-15, F.lit(float("-inf")))
        queries = materialize(queries.join(kth, "id", "left").select("id", "v", "dim", "q_cell", floor.alias("floor")), "top-k-floors")
        bars = {(r[0], r[1]): r[2] for r in queries.groupBy("dim", "q_cell").agg(F.min("floor")).collect()}
        later = [p for p in rest if p[5] >= bars[p[0], p[1]]]
        if later:
            hits = hits.union(searched(later, queries))
    else:
        later = []
    if report is not None:
        report |= {"pairs": len(pairs), "first": len(first), "later": len(later), "dropped": len(rest) - len(later)}
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
