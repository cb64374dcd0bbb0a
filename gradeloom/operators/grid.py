"""All-pairs work on vectors and sets, in blocks.

The rows lie once in the shared folder, from where a task reads the slices or blocks that it compares with its own, one after the other. So its memory
is that of two blocks at any input size, nothing is copied for each pair of blocks, and no pair is ever a row. Per-row results (nearest rows) leave a
task as a few values per row, whole-set results as one row for two blocks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
#: Vectors up to this size are broadcast.
BROADCAST_BYTES = 64 << 20


def matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(t.num_rows, -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(b - x).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        s = (a @ b.T) / np.outer(np.where(na > 0, na, 1), np.where(nb > 0, nb, 1))
        return np.where(np.outer(na > 0, nb > 0), 1 - s, 1.0)
    if metric not in ("euclidean", "squared_euclidean"):
        raise ValueError(f"unknown distance {metric!r}")
    d = np.stack([((b - x) ** 2).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))
    return d if metric == "squared_euclidean" else np.sqrt(d)


def product_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared euclidean distances by one matrix product: many times faster, with an error of some 1e-15 of the squared lengths."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def nearest_of(q: np.ndarray, r: np.ndarray, k: int, metric: str, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, earlier rows first among equals; pairs in ``skip`` take no part.

    Euclidean distances are first taken by a matrix product; those that its error could let into the k nearest are computed again, exactly.
    """
    if metric not in ("euclidean", "squared_euclidean"):
        d = distances(q, r, metric)
        if skip is not None:
            d[skip] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, best, 1)
        keep = np.isfinite(near)
        return np.repeat(np.arange(len(q)), keep.sum(1)), best[keep], near[keep]
    about = product_distances(q, r)
    if skip is not None:
        about[skip] = np.inf
    if k < about.shape[1]:
        slack = 1e-12 * ((q * q).sum(1) + (r * r).sum(1).max(initial=0))
        i, j = np.nonzero(about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    else:
        i, j = np.nonzero(np.isfinite(about))
    fine = np.isfinite(about[i, j])
    i, j = i[fine], j[fine]
    d = ((q[i] - r[j]) ** 2).sum(1)
    d = d if metric == "squared_euclidean" else np.sqrt(d)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, d = (x[rank < k] for x in (i, j, d))
    return i, j, d


def similarities(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(product_distances(a, b)))
    if metric == "manhattan":
        return 1 / (1 + distances(a, b, metric))
    if metric == "dot_product":
        return a @ b.T
    if metric == "pearson":
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    elif metric != "cosine":
        raise ValueError(f"unknown similarity {metric!r}")
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ok = np.outer(na > 0, nb > 0)
    return np.where(ok, (a @ b.T) / np.where(ok, np.outer(na, nb), 1), 0.0)


def similarity_total(a: np.ndarray, b: np.ndarray, metric: str) -> float:
    """Sum of all euclidean or Manhattan similarities of rows of ``a`` and ``b``, a few rows at a time; a row's similarity to itself, where ``a`` is ``b``, is 1."""
    total = 0.0
    if metric == "euclidean":
        own, other = (a * a).sum(1), (b * b).sum(1)
        for k in range(0, len(a), 256):
            d = (a[k : k + 256] * -2) @ b.T
            d += own[k : k + 256, None]
            d += other
            if a is b:
                d[np.arange(len(d)), np.arange(k, k + len(d))] = 0
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d += 1
            total += float(np.divide(1, d, out=d).sum())
        return total
    if metric != "manhattan":
        raise ValueError(f"unknown similarity {metric!r}")
    kind = np.float64
    with np.errstate(over="ignore"):
        if all((x.astype(np.float32) == x).all() for x in (a, b)):  # single precision holds them: differences err by 2 ** -24 of themselves
            kind = np.float32
    width, step = a.shape[1], 512
    a, ones, held = a.astype(kind), np.ones(a.shape[1], kind), [np.ascontiguousarray(b[k : k + step].T.astype(kind)) for k in range(0, len(b), step)]
    d = np.empty(len(b), kind)
    for x in a:
        tile, room = np.repeat(x, step).reshape(width, step), np.empty((width, step), kind)
        for k, part in enumerate(held):
            m = part.shape[1]
            t = room if m == step else room[:, :m]
            np.abs(np.subtract(part, tile[:, :m], out=t), out=t)
            np.dot(ones, t, out=d[k * step : k * step + m])
        total += float((1 / (1 + d.astype(np.float64))).sum())
    return total


def blocks_of(n: int) -> int:
    return max(1, -(-n // BLOCK_ROWS))


def block(id_col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")


def shared_table(df: DataFrame, what: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The table, written to the folder in ``spark.checkpoint.dir``, in a folder for each value of ``by``, and its path there. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/gradeloom-shared"
    path = f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def slices(path: str, columns: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """The parts of a table in the shared folder, one after the other, in the same order each time; none if there is no such folder."""
    store, at = fs.FileSystem.from_uri(path)
    for f in sorted(x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.path.endswith(".parquet")):
        with store.open_input_file(f) as opened:
            for b in parquet.ParquetFile(opened).iter_batches(rows, columns=columns, use_threads=False):
                if b.num_rows:
                    yield pa.Table.from_batches([b])


def pair_cells(df: DataFrame, id_col: str, value: str, compare: Callable[[pa.Table, pa.Table | None], dict], schema: str) -> DataFrame:
    """``compare(rows, None)`` on every block and ``compare(rows, others)`` on every two; each gives one row. A task has one block and reads the others in turn: of a
    ring of blocks those up to half-way round, so that every two meet once and all tasks have as much to do."""
    n = blocks_of(df.count())
    rows = df.select(F.col(id_col).alias("id"), F.col(value).alias("v"), block(id_col, n).alias("block"))
    _, path = shared_table(rows.repartition(n, "block"), "pair-blocks", "block")
    parts = max(1, -(-64 // n))  # few blocks: several tasks have the same one
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"double": pa.float64(), "long": pa.int64()}

    def held(k: int) -> pa.Table | None:
        t = list(slices(f"{path}/block={k}", ["id", "v"], BLOCK_ROWS))
        return pa.concat_tables(t) if t else None

    def run(batches):
        for x in (x for b in batches for x in b.column(0).to_pylist()):
            own, part = divmod(x, parts)
            round_ = [(own + i) % n for i in range((n + 1) // 2)] + [own + n // 2] * (n % 2 == 0 and own < n // 2)
            if not round_[part::parts] or (mine := held(own)) is None:
                continue
            for k in round_[part::parts]:
                got = None
                if k == own:
                    got = compare(mine, None)
                elif (other := held(k)) is not None:
                    got = compare(mine, other)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([got[c]], kinds[kind]) for c, kind in fields], names=[c for c, _ in fields])

    return df.sparkSession.range(0, n * parts, 1, n * parts).mapInArrow(run, schema)


class _Plain:
    """A slice of rows or of queries, with what the approximate distances need. ``about`` errs by at most ``slack``, to either side (Manhattan: is at most that above)."""

    def __init__(self, v: np.ndarray):
        self.v = v

    def part(self, at: slice):
        out = object.__new__(type(self))
        out.__dict__ = {k: x[at] if isinstance(x, np.ndarray) else x for k, x in self.__dict__.items()}
        return out


class _Squared(_Plain):
    """About the squared euclidean distance, by one product in single precision of vectors less ``center``, or in double where that can't hold them."""

    def __init__(self, v: np.ndarray, center: np.ndarray):
        super().__init__(v)
        c = v - center
        self.own = (c * c).sum(1)
        finite = self.own[np.isfinite(self.own)]
        self.most = float(finite.max(initial=0))
        fits = self.most < 1e30 and (not len(finite) or self.most > 1e-20)
        self.kind = np.float32 if fits else np.float64
        self.c = c.astype(np.float32) if fits else c

    @staticmethod
    def about(q, r):
        kind = q.kind if q.kind == r.kind else np.float64
        d = (q.c.astype(kind) * kind(-2)) @ r.c.astype(kind).T
        d += q.own.astype(kind)[:, None]
        d += r.own.astype(kind)
        return d, (q.v.shape[1] + 16) * (2.4e-7 if kind == np.float32 else 1e-15) * (q.own + r.most)


class _Cosine(_Plain):
    """About the cosine distance, by a product of unit vectors in single precision."""

    def __init__(self, v: np.ndarray):
        super().__init__(v)
        self.length = np.linalg.norm(v, axis=1)
        self.v = v / np.where(self.length > 0, self.length, 1)[:, None]
        self.c = self.v.astype(np.float32)

    @staticmethod
    def about(q, r):
        d = q.c @ -r.c.T
        d += np.float32(1)
        return d, np.full(len(q.v), (q.v.shape[1] + 16) * 2.4e-7)


WAVES = 4


def under_absolute(t: np.ndarray) -> tuple[float, np.ndarray]:
    """Half a period and (c0, c1, ...) with c0 + c1 cos(pi t / half) + ... at most |t| for every t, and not far below it where ``t`` has many values.

    Kept below on a grid over [0, half], with what the curve can rise between its points; beyond, the curve is mirrored and repeats, but |t| rises.
    """
    t = np.abs(t[np.isfinite(t)])
    half = float(np.quantile(t, 0.9995)) * 1.02 if len(t) else 0.0
    if not half > 0:
        return 1.0, np.zeros(WAVES + 1)
    g = np.linspace(0, 1, 257)
    seen = np.histogram(t / half, bins=np.append(g - g[1] / 2, 1 + g[1]))[0][:257] + 1e-3
    a = np.cos(np.pi * g[:, None] * np.arange(WAVES + 1))
    v, best = seen / seen.sum(), None
    for _ in range(200):
        c = np.linalg.lstsq((a.T * v) @ a, (a.T * v) @ g, rcond=None)[0]
        over = a @ c - g
        c[0] -= max(over.max(), 0) + g[1] ** 2 / 8 * (np.pi**2 * np.arange(WAVES + 1) ** 2 @ np.abs(c))
        if best is None or seen @ (a @ c) > seen @ (a @ best):
            best = c
        v = v * np.exp(0.3 * np.clip(over / max(np.abs(over).max(), 1e-300), 0, 1))
        v /= v.sum()
    return half, best * half


class _Manhattan(_Plain):
    """At most the Manhattan distance: cosines of differences that stay under |t|, summed by one product of cosines and sines in single precision."""

    def __init__(self, v: np.ndarray, center: np.ndarray, curve: tuple[float, np.ndarray], query: bool = False):
        super().__init__(v)
        half, c = curve
        x = (v - center) * (np.pi / half)
        waves = [f(x * j) * (c[j] if query else 1.0) for j in range(1, WAVES + 1) for f in (np.cos, np.sin)]
        self.c = np.concatenate(waves, 1).astype(np.float32)
        self.low = np.float32(v.shape[1] * c[0])
        self.slack = (2 * WAVES * v.shape[1] + 16) * 2.4e-7 * v.shape[1] * float(np.abs(c).sum())

    @staticmethod
    def about(q, r):
        d = q.c @ r.c.T
        d += q.low
        return d, np.full(len(q.v), q.slack)


def _exactly(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str, zero: np.ndarray | None = None) -> np.ndarray:
    """Distances of the pairs (i, j)."""
    out = np.empty(len(i))
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    for k in range(0, len(i), step):
        a, b = q[i[k : k + step]], r[j[k : k + step]]
        if metric == "cosine":
            out[k : k + step] = 1 - (a * b).sum(1)
        elif metric == "manhattan":
            out[k : k + step] = np.abs(a - b).sum(1)
        else:
            d = ((a - b) ** 2).sum(1)
            out[k : k + step] = d if metric == "squared_euclidean" else np.sqrt(d)
    return out


class Nearest:
    """The k nearest rows of some queries, smaller ids first among equals, gathered over slices of the rows.

    Of each slice only the pairs whose approximate distance could let them in are computed in full. That drops no pair: the approximation's error is bounded.
    """

    GROUP = 512

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, metric: str, exclude_self: bool):
        if metric not in ("euclidean", "squared_euclidean", "cosine", "manhattan"):
            raise ValueError(f"unknown distance {metric!r}")
        self.ids, self.v, self.k, self.metric, self.exclude_self, self.groups = ids, v, k, metric, exclude_self, None

    def _begin(self, r: np.ndarray) -> None:
        finite = r[np.isfinite(r).all(1)]
        self.center = finite.mean(0) if len(finite) else np.zeros(r.shape[1])
        if self.metric == "manhattan":
            with np.errstate(invalid="ignore"):
                self.curve = under_absolute((self.v[:: -(-len(self.v) // 64)][:, None] - r[:: -(-len(r) // 64)][None]).ravel())
        q = self._side(self.v, True)
        self.groups = []
        for k in range(0, len(self.v), self.GROUP):
            at = slice(k, k + self.GROUP)
            m = len(self.v[at])
            self.groups.append([self.ids[at], q.part(at), np.full(m, np.inf), (np.zeros(0, np.int64), np.zeros(0), self.ids[:0])])

    def _side(self, v: np.ndarray, query: bool = False):
        if self.metric == "cosine":
            return _Cosine(v)
        return _Manhattan(v, self.center, self.curve, query) if self.metric == "manhattan" else _Squared(v, self.center)

    def _as_approximated(self, d: np.ndarray) -> np.ndarray:
        return d * d if self.metric == "euclidean" else d.copy()

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            if self.groups is None:
                self._begin(v)
            r = self._side(v)
            for g in self.groups:
                self._compare(g, ids, r)

    def _compare(self, g: list, ids: np.ndarray, r: _Plain) -> None:
        own, q, bound, best = g
        d, slack = r.about(q, r)
        most = self._as_approximated(bound)
        if (open_ := np.isinf(bound)).any():  # not k rows yet: the k that seem nearest give a first bound
            few = d[open_]
            if self.exclude_self:
                few[own[open_][:, None] == ids[None, :]] = np.inf
            few[np.isnan(few)] = np.inf
            if self.k < len(ids):
                few_j = np.argpartition(few, self.k - 1, axis=1)[:, : self.k]
                fit = np.isfinite(np.take_along_axis(few, few_j, 1)).all(1)
                real = _exactly(q.v, r.v, np.repeat(np.flatnonzero(open_), self.k), few_j.ravel(), self.metric).reshape(-1, self.k).max(1)
                most[open_] = np.where(fit & np.isfinite(real), self._as_approximated(real), np.inf)
        i, j = self._within(d, np.where(np.isfinite(most), most * (1 + 1e-9) + slack, np.inf))
        if self.exclude_self and len(i):
            other = own[i] != ids[j]
            i, j = i[other], j[other]
        if not len(i):
            return
        real = _exactly(q.v, r.v, i, j, self.metric)
        use = np.isfinite(real) & (real <= bound[i])
        i, j, real = i[use], j[use], real[use]
        touched = np.zeros(len(own), bool)
        touched[i] = True
        old = touched[best[0]]
        qi, qd, qid = np.concatenate([best[0][old], i]), np.concatenate([best[1][old], real]), np.concatenate([best[2][old], ids[j]])
        order = np.lexsort((qid, qd, qi))
        qi, qd, qid = qi[order], qd[order], qid[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        last = rank == self.k - 1
        bound[qi[last]] = qd[last]
        keep = rank < self.k
        g[3] = tuple(np.concatenate([x[~old], y[keep]]) for x, y in zip(best, (qi, qd, qid), strict=True))

    @staticmethod
    def _within(d: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the table that are at most their row's value: eight at a time are looked at first."""
        low = np.nextafter(most.astype(d.dtype), d.dtype.type(np.inf))[:, None]
        hit = d <= low
        wide = -(-d.shape[1] // 8) * 8
        if wide > d.shape[1]:
            hit = np.pad(hit, ((0, 0), (0, wide - d.shape[1])))
        at = np.flatnonzero(hit.ravel().view(np.uint64))
        some, of = np.nonzero(hit.ravel().reshape(-1, 8)[at])
        place = at[some] * 8 + of
        return place // wide, place % wide

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ranks from 1, row ids, distances)."""
        for own, _, _, (i, d, ids) in self.groups or ():
            order = np.lexsort((ids, d, i))
            i, d, ids = i[order], d[order], ids[order]
            yield own[i], np.arange(len(i)) - np.searchsorted(i, i) + 1, ids, d


#: Queries that a task holds at once, and pairs of a task at least.
QUERY_ROWS, TASK_PAIRS = 8192, 1 << 23


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """query_id, rank (from 1), id, distance of each query's k nearest rows; smaller ids first among equals. Both tables: (id, v).

    The queries are dealt to tasks by their number of pairs. Rows that take up to ``BROADCAST_BYTES``, which is counted first, are broadcast; others are
    written once to the shared folder and read from there, slice by slice. The result is the same.
    """
    if metric not in ("euclidean", "squared_euclidean", "cosine", "manhattan"):
        raise ValueError(f"unknown distance {metric!r}")
    n, width = rows.select(F.count("*"), F.max(F.size("v"))).first()
    m = n if queries is rows else queries.count()
    id_type = dict(queries.dtypes)["id"]
    if n * (width or 0) * 8 <= BROADCAST_BYTES:
        t = rows.select("id", "v").toArrow()
        held = rows.sparkSession.sparkContext.broadcast((np.array(t.column("id").to_pylist()), matrix(t) if n else np.zeros((0, 0))))

        def parts():
            ids, v = held.value
            for at in range(0, n, BLOCK_ROWS):
                yield ids[at : at + BLOCK_ROWS], v[at : at + BLOCK_ROWS]
    else:
        _, path = shared_table(rows.select("id", "v"), "nearest-rows")

        def parts():
            for t in slices(path, ["id", "v"], BLOCK_ROWS):
                yield np.array(t.column("id").to_pylist()), matrix(t)

    def answered(some: list[pa.RecordBatch]):
        t = pa.Table.from_batches(some)
        kind = t.schema.field("id").type
        near = Nearest(np.array(t.column("id").to_pylist()), matrix(t), k, metric, exclude_self)
        for ids, v in parts():
            near.add(ids, v)
        for q, rank, ids, d in near.found():
            yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), kind), pa.array(rank, pa.int32()), pa.array(ids.tolist(), kind), pa.array(d, pa.float64())], names=["query_id", "rank", "id", "distance"])

    def run(batches):
        some: list[pa.RecordBatch] = []
        for b in (b.slice(at, QUERY_ROWS) for b in batches for at in range(0, b.num_rows, QUERY_ROWS)):
            if some and sum(x.num_rows for x in some) + b.num_rows > QUERY_ROWS:
                yield from answered(some)
                some = []
            some.append(b)
        if some:
            yield from answered(some)

    asked = queries.select("id", "v")
    if (tasks := min(m * n // TASK_PAIRS, max(96, -(-m // QUERY_ROWS)))) > 1:
        asked = asked.repartition(tasks)
    return asked.mapInArrow(run, f"query_id {id_type}, rank int, id {id_type}, distance double")
