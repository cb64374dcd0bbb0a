"""Whole-set scores: one row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import grams, let, ngrams, record_text
from ..functions.vector import DISTANCES, SIMILARITIES, centered, doubles, named, norm
from ..sources.records import with_positions
from .grid import matrix, nearest, pair_cells, shared_table, similarities, similarity_total, slices


def partition_entropy(df: DataFrame, cluster: str = "cluster_id", num_clusters: int | None = None) -> DataFrame:
    """Natural-log entropy of cluster sizes; rows whose id is no whole number are left out."""
    c = df.select(F.expr(f"try_cast({cluster} as int)").alias("c")).where("c is not null").groupBy("c").count()
    p = F.col("count") / F.col("n")
    total = c.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    listed = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", v))))  # noqa: E731  a row per cluster
    e = c.join(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log(p)), F.lit(0.0)).alias("entropy"), F.coalesce(F.max("k"), F.lit(0)).alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("num_samples"), listed(F.col("count")).alias("counts"), listed(p.alias("p")).alias("probabilities"))
    most = F.log(F.lit(float(num_clusters))) if num_clusters else F.log(F.greatest("clusters", F.lit(1)).cast("double"))
    return e.select("entropy", F.when(most > 0, F.col("entropy") / most).otherwise(1.0).alias("normalized_entropy"), most.alias("max_entropy"), "clusters", "num_samples", "counts", "probabilities")


def radius(df: DataFrame, vector: str = "v") -> DataFrame:
    """Geometric mean of the dimensions' population deviations; a deviation of 0 counts as 1e-10. Sums are pre-aggregated by dimension."""
    d = df.select(F.posexplode(doubles(F.col(vector))).alias("dim", "x")).groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-10)
    return d.agg(F.exp(F.avg(F.log(sd))).alias("radius"), F.avg("sd").alias("arithmetic_mean"), F.min("sd").alias("min"), F.max("sd").alias("max"), F.percentile("sd", F.lit(0.5)).alias("median"), F.sum((F.col("sd") == 0).cast("long")).alias("zero_std_dimensions"))


def centroids(df: DataFrame, vector: str = "v", label: str = "label") -> DataFrame:
    """label and mean vector."""
    d = df.select(label, F.posexplode(doubles(F.col(vector))).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("x"))
    return d.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("center"))


def cluster_inertia(df: DataFrame, centers: DataFrame, vector: str = "v", label: str = "label", metric: str = "squared_euclidean") -> DataFrame:
    """label, size, inertia of each cluster; ``inertia_totals`` sums them."""
    d = named(DISTANCES, metric)(F.col(vector), F.col("center"))
    return df.join(centers, label).groupBy(label).agg(F.count("*").alias("size"), F.sum(d).alias("inertia"))


def inertia_totals(by_cluster: DataFrame, n: int) -> DataFrame:
    return by_cluster.agg(F.sum("inertia").alias("total_inertia"), (F.sum("inertia") / n).alias("avg_inertia_per_sample"))


def inertia_report(df: DataFrame, label: str = "label", metric: str = "squared_euclidean") -> DataFrame:
    """Totals in one row: distances to the clusters' means, sizes and inertias by cluster (a row per cluster goes into the maps)."""
    by = cluster_inertia(df, centroids(df, label=label), label=label, metric=metric)
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string"), F.col(c)))))
    return by.agg(F.sum("inertia").alias("total_inertia"), (F.sum("inertia") / F.sum("size")).alias("avg_inertia_per_sample"), entries("size").alias("cluster_sizes"), entries("inertia").alias("cluster_inertias"))


def facility_location(rows: DataFrame, subset: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Of all rows' distances to the nearest row of the subset: sum, mean, max, median, population deviation. Both: (id, v)."""
    d = nearest(rows, subset, 1, metric, exclude_self=False)
    ratio = F.lit(float(subset.count())) / F.count("*")
    return d.agg(F.sum("distance").alias("facility_location_score"), F.avg("distance").alias("avg_min_distance"), F.max("distance").alias("max_min_distance"), F.percentile("distance", F.lit(0.5)).alias("median_min_distance"), F.stddev_pop("distance").alias("std_min_distance"), ratio.alias("subset_ratio"))


def knn_score(rows: DataFrame, k: int = 5, metric: str = "euclidean") -> DataFrame:
    """id and mean distance to the k nearest other rows. rows: (id, v)."""
    return nearest(rows, rows, k, metric).groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("score"))


def average_pair_similarity(rows: DataFrame, metric: str = "cosine", id_col: str = "id", vector: str = "v", sample_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """Mean similarity of all pairs, or of ``sample_pairs`` of them if there are more. Cosine, dot product and Pearson of all pairs have closed forms over vector sums; the rest go block by block."""
    n = F.col("n")
    pairs = n * (n - 1) / 2
    if sample_pairs is not None and (count := rows.count()) * (count - 1) // 2 > sample_pairs:
        s = _sampled(rows.withColumnRenamed(id_col, "id"), vector, named(SIMILARITIES, metric), sample_pairs, count, seed)
        return s.select(*_pair_report(F.col("s"), n, pairs, F.col("k"), similarity_metric=F.lit(metric)))
    out = lambda s, p: _pair_report(s, n, p, p, similarity_metric=F.lit(metric))
    if metric in ("cosine", "pearson", "dot_product"):
        v = doubles(F.col(vector))
        if metric == "pearson":
            v = centered(F.col(vector))
        if metric != "dot_product":
            v = let(v, lambda u: let(norm(u), lambda length: F.transform(u, lambda x: F.when(length > 0, x / length).otherwise(0.0))))
        unit = rows.select(v.alias("v"))
        sums = unit.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("all"))
        own = unit.agg(F.coalesce(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)).alias("own"), F.count("*").alias("n"))
        return own.join(F.broadcast(sums)).select(*out((F.col("all") - F.col("own")) / 2, pairs))

    def compare(t: pa.Table, other: pa.Table | None) -> dict:
        m = matrix(t)
        if other is None:
            return {"s": (similarity_total(m, m, metric) - len(m)) / 2, "n": len(m)}
        return {"s": similarity_total(m, matrix(other), metric), "n": 0}

    cells = pair_cells(rows, id_col, vector, compare, "s double, n long")
    return cells.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*out(F.col("s"), pairs))


def common_counts(a: np.ndarray, of_a: np.ndarray, n: int, b: np.ndarray, of_b: np.ndarray, m: int) -> np.ndarray:
    """n x m: how many values sets of two sides share. ``a[i]`` is a value of set ``of_a[i]``, none twice.

    Values that many pairs share go through a matrix product; of the others the pairs are counted one by one, which costs less than a column of the product.
    """
    values = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(values):
        return np.zeros((n, m))

    def sorted_places(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        hit = values[at] == x
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], of[hit][order]

    (va, ra), (vb, rb) = sorted_places(a, of_a), sorted_places(b, of_b)
    ca, cb = np.bincount(va, minlength=len(values)), np.bincount(vb, minlength=len(values))
    often = ca * cb > max(64, n * m // 500)
    out = np.zeros((n, m), np.float32)
    number = np.cumsum(often) - 1
    for k in range(0, int(often.sum()), 2048):
        left, right = np.zeros((n, 2048), np.float32), np.zeros((m, 2048), np.float32)
        for side, v, r in ((left, va, ra), (right, vb, rb)):
            use = often[v] & (number[v] >= k) & (number[v] < k + 2048)
            side[r[use], number[v[use]] - k] = 1
        out += left @ right.T
    counts = out.astype(np.int64).ravel()
    starts = np.cumsum(cb) - cb
    rare = ~often[va]
    v, r = va[rare], ra[rare]
    step = max(1, (1 << 22) // max(1, int(cb[~often].max(initial=1))))
    for k in range(0, len(v), step):  # each place on the left with all places of its value on the right
        own, row = v[k : k + step], r[k : k + step]
        each = cb[own]
        at = np.repeat(starts[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        counts += np.bincount(np.repeat(row, each) * m + rb[at], minlength=n * m)
    return counts.reshape(n, m)


def average_pair_jaccard(rows: DataFrame, id_col: str = "id", grams: str = "v", sample_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """Mean Jaccard similarity of all pairs of gram sets (arrays of text), or of ``sample_pairs`` of them if there are more; an empty set gives 0. Exact, block by block."""
    if sample_pairs is not None and (count := rows.count()) * (count - 1) // 2 > sample_pairs:
        s = _sampled(rows.withColumnRenamed(id_col, "id"), grams, jaccard, sample_pairs, count, seed)
        return s.select(*_pair_report(F.col("s"), F.col("n"), F.col("n") * (F.col("n") - 1) / 2, F.col("k")))

    def compare(t: pa.Table, other: pa.Table | None) -> dict:
        parts = [t.column("v").combine_chunks()] if other is None else [x.column("v").combine_chunks() for x in (t, other)]
        sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in parts]
        flat = [x.flatten().to_numpy() for x in parts]
        owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
        inter = common_counts(flat[0], owner[0], len(sizes[0]), flat[-1], owner[-1], len(sizes[-1]))
        union = sizes[0][:, None] + sizes[-1][None, :] - inter
        j = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
        return {"s": float(j.sum() if other is not None else (j.sum() - np.trace(j)) / 2), "n": len(sizes[0]) if other is None else 0}

    # Grams as 64-bit hashes: other grams pass for equal once in 2 ** 64 pairs of them.
    rows = rows.select(F.col(id_col), F.array_distinct(F.transform(F.coalesce(F.col(grams), F.array().cast("array<string>")), lambda g: F.xxhash64(g))).alias(grams))
    c = pair_cells(rows, id_col, grams, compare, "s double, n long").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return c.select(*_pair_report(F.col("s"), F.col("n"), pairs, pairs))


def _minima(hashes: np.ndarray, starts: np.ndarray, num_perm: int) -> np.ndarray:
    """Least xxhash64(gram, i) of each set for i below ``num_perm``, from the sets' xxhash64(gram), one set after the other: Spark's steps for an int with the first hash as seed. No set is empty."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    u = np.uint64
    out = np.empty((len(starts), num_perm), np.int64)
    seeds = hashes.view(np.uint64) + p5 + u(4)
    for i in range(num_perm):
        h = seeds ^ np.array([i], np.uint64) * p1
        h = (h << u(23) | h >> u(41)) * p2 + p3
        h = (h ^ h >> u(33)) * p2
        h = (h ^ h >> u(29)) * p3
        out[:, i] = np.minimum.reduceat((h ^ h >> u(32)).view(np.int64), starts)
    return out


def _signed(batches, num_perm: int):
    """Batches of minima, from batches of the sets' hashed grams."""
    for b in batches:
        v = b.column(0)
        sizes, flat = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):  # at most 64 sets, of 2 ** 18 grams or one
            before = ends[at] - sizes[at]
            to = max(at + 1, min(at + 64, int(np.searchsorted(ends, before + (1 << 18), "right"))))
            own = sizes[at:to][sizes[at:to] > 0]
            if len(own):
                low = _minima(flat[before : ends[to - 1]], np.cumsum(own) - own, num_perm)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, low.size + 1, num_perm, np.int32), pa.array(low.ravel()))], names=["low"])
            at = to


def minhash_pair_jaccard(rows: DataFrame, id_col: str = "id", grams: str = "v", num_perm: int = 128) -> DataFrame:
    """Estimate of the same from ``num_perm`` minimum hashes; empty sets give 0. c rows of one minimum agree in c (c - 1) / 2 pairs, so that counting minima stands for all pairs."""

    signed = rows.select(F.transform(grams, lambda g: F.xxhash64(g)).alias("v")).mapInArrow(lambda batches: _signed(batches, num_perm), "low array<bigint>")
    c = signed.select(F.posexplode("low").alias("i", "x")).groupBy("i", "x").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("s"))
    c = rows.agg(F.count("*").alias("n")).join(F.broadcast(c))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return c.select(*_pair_report(F.col("s") / num_perm, F.col("n"), pairs, pairs))


GRAM_BLOCK = 1 << 17


def gram_matrix(rows: DataFrame, vector: str = "v", unit: bool = True) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sum of outer products (d x d, whatever the rows), sum of the vectors, rows, and rows without length. Tasks send their d x d
    matrix in blocks of rows, which are summed by block; the driver gets d x d numbers as bytes, once."""

    def part(batches):
        s, t, n, zero = None, None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(pa.Table.from_batches([b]), "v")
            length = np.linalg.norm(m, axis=1, keepdims=True)
            zero += int((length == 0).sum())
            if unit:
                m = np.where(length > 0, m / np.where(length > 0, length, 1), 0.0)
            s, t, n = (m.T @ m) + (0 if s is None else s), m.sum(0) + (0 if t is None else t), n + len(m)
        if n:
            step = max(1, GRAM_BLOCK // len(s))
            cut = [s[i : i + step] for i in range(0, len(s), step)] + [t]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary()), pa.array([n] + [0] * (len(cut) - 1), pa.int64()), pa.array([zero] + [0] * (len(cut) - 1), pa.int64())], names=["block", "g", "n", "zero"])

    def summed(batches):
        now, total, n, zero = None, None, 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([zero], pa.int64())], names=["block", "g", "n", "zero"])
        for b in batches:
            for block, g, k, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total, n, zero = block, 0.0, 0, 0
                total, n, zero = total + np.frombuffer(g), n + k, zero + z
        if now is not None:
            yield row()

    schema = "block int, g binary, n long, zero long"
    parts = rows.select(F.col(vector).alias("v")).mapInArrow(part, schema)
    got = parts.repartition("block").sortWithinPartitions("block").mapInArrow(summed, schema).collect()
    if not got:
        return np.zeros((0, 0)), np.zeros(0), 0, 0
    *cut, last = (np.frombuffer(bytes(r.g)) for r in sorted(got, key=lambda r: r.block))
    return np.concatenate(cut).reshape(len(last), -1), last, sum(r.n for r in got), sum(r.zero for r in got)


def vendi(rows: DataFrame, vector: str = "v", metric: str = "cosine", most_rows: int = 5000) -> DataFrame:
    """exp of the entropy of the eigenvalues of K / n. Cosine and dot product share their spectrum with the d x d matrix; other kernels need all rows, at most ``most_rows``."""
    spark = rows.sparkSession
    if metric in ("cosine", "dot_product"):
        g, _, n, _ = gram_matrix(rows, vector, unit=metric == "cosine")
        values = np.linalg.eigvalsh(g / n) if n else np.zeros(0)
    else:
        n = rows.count()
        if n > most_rows:
            raise ValueError(f"{n} rows; kernels other than cosine and dot_product hold all pairs, for at most {most_rows} rows")
        m = matrix(rows.select(F.col(vector).alias("v")).toArrow())
        values = np.linalg.eigvalsh(similarities(m, m, metric) / n) if n else np.zeros(0)
    p = values[values > 1e-12]
    return spark.createDataFrame([(float(np.exp(-(p * np.log(p)).sum())), int(n), metric)], "vendi_score double, num_samples long, similarity_metric string")


LOG_DET = "log_det double, log_det_is_inf boolean, sign int, is_valid boolean, is_positive_definite boolean, is_positive_semidefinite boolean, num_samples long, embedding_dimension int, similarity_metric string, eigenvalue_stats struct<min:double,max:double,num_negative:long>, similarity_matrix_stats struct<max:double,mean:double,std:double,diagonal_mean:double>, warning string"


def log_determinant(rows: DataFrame, vector: str = "v", ridge: float = 1e-6) -> DataFrame:
    """Of the cosine matrix, 1 on its diagonal, plus ridge. A row without length stands alone there and adds ln(1 + ridge); for the n others the
    determinant lemma gives (n - d) ln(ridge) and a d x d determinant. All statistics come from d x d sums too; the least
    entry of the matrix would need all pairs and is left out."""
    g, t, n, zero = gram_matrix(rows, vector)
    d, m = len(g), n - zero
    values = np.sort(np.linalg.eigvalsh(g))[::-1][:m].clip(0) if m else np.zeros(0)
    own = np.concatenate([values, np.zeros(m - len(values)) if m <= d else np.zeros(1), np.ones(1) if zero else np.zeros(0)]) + ridge
    with np.errstate(divide="ignore"):
        value = float(np.log(values + ridge).sum() + (max(m - d, 0) * np.log(ridge) if m > d else 0) + zero * np.log1p(ridge))
    bad = not np.isfinite(value)
    mean = (t @ t + zero + n * ridge) / n**2 if n else 0.0
    square = ((g**2).sum() - m + n * (1 + ridge) ** 2) / n**2 if n else 0.0
    least, most = (float(own.min()), float(own.max())) if n else (0.0, 0.0)
    row = (None if bad else value, bad, 0 if bad else 1, not bad, least > 0, least >= -1e-10, int(n), d, "cosine", (least, most, 0), (1 + ridge, float(mean), float(max(square - mean**2, 0) ** 0.5), 1 + ridge), "the determinant is zero" if bad else None)
    return rows.sparkSession.createDataFrame([row], LOG_DET)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


#: What a task of ``novelty_sum`` holds at most: bytes of unit vectors, and distances.
HELD_BYTES, HELD_DISTANCES = 640 << 20, 8 << 20


def novelty_sum(rows: DataFrame, neighbors: tuple[int, ...] = (5, 10), density_powers: tuple[float, ...] = (0, 0.25, 0.5), distance_powers: tuple[float, ...] = (0, 1, 2)) -> DataFrame:
    """One row: num_samples, cos_distance, and scores (neighbor_k_density_p_distance_q -> score) for all parameters, from one pass over all pairs.

    A row's score is its density, to the power p, times the mean of its sorted cosine distances to all rows, itself included, weighted by 1 / rank ** q;
    its density is 1 over the mean squared distance to the 2nd to (k + 1)th nearest distinct vector. Exact at any number n of rows:
    a task holds n distances for each of a few rows, 64 MB or one row's. It holds the unit vectors, too, up to ``HELD_BYTES``; beyond, it reads them
    from the shared folder again for each of these few rows.
    """
    distinct = rows.groupBy(doubles(F.col("v")).alias("v")).agg(F.min("id").alias("id"))
    near = nearest(rows.select("id", "v"), distinct.select("id", "v"), max(neighbors) + 1, "squared_euclidean", exclude_self=False)
    mean = lambda k: F.avg(F.when(F.col("rank").between(2, k + 1), F.col("distance")))
    density = near.groupBy(F.col("query_id").alias("id")).agg(*(mean(k).alias(f"near_{k}") for k in neighbors))
    held, path = shared_table(rows.select("id", doubles(F.col("v")).alias("v")), "novelty-sum")
    n = held.count()
    at_once = max(1, HELD_DISTANCES // max(n, 1))

    def units():
        for t in slices(path, ["v"]):
            yield _unit(matrix(t))

    def part(batches):
        weights = np.stack([1 / np.arange(1, n + 1) ** float(q) for q in distance_powers], 1)
        weights /= weights.sum(0)
        kept: list[np.ndarray] | None = None
        for b in batches:
            for start in range(0, b.num_rows, at_once):
                some = b.slice(start, at_once)
                x, at = _unit(matrix(pa.Table.from_batches([some]))), 0
                if kept is None and n * x.shape[1] * 8 <= HELD_BYTES:
                    kept = list(units())
                d = np.empty((len(x), n))
                for unit in units() if kept is None else kept:
                    np.matmul(x, unit.T, out=d[:, at : at + len(unit)])
                    at += len(unit)
                if at != n:
                    raise RuntimeError(f"{at} of {n} rows in {path}")
                np.subtract(1, d, out=d)
                d.sort(axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(d @ weights), pa.list_(pa.float64())), pa.array(d.mean(1))], names=["id", "means", "cosine"])

    kind = dict(held.dtypes)["id"]
    means = held.select("id", "v").repartition(max(12, min(n, 192 if n >= 20000 else 12))).mapInArrow(part, f"id {kind}, means array<double>, cosine double")
    out = means.join(density, "id", "left")
    keys = [(k, p, i, q) for p in density_powers for k in neighbors for i, q in enumerate(distance_powers)]
    power = lambda k, p: 1 / F.pow(F.coalesce(F.col(f"near_{k}"), F.lit(0.0)) + 1e-9, F.lit(float(p)))
    scores = [x for k, p, i, q in keys for x in (F.lit(f"neighbor_{k}_density_{p}_distance_{q}"), F.avg(power(k, p) * F.get("means", F.lit(i))))]
    return out.agg(F.count("*").alias("num_samples"), F.avg("cosine").alias("cos_distance"), F.create_map(*scores).alias("scores"))


#: Of ``ngram_diversity``: ranges of hashes, tokens looked at once, hashes of one size that a task gathers.
HASH_RANGES, TOKENS_AT_ONCE, GATHERED = 512, 1 << 20, 1 << 22


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences, byte plane by byte plane, as few planes as it takes: one byte of their number, then the first hash."""
    steps = np.diff(hashes)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + hashes[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    width, flat = b[0], np.frombuffer(b, np.uint8, offset=9)
    steps = np.zeros((len(flat) // width if width else 0, 8), np.uint8)
    steps[:, :width] = flat.reshape(width, -1).T if width else 0
    return np.cumsum(np.concatenate([np.frombuffer(b, np.uint64, 1, 1), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ngram_diversity(tokens: DataFrame, column: str = "tokens", sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """n, distinct, total and their ratio over all n-grams of the whole set (arrays of tokens). Tasks send each distinct hash of theirs once, sorted and packed by ranges
    of hashes; a range's hashes meet in one task. What isn't distinct there (a few bytes a hash) is all that is shuffled; totals are sums of a number for each task."""

    def run(batches):
        gathered: dict[int, list[np.ndarray]] = {n: [] for n in sizes}
        totals = dict.fromkeys(sizes, 0)

        def rows(n: int, x: np.ndarray, total: int = 0):
            places = (x >> np.uint64(64 - HASH_RANGES.bit_length() + 1)).astype(np.int32)
            firsts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            cut = [packed(x[i:j]) for i, j in zip(firsts, np.append(firsts[1:], len(x)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), n, np.int32)), pa.array(places[firsts]), pa.array(cut, pa.binary()), pa.array([total] + [0] * (len(cut) - 1), pa.int64())], names=["n", "place", "hashes", "total"])

        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = b.column(0).flatten().to_numpy().view(np.uint64), np.cumsum(lengths)
            at = 0
            while at < len(lengths):  # whole rows, of so many tokens or one
                before = ends[at] - lengths[at]
                to = max(at + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
                h, n = flat[before : ends[to - 1]], lengths[at:to]
                at = to
                left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # tokens from here to the end of the row
                grams_, done = h, 1
                for size in sorted(sizes):
                    while done < size and len(grams_) > 1:
                        grams_ = (grams_[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[done : done + len(grams_) - 1]) * np.uint64(0xD6E8FEB86659FD93)
                        grams_, done = grams_ ^ grams_ >> np.uint64(29), done + 1
                    own = grams_[left[: len(grams_)] >= size] if done == size else grams_[:0]
                    totals[size] += len(own)
                    gathered[size].append(_distinct(own))
                    if sum(map(len, gathered[size])) > GATHERED:
                        gathered[size] = [_distinct(np.concatenate(gathered[size]))]
                        if len(gathered[size][0]) > GATHERED // 2:
                            yield rows(size, gathered[size].pop())
        for size in sizes:
            rest = _distinct(np.concatenate(gathered[size])) if gathered[size] else np.zeros(0, np.uint64)
            if len(rest):
                yield rows(size, rest, totals[size])
            elif totals[size]:  # all hashes are sent already
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([totals[size]], pa.int64())], names=["n", "place", "hashes", "total"])

    def merged(batches):
        key, held, total = None, [], 0

        def out():
            n = len(_distinct(np.concatenate(held))) if held else 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "distinct", "total"])

        for b in batches:
            for n, place, hashes, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if (n, place) != key:
                    if key:
                        yield out()
                    key, held, total = (n, place), [], 0
                total += t
                if hashes.is_valid:
                    held.append(unpacked(hashes.as_py()))
                    if sum(map(len, held)) > GATHERED and len(held) > 2 and sum(map(len, held[1:])) > len(held[0]):
                        held = [_distinct(np.concatenate(held))]
        if key:
            yield out()

    hashed = tokens.where(F.size(column) > 0).select(F.transform(column, lambda w: F.xxhash64(w)).alias("h"))
    sent = hashed.mapInArrow(run, "n int, place int, hashes binary, total long").repartition("n", "place").sortWithinPartitions("n", "place")
    c = sent.mapInArrow(merged, "n int, distinct long, total long").groupBy("n").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"))
    return c.select("n", "distinct", "total", (F.col("distinct") / F.col("total")).alias("diversity"))


def sampled_pairs(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """(i, j), i < j < n: k different ones of the n (n - 1) / 2 pairs, by a keyed permutation of the pairs' numbers. Nothing is drawn twice and no pairs are listed."""
    total = n * (n - 1) // 2
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    keys = np.random.default_rng(seed).integers(0, 1 << 63, 6, np.uint64)

    def permuted(x: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << half) - 1)
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (h >> np.uint64(32)) & low
        return left << np.uint64(half) | right

    def run(batches):
        for b in batches:
            q = permuted(b.column(0).to_numpy().astype(np.uint64))
            while (out := q >= np.uint64(total)).any():  # back into range along the permutation's cycle
                q[out] = permuted(q[out])
            q = q.astype(np.int64)
            j = ((1 + np.sqrt(1 + 8 * q.astype(np.float64))) / 2).astype(np.int64)
            j += (j * (j + 1) // 2 <= q).astype(np.int64) - (j * (j - 1) // 2 > q).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q - j * (j - 1) // 2), pa.array(j)], names=["i", "j"])

    return spark.range(min(k, total)).mapInArrow(run, "i long, j long")


def _sampled(rows: DataFrame, value: str, similarity, k: int, n: int, seed: int) -> DataFrame:
    """s: sum of similarity over k sampled pairs, n rows, k."""
    placed, _ = shared_table(with_positions(rows.select("id", F.col(value).alias("v")), ["id"]), "pair-sample")
    pairs = sampled_pairs(rows.sparkSession, n, k, seed)
    side = lambda c: placed.select(F.col("pos").alias(c), F.col("v").alias(f"v{c}"))
    got = pairs.join(side("i"), "i").join(side("j"), "j")
    return got.agg(F.coalesce(F.sum(similarity(F.col("vi"), F.col("vj"))), F.lit(0.0)).alias("s"), F.lit(n).cast("long").alias("n"), F.count("*").alias("k"))


def _pair_report(s: Column, n: Column, pairs: Column, taken: Column, **more: Column) -> list[Column]:
    return [F.when(n > 1, s / taken).when(n == 0, 0.0).alias("score"), n.alias("num_samples"), taken.cast("long").alias("num_pairs"), pairs.cast("long").alias("total_possible_pairs"), (taken < pairs).alias("is_sampled"), *(c.alias(k) for k, c in more.items())]


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def jaccard_of_records(records: DataFrame, n: int = 1, method: str = "direct", num_perm: int = 128, sample_pairs: int | None = None) -> DataFrame:
    """Mean Jaccard similarity of the n-gram sets of records' texts (id, instruction, input, output)."""
    grams_ = ngrams(grams(record_text()), n) if n > 1 else grams(record_text())
    sets = records.select("id", F.array_distinct(grams_).alias("v"))
    return minhash_pair_jaccard(sets, num_perm=num_perm) if method == "minhash" else average_pair_jaccard(sets, sample_pairs=sample_pairs)


def kmeans(rows: DataFrame, k: int, vector: str = "v", seed: int = 42, max_iter: int = 20) -> DataFrame:
    """The rows with ``cluster_label``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = rows.withColumn("_features", array_to_vector(doubles(F.col(vector))))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster_label").fit(vectors)
    return model.transform(vectors).drop("_features")


def task_distance(rows: DataFrame) -> DataFrame:
    """Mean over rows of the mean cosine distance to the other rows: 1 less the average pair similarity."""
    return average_pair_similarity(rows, "cosine").select((1 - F.col("score")).alias("score"), "num_samples")
