"""Putting scores together, resuming, selecting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.records import normalized_id

#: Templates of judged scores: question, and question with answer.
Q_KEYS = ("Clarity", "Coherence", "Completeness", "Complexity", "Correctness", "Meaningfulness", "Difficulty", "Deita_Complexity", "Thinking_Prob")
QA_KEYS = ("Clarity", "Coherence", "Completeness", "Complexity", "Correctness", "Meaningfulness", "Relevance", "IFD", "Deita_Quality", "Reward_Model", "Fail_Rate", "A_Length")


def resume(df: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id, as text, isn't done yet; an empty id never is. The done side is reduced to distinct ids first."""
    keys = done.select(normalized_id(id_col).alias("_done")).where("_done <> ''").distinct()
    return df.join(keys, normalized_id(df[id_col]) == keys._done, "left_anti")


def merge_pointwise(scored: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """id and a map from scorer to score, from tables of (id, score): one shuffle over the union instead of a chain of outer joins. The last row of an id wins by ``pos``, if given."""
    parts = []
    for name, df in scored.items():
        pos = F.col("pos") if "pos" in df.columns else F.lit(0)
        parts.append(df.select(normalized_id(id_col).alias("id"), F.lit(name).alias("scorer"), pos.cast("long").alias("pos"), F.col("score").cast("double").alias("score")))
    rows = reduce(DataFrame.union, parts).groupBy("id", "scorer").agg(F.max_by("score", "pos").alias("score"))
    entries = F.array_sort(F.collect_list(F.struct("scorer", "score")))  # a row per scorer
    return rows.groupBy("id").agg(F.map_from_entries(entries).alias("scores"))


def merge_records(scored: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """As ``merge_pointwise``, but what a scorer says of an id is kept whole (score, error, whatever else), as JSON."""
    parts = []
    for name, df in scored.items():
        pos = F.col("pos") if "pos" in df.columns else F.lit(0)
        rest = F.to_json(F.struct(*(c for c in df.columns if c not in (id_col, "pos"))))
        parts.append(df.select(normalized_id(id_col).alias("id"), F.lit(name).alias("scorer"), pos.cast("long").alias("pos"), rest.alias("said")))
    rows = reduce(DataFrame.union, parts).groupBy("id", "scorer").agg(F.max_by("said", "pos").alias("said"))
    return rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scorer", "said")))).alias("scores"))


def merge_setwise(results: dict[str, DataFrame]) -> DataFrame:
    """One row per scorer with its result as JSON."""
    return reduce(DataFrame.union, (df.select(F.lit(n).alias("scorer"), F.to_json(F.struct(*df.columns)).alias("result")) for n, df in results.items()))


def with_empty_keys(existing: Column, keys: tuple[str, ...]) -> Column:
    """A map with all keys, null where missing; what exists stays."""
    template = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit(None).cast("double") for _ in keys)))
    have = F.coalesce(existing, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return F.map_concat(F.map_filter(template, lambda k, v: ~F.map_contains_key(have, k)), have)


def merge_scores(records: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores (id, values: map) overwrite keys of Q_scores that exist there, else of QA_scores; other keys are dropped."""
    s = scores.groupBy(normalized_id(id_col).alias("_sid")).agg(F.last("values").alias("_values"))
    put = lambda m, free: F.transform_values(F.col(m), lambda k, v: F.when(free(k) & F.map_contains_key(F.coalesce("_values", F.create_map().cast("map<string,double>")), k), F.element_at("_values", k)).otherwise(v))
    joined = records.join(s, normalized_id(records[id_col]) == s._sid, "left")
    q = put("Q_scores", lambda k: F.lit(True))
    qa = put("QA_scores", lambda k: ~F.map_contains_key(F.col("Q_scores"), k))
    return joined.withColumns({"QA_scores": qa, "Q_scores": q}).drop("_sid", "_values")


def attach_global(records: DataFrame, scores: DataFrame) -> DataFrame:
    """A one-row result on every record, as JSON."""
    one = scores.limit(1).select(F.to_json(F.struct(*scores.columns)).alias("global_scores"))
    return records.join(F.broadcast(one))  # a single row


def merge_tracks(tracks: list[DataFrame]) -> DataFrame:
    """Distinct ids of all tracks, sorted as text; ``global_index`` goes before ``id``."""
    ids = (t.select((F.coalesce(F.col("global_index").cast("string"), F.col("id").cast("string")) if "global_index" in t.columns else F.col("id").cast("string")).alias("id")) for t in tracks)
    return reduce(DataFrame.union, ids).where("id is not null and id <> ''").distinct().orderBy("id")


def attach_labels(records: DataFrame, labels: DataFrame, pos: str = "pos") -> DataFrame:
    """By position; rows without a partner on either side go."""
    return records.join(labels, pos)


TOP_BINS = 4096


def top_of_clusters(df: DataFrame, percent: float, cluster: str = "cluster_label", score: str = "score", pos: str = "pos", seed: int = 42) -> DataFrame:
    """Of each cluster the ceil(n * percent / 100) best scores, earlier rows first among equals; where all scores are equal, a draw by hash.

    Sizes and extremes are pre-aggregated, and so is a histogram of each cluster's scores (ranks, where all are equal). Bins above the one that holds the last
    place are taken whole; only the rows of that bin are ranked together, so a large cluster isn't ordered in one task.
    """
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    stats = df.groupBy(cluster).agg(F.count("*").alias("_n"), F.min(s).alias("_low"), F.max(s).alias("_high"))
    rows = df.join(stats, df[cluster].eqNullSafe(stats[cluster])).drop(stats[cluster])
    drawn = F.xxhash64(pos, F.lit(seed))
    equal = F.col("_low") == F.col("_high")
    key = F.when(equal, drawn.cast("double")).otherwise(-s)
    share = F.when(equal, (drawn.cast("double") + float(1 << 63)) / float(1 << 64)).otherwise((F.col("_high") - s) / (F.col("_high") - F.col("_low")))
    # Equal scores are in one bin, and better ones never in a later bin, whatever the rounding.
    rows = rows.withColumn("_key", key).withColumn("_bin", F.least(F.floor(share * TOP_BINS), F.lit(TOP_BINS - 1)).cast("int")).withColumn("_k", F.ceil(F.col("_n") * percent / 100))
    bins = rows.groupBy(cluster, "_bin", "_k").agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(W.partitionBy(cluster).orderBy("_bin"))
    cut = bins.select(cluster, "_k", "_bin", (upto - F.col("_size")).alias("_before"), upto.alias("_upto")).where("_before < _k and _upto >= _k").select(F.col(cluster).alias("_c"), F.col("_bin").alias("_cut"), "_before")
    placed = rows.join(cut, rows[cluster].eqNullSafe(cut["_c"]))
    above = placed.where("_bin < _cut").select(df.columns)
    edge = placed.where("_bin = _cut").withColumn("_rank", F.row_number().over(W.partitionBy(cluster).orderBy("_key", pos)))
    return above.union(edge.where("_rank <= _k - _before").select(df.columns))


def list_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def first_of_each(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key: a pre-aggregated minimum, then a semi join."""
    keyed = df.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(pos).alias("_first")).select("_first")
    return keyed.join(firsts, F.col(pos) == F.col("_first"), "left_semi").drop("_key")


def few_shot(df: DataFrame, n: int, label: str | None = None, order: str = "pos", seed: int | None = None) -> DataFrame:
    """n examples: the first ones, the first of a seeded shuffle, or class by class in turn."""
    key = F.col(order) if seed is None else F.xxhash64(order, F.lit(seed))
    if label is None:
        return df.orderBy(key).limit(n)
    turn = F.row_number().over(W.partitionBy(label).orderBy(key))
    return df.withColumn("_turn", turn).orderBy("_turn", label).limit(n).drop("_turn")


def length_batches(df: DataFrame, length: Column, splits: int) -> DataFrame:
    """Longest first in ``splits`` ranges, for batches of even length; ids restore the order."""
    d = df.withColumn("_length", length)
    return d.repartitionByRange(splits, F.col("_length").desc()).sortWithinPartitions(F.col("_length").desc()).drop("_length")
