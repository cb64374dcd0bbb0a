"""Answer matching: one row holds the gold answers and the predictions of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let
from .vector import total


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def last_number(x: Column) -> Column:
    """The last number of a text, without thousands commas; the text if it has none."""
    found = F.regexp_extract_all(F.regexp_replace(x, r"(\d),(\d)", "$1$2"), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(x)


def exact_match(golds: Column, preds: Column, kind: str = "full", clean=strip) -> Column:
    """1 if some prediction equals (starts with, ends with) some gold answer. Empty predictions never do."""
    fits = {"full": lambda p, g: p == g, "prefix": lambda p, g: p.startswith(g), "suffix": lambda p, g: p.endswith(g)}[kind]
    g, p = F.transform(golds, clean), F.filter(F.transform(preds, clean), lambda x: x != "")
    return F.exists(p, lambda x: F.exists(g, lambda y: fits(x, y))).cast("double")


def _f1(g: Column, p: Column) -> Column:
    a, b = (F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")) for x in (g, p))
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def f1_words(golds: Column, preds: Column, clean=lambda x: x) -> Column:
    """Best F-measure over word sets of golds and predictions."""
    all_ = F.flatten(F.transform(golds, lambda g: F.transform(preds, lambda p: _f1(clean(g), clean(p)))))
    return F.coalesce(F.array_max(all_), F.lit(0.0))


def recall_at(scores: Column, gold: Column, k: int) -> Column:
    """1 if the gold choice (from 0) is among the k best; earlier choices win ties."""
    better = F.size(F.filter(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: (z["x"] > F.get(scores, gold)) | ((z["x"] == F.get(scores, gold)) & (z["i"] < gold))))
    return (better < k).cast("double")


def reciprocal_rank(scores: Column, golds: Column) -> Column:
    """1 over the best gold's place among the choices."""
    places = F.transform(golds, lambda g: F.size(F.filter(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: (z["x"] > F.get(scores, g)) | ((z["x"] == F.get(scores, g)) & (z["i"] < g)))) + 1)
    return 1.0 / F.array_min(places)


def likelihood_accuracy(scores: Column, golds: Column, lengths: Column | None = None) -> Column:
    """1 if the choice of highest (length-normalised) log-likelihood is gold."""
    s = scores if lengths is None else F.zip_with(scores, lengths, lambda x, n: x / F.greatest(n, F.lit(1)))
    best = (F.array_position(s, F.array_max(s)) - 1).cast("int")
    return F.array_contains(golds, best).cast("double")


def gold_probability(scores: Column, golds: Column) -> Column:
    """Share of probability mass on the gold choices."""
    e = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return total(F.transform(golds, lambda g: F.get(e, g))) / total(e)


def truthful_mc(scores: Column, n_true: Column) -> tuple[Column, Column]:
    """Whether the first choice beats all false ones, and the mass on the first n_true choices."""
    e = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    false = F.slice(scores, n_true + 1, F.size(scores))
    return (F.get(scores, F.lit(0)) > F.array_max(false)).cast("double"), total(F.slice(e, F.lit(1), n_true)) / total(e)


def majority(preds: Column, k: int) -> Column:
    """The most frequent of the first k; the first seen wins ties."""
    p = F.slice(preds, 1, k)
    counted = F.transform(F.array_distinct(p), lambda x: F.struct(F.size(F.filter(p, lambda y: y == x)).alias("n"), (-F.array_position(p, x)).alias("at"), x.alias("x")))
    return F.array_max(counted)["x"]


def majority_at(gold: Column, preds: Column, k: int) -> Column:
    return (majority(preds, k) == gold).cast("double")


def pass_at(n: Column, c: Column, k: int) -> Column:
    """Chance that k of n tries hold one of c right ones."""
    missed = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1 - k / i))
    return F.when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - missed)


def _choose(n: Column, k: Column) -> Column:
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(1.0), lambda p, i: p * (n - k + i) / i))


def g_pass_at(n: Column, c: Column, k: int, threshold: float) -> Column:
    """Chance that at least ceil(k * threshold), and one, of k tries are right."""
    import math

    m = max(math.ceil(k * threshold), 1)
    hits = F.sequence(F.lit(m).cast("long"), F.lit(k).cast("long"))
    return F.aggregate(hits, F.lit(0.0), lambda s, i: s + _choose(c.cast("long"), i) * _choose((n - c).cast("long"), F.lit(k) - i)) / _choose(n.cast("long"), F.lit(k).cast("long"))


def mean_g_pass_at(n: Column, c: Column, k: int) -> Column:
    import math

    low = math.ceil(k / 2) + 1
    return sum((g_pass_at(n, c, k, i / k) for i in range(low, k + 1)), F.lit(0.0)) * 2 / k


def longest_common_prefix(a: Column, b: Column) -> Column:
    """In words."""
    same = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("long")


def class_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """gold class -> tp, fp, fn, f1: one pre-aggregated shuffle."""
    one = df.select(F.explode(F.array(F.struct(F.col(gold).alias("c"), (F.col(gold) == F.col(pred)).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col(gold) != F.col(pred)).cast("long").alias("fn")), F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("tp"), (F.col(gold) != F.col(pred)).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("z")).select("z.*")
    g = one.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    return g.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def corpus_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Macro, micro and weighted F1 in one row."""
    support = F.col("tp") + F.col("fn")
    return class_f1(df, gold, pred).agg(F.avg("f1").alias("macro"), (2.0 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("micro"), (F.sum(F.col("f1") * support) / F.sum(support)).alias("weighted"))


def matthews(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Matthews correlation of 0/1 columns, 0 where undefined."""
    g, p = F.col(gold), F.col(pred)
    n = lambda a, b: F.sum(((g == a) & (p == b)).cast("double"))
    c = df.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    under = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return c.select(F.when(under > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / under).otherwise(0.0).alias("mcc"))


def corpus_perplexity(df: DataFrame, logprob: str, weight: str) -> DataFrame:
    s, w = F.sum(logprob), F.sum(weight)
    return df.agg(F.exp(-F.avg(logprob)).alias("perplexity"), F.exp(-s / w).alias("weighted_perplexity"), (-s / w / F.log(F.lit(2.0))).alias("bits_per_byte"))


def mean_stderr(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("stderr"))


def poisson_edges(most: int = 12) -> list[float]:
    """How likely a count of Poisson(1) is at most 0, 1, 2 and so on."""
    import math

    edges, p, total_ = [], math.exp(-1), 0.0
    for k in range(most):
        total_ += p
        edges.append(total_)
        p /= k + 1
    return edges


def bootstrap_stderr(df: DataFrame, value: str, id_col: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of the mean: every row draws its own weight in each resample, so a task sends two sums a resample and no rows are copied.

    A weight comes from eight hexadecimal digits of md5(seed:id:k), four resamples from each k. Rows without a value take no part.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    edges = np.array(poisson_edges())

    def run(batches):
        weight, summed = np.zeros(resamples), np.zeros(resamples)
        blocks = -(-resamples // 4)
        for batch in batches:
            for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u = np.frombuffer(b"".join(hashlib.md5(f"{seed}:{i}:{k}".encode()).digest() for k in range(blocks)), ">u4")[:resamples]
                w = np.searchsorted(edges, (u + 0.5) / float(1 << 32))
                weight += w
                summed += w * v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(summed)], names=["b", "w", "s"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(value).cast("double").alias("v")).where("v is not null")
    means = rows.mapInArrow(run, "b long, w double, s double").groupBy("b").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.agg(F.stddev_samp("m").alias("stderr"))


def faithfulness(entailment: Column) -> Column:
    """From a matrix of how far each source sentence (inner) entails each summary sentence (outer): the mean of the best."""
    return total(F.transform(entailment, lambda row: F.array_max(row))) / F.size(entailment)


def graded_letter(answer: Column) -> Column:
    """1 if a judge's first letter A, B or C is A (correct); without one 0."""
    return F.when(F.regexp_extract(answer, r"([ABC])", 1) == "A", 1.0).otherwise(0.0)


def bracket_rating(answer: Column) -> Column:
    """The first [[number]] of a judge's answer; 0 without one."""
    found = F.regexp_extract(answer, r"\[\[([0-9]+(?:\.[0-9]+)?)\]\]", 1)
    return F.when(found != "", found.cast("double")).otherwise(0.0)
