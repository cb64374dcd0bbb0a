"""Scores from what models put out: log-probabilities, logits, generated text. No model runs here.

A backend (see operators.backends) fills columns with arrays; these expressions turn them into scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .vector import total


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def softmax(logits: Column) -> Column:
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return let(e, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def expected_class(logits: Column, first: int = 0) -> Column:
    """Sum of class number times probability; classes count from ``first``."""
    return total(F.transform(softmax(logits), lambda p, i: p * (i + first)))


def best_class(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def yes_share(p_yes: Column, p_no: Column) -> Column:
    return F.when(p_yes + p_no > 0, p_yes / (p_yes + p_no)).otherwise(0.0)


def ask_yes(log_probs: Column, worst: float = -100.0) -> Column:
    """Mean log-probability of the answer's tokens; ``worst`` without tokens."""
    return F.coalesce(mean(log_probs), F.lit(worst))


def perplexity(nll: Column) -> Column:
    return F.when(F.size(nll) > 0, F.exp(mean(nll))).otherwise(0.0)


def bits_per_token(nll: Column) -> Column:
    return mean(nll) / F.log(F.lit(2.0))


def follow_difficulty(nll_with_prompt: Column, nll_alone: Column) -> Column:
    """Perplexity of the output given its prompt over that of the output alone; -1 where either is missing or not positive."""
    a, b = perplexity(nll_with_prompt), perplexity(nll_alone)
    return F.coalesce(F.when((a > 0) & (b > 0), a / b), F.lit(-1.0))


def surprise_difference(nll: Column, entropy: Column, vocabulary: int) -> Column:
    """Mean over tokens of sigmoid(nll) * max(0, 1 - entropy / ln vocabulary)."""
    top = F.log(F.lit(float(vocabulary)))
    return F.coalesce(mean(F.zip_with(nll, entropy, lambda l, h: 1 / (1 + F.exp(-l)) * F.greatest(1 - h / top, F.lit(0.0)))), F.lit(0.0))


def thinking_probability(end_of_think: Column) -> Column:
    """1 less the chance that thinking ends at once, to three places; 1 where that token isn't among the candidates."""
    return F.round(1 - F.coalesce(end_of_think, F.lit(0.0)), 3)


def percentile(v: Column, share: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(v)
    at = (F.size(v) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(v) - 1))
    return a + (b - a) * (at - low)


def high_entropy_sum(entropies: Column, top_share: float = 0.005) -> Column:
    """Sum of the token entropies at or above their (1 - top_share) percentile."""
    kept = let(percentile(entropies, 1 - top_share), lambda cut: total(F.filter(entropies, lambda x: x >= cut)))
    return F.when(F.size(entropies) > 0, kept).otherwise(0.0)


def steady_rating(ratings: Column, alpha: float = 0.2) -> Column:
    """Mean over prompts, lowered by the population deviation: mean / (1 + alpha * deviation)."""
    sd = lambda m: F.sqrt(mean(F.transform(ratings, lambda x: (x - m) * (x - m))))
    return let(mean(ratings), lambda m: m / (1 + alpha * sd(m)))


def weighted_mean(values: Column, weights: Column) -> Column:
    w = total(weights)
    return F.when(w > 0, total(F.zip_with(values, weights, lambda x, y: x.cast("double") * y)) / w)


def three_level(low: Column, mid: Column, high: Column) -> Column:
    return 0 * low + mid + 2 * high


def parsed_level(raw: Column, low: int = 1, high: int = 10) -> Column:
    """The number between <bos> and <eos> marks or the first one, kept within bounds; null if there is none."""
    found = F.regexp_extract(raw, r"(-?\d{1,9})", 1)
    return F.when(found != "", F.least(F.greatest(found.cast("int"), F.lit(low)), F.lit(high)))


def tag_count(raw: Column) -> Column:
    """Tags in generated JSON: a list's length, 1 for an object, else 0."""
    n = F.json_array_length(raw)
    return F.coalesce(n, F.when(F.json_object_keys(raw).isNotNull(), 1), F.lit(0)).cast("int")


def choice_means(*dimensions: Column) -> Column:
    return sum(dimensions[1:], dimensions[0]) / len(dimensions)


def dimension_scores(answers: Column, sizes: list[Column], summed: tuple[int, ...] = ()) -> list[Column]:
    """A score per dimension from the answers to all questions in a row, ``sizes`` to each: their mean, or their sum for dimensions in ``summed``."""
    out, at = [], F.lit(1)
    for i, n in enumerate(sizes):
        part = F.slice(answers, at, n)
        out.append(total(part) if i in summed else F.coalesce(mean(part), F.lit(0.0)))
        at = at + n
    return out


def one_shot_gain(loss_with_example: Column, loss_alone: Column) -> Column:
    return loss_with_example - loss_alone


def spectrum_entropy(singular: Column, least: float = 1e-10) -> Column:
    """-sum p ln p of the normalised values above ``least``."""
    shares = lambda s: F.filter(F.transform(singular, lambda x: x / s), lambda x: x > least)
    return let(total(singular), lambda s: F.when(s > 0, -total(F.transform(shares(s), lambda x: x * F.log(x)))).otherwise(0.0))


def effective_rank(singular: Column) -> Column:
    return F.exp(spectrum_entropy(singular))


def nuclear_norm(singular: Column) -> Column:
    return total(singular)


def gradient_norm(flat: Column) -> Column:
    return F.sqrt(total(F.transform(flat, lambda x: x.cast("double") * x)))
