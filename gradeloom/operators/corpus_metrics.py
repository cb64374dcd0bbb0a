"""Corpus metrics of translations: counts per row in Arrow maps, one short array of sums for each task, the score from their total.

Scores are 0 to 100. One gold text per row; nulls are empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pointwise_udf import common_places, edit_distance

ORDER, CHARACTERS, WORDS, BETA = 4, 6, 2, 2.0
#: Fixed values of the published edit rate: how long and far a shift is, and how many are tried for a text at a time.
LONGEST_SHIFT, FARTHEST_SHIFT, MOST_SHIFTS = 10, 50, 1000

#: How the 13a scheme parts a line into words.
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPACED = ((re.compile(r"([{-~\[-` -&(-+:-@/])"), r" \1 "), (re.compile(r"([^0-9])([.,])"), r"\1 \2 "), (re.compile(r"([.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))


def words_13a(line: str) -> list[str]:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in _ENTITIES:
        line = line.replace(a, b)
    line = f" {line} "
    for p, to in _SPACED:
        line = p.sub(to, line)
    return line.split()


def _ngrams(items, n: int) -> Counter:
    return Counter(zip(*(items[i:] for i in range(n)), strict=False))


def bleu_counts(gold: str, pred: str) -> list[float]:
    """Matches and totals for each order, and both lengths."""
    g, p, out = words_13a(gold), words_13a(pred), []
    for n in range(1, ORDER + 1):
        a, b = _ngrams(g, n), _ngrams(p, n)
        out += [sum((a & b).values()), sum(b.values())]
    return [*out, len(p), len(g)]


def bleu(sums: np.ndarray) -> float:
    """Orders without a match count as half a match of the order, a quarter of the next, and so on."""
    hits, totals, (mine, theirs) = sums[0 : 2 * ORDER : 2], sums[1 : 2 * ORDER : 2], sums[-2:]
    if not mine or not totals.all() or not hits.any():
        return 0.0
    logs, half = 0.0, 1.0
    for h, n in zip(hits, totals, strict=True):
        if not h:
            half *= 2
        logs += math.log((h or 1 / half) / n)
    return 100 * math.exp(logs / ORDER + min(0.0, 1 - theirs / mine))


def _marks_apart(text: str) -> list[str]:
    """Words; a mark at a word's end, or else at its start, is a word of its own."""
    out = []
    for w in text.split():
        if len(w) > 1 and not w[-1].isalnum() and w[-1].isascii():
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and not w[0].isalnum() and w[0].isascii():
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _character_counts(gold: str, pred: str) -> list[float]:
    """For each order: n-grams of characters of the prediction, of the gold text, in both. n-grams of both texts are numbered order by order, from the number of the shorter one and the next character."""
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (gold, pred))
    x, y, out = a, b, []
    for n in range(1, CHARACTERS + 1):
        if n > 1:
            x, y = ((v[:-1] << 21) + c[n - 1 :] if len(v) else v for v, c in ((x, a), (y, b)))
        if len(x) and len(y):
            names, numbers = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y = numbers[: len(x)], numbers[len(x) :]
            both = np.minimum(np.bincount(x, minlength=len(names)), np.bincount(y, minlength=len(names))).sum()
        else:
            both = 0
            x, y = (np.zeros(len(v), np.int64) for v in (x, y))  # only counted from here on
        out += [len(y), len(x), int(both)]
    return out


def chrf_counts(gold: str, pred: str, words: int = 0) -> list[float]:
    """For each order of characters, then of words: n-grams of the prediction, of the gold text, in both."""
    out = _character_counts("".join(gold.split()), "".join(pred.split()))
    items = (_marks_apart(gold), _marks_apart(pred)) if words else ()
    for n in range(1, words + 1):
        a, b = (_ngrams(x, n) for x in items)
        out += [sum(b.values()), sum(a.values()), sum((a & b).values())]
    return out


def chrf(sums: np.ndarray) -> float:
    """F-beta of the mean precision and recall over the orders that both sides have."""
    mine, theirs, both = sums.reshape(-1, 3).T
    have = (mine > 0) & (theirs > 0)
    if not have.any():
        return 0.0
    p, r = (both[have] / mine[have]).mean(), (both[have] / theirs[have]).mean()
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r > 0 else 0.0


def _shifted(gold: list[str], pred: list[str]) -> list[str] | None:
    """The prediction with one run of words moved to where the gold text has it, if that lowers the edit distance most. Runs that stand right already, and gold words that are matched, start no move."""
    now, best, tried = edit_distance(pred, gold), None, 0
    most = now - (max(len(pred), len(gold)) - sum((Counter(pred) & Counter(gold)).values()))  # moves change no word: what is missing stays
    if most <= 1:
        return None
    placed = common_places(pred, gold)
    matched = set(placed.values())
    where: dict[str, list[int]] = {}
    for j, w in enumerate(gold):
        if j not in matched:
            where.setdefault(w, []).append(j)
    for i, w in enumerate(pred):
        for j in where.get(w, ()) if i not in placed else ():
            if i == j or abs(i - j) > FARTHEST_SHIFT:
                continue
            for n in range(1, LONGEST_SHIFT + 1):
                if i + n > len(pred) or j + n > len(gold) or pred[i + n - 1] != gold[j + n - 1]:
                    break
                if tried == MOST_SHIFTS:
                    return best[1] if best else None
                tried += 1
                if best is not None and (min(most, 2 * n), n) <= best[0]:  # n words out and in again are 2 n edits
                    continue
                rest = pred[:i] + pred[i + n :]
                moved = rest[:j] + pred[i : i + n] + rest[j:]
                gain = now - edit_distance(moved, gold)
                if gain > 1 and (best is None or (gain, n) > best[0]):  # a shift is an edit itself
                    best = ((gain, n), moved)
    return best[1] if best else None


def ter_counts(gold: str, pred: str) -> list[float]:
    """Edits, shifts of runs of words among them, and the gold text's words."""
    g, p, shifts = gold.lower().split(), pred.lower().split(), 0
    while g and p and (moved := _shifted(g, p)) is not None:
        p, shifts = moved, shifts + 1
    return [shifts + edit_distance(p, g), len(g)]


def ter(sums: np.ndarray) -> float:
    edits, words = sums
    return 100 * edits / words if words else 100.0 * bool(edits)


METRICS: dict[str, tuple[Callable[[str, str], list[float]], Callable[[np.ndarray], float]]] = {
    "bleu": (bleu_counts, bleu),
    "chrf": (chrf_counts, chrf),
    "chrf++": (lambda g, p: chrf_counts(g, p, WORDS), chrf),
    "ter": (ter_counts, ter),
}


def corpus_scores(df: DataFrame, gold: str, pred: str, metrics: tuple[str, ...] = ("bleu", "chrf", "chrf++", "ter")) -> DataFrame:
    """(metric, score), all in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for g, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = {m: METRICS[m][0](g or "", p or "") for m in metrics if m != "chrf" or "chrf++" not in metrics}
                for m in metrics:  # chrF's counts are the first of chrF++'s
                    sums[m] = sums.get(m, 0.0) + np.array(counts[m] if m in counts else counts["chrf++"][: 3 * CHARACTERS], float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["metric", "sums"])

    parts = df.select(F.col(gold).alias("g"), F.col(pred).alias("p")).mapInArrow(run, "metric string, sums array<double>")
    total: dict[str, dict[int, float]] = {}
    for r in parts.select("metric", F.posexplode("sums").alias("at", "x")).groupBy("metric", "at").agg(F.sum("x").alias("x")).collect():  # a few numbers a metric
        total.setdefault(r.metric, {})[r["at"]] = r.x
    rows = [(m, float(METRICS[m][1](np.array([total[m][i] for i in range(len(total[m]))])))) for m in metrics if m in total]
    return df.sparkSession.createDataFrame(rows, "metric string, score double")
