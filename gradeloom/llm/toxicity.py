"""Toxicity by non-negative positive-unlabelled learning.

Known: some texts confirmed toxic, and many texts whose label isn't used. With class prior pi the risk of a classifier g is
  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),
the second part being the risk on clean texts, which can't be negative. Where it would be, only that part is
stepped back, as the published method does. The classifier is logistic over the presence of words and of word beginnings
(three to five signs, so that inflected forms share evidence) and is trained in numpy by Adam on all drawn texts.

What is learned from is bounded by parameters: at most ``most_positive`` confirmed toxic texts and
``most_unlabelled`` texts of the training folds, drawn by a hash of the id; every one of them is used whole. Spark counts their
features, 64-bit hashes, by class and chooses among them; the driver gets the chosen ones, at most ``most_features``, and which of
them each drawn text holds, and trains. Copies among the drawn texts count once. The class prior is the share of toxic rows among all labelled rows of
the training folds. Features are those that stand in ``least_texts`` positive texts and whose shares in positive and unlabelled texts
differ by ``least_z`` standard errors; the ``most_features`` clearest are kept. Scoring is a map over all
texts, each seen whole: no shuffle.

Labels are learned from rows outside the held-out fold only, and never scored with; lang, source and doc_id aren't inputs.

Rows that repeat a doc_id are scored each by its own text, and take part in training with all their texts; labels that repeat one count as
toxic if any is. Null ids and null labels aren't learned from. Without a toxic or an unlabelled text every score is that of the bias; null and empty
texts always get it. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, kept_in_worker, materialize

STRIP = "".join(chr(b) for b in range(128) if not chr(b).isalnum())
BEGINNINGS = (3, 4, 5)


def features(raw: str) -> list[int]:
    """Of one word as it stands between spaces, lower-cased: signed 64-bit hashes of the word and its beginnings."""
    if not (word := raw.strip(STRIP)):
        return []
    parts = ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [int.from_bytes(xxhash.xxh64_digest(p.encode("utf-8", "surrogatepass")), "big", signed=True) for p in parts]


def _features():
    def each(rows):
        return [(label, sorted({f for w in set((text or "").lower().split()) for f in features(w)})) for label, text in rows]

    return each


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """The rows whose ids have the smallest hashes; only ids are ordered."""
    return rows.select("doc_id").orderBy(F.md5(F.concat(F.lit("pu:"), F.col("doc_id").cast("string"))), "doc_id").limit(most)


def risk_and_step(theta: np.ndarray, cols: np.ndarray, own: np.ndarray, n_p: int, n: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the gradient to step along: that of the risk, or of the clean part turned round where it is below 0.

    Text ``own[i]`` of n, of which the first n_p are positive, holds feature ``cols[i]``; theta ends with the bias.
    Logistic losses l(g) = log(1 + exp(-g)) and l(-g) = log(1 + exp(g)).
    """
    g = np.bincount(own, theta[cols], n) + theta[-1]
    p, u, s = g[:n_p], g[n_p:], 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    clean = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    slope = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / len(u)])
    if clean < 0:
        slope = -slope
    else:
        slope[:n_p] += prior * (s[:n_p] - 1) / n_p
    risk = float(prior * np.logaddexp(0, -p).mean() + max(0.0, clean))
    return risk, np.append(np.bincount(cols, slope[own], len(theta) - 1), slope.sum())


class NonNegativePU:
    """``fit`` on sparse rows (arrays of feature numbers); ``table`` maps features to weights."""

    def __init__(self, least_texts: int = 8, least_z: float = 6.0, most_features: int = 4000, steps: int = 400, rate: float = 0.05, decay: float = 1e-5):
        self.least, self.least_z, self.most, self.steps, self.rate, self.decay = least_texts, least_z, most_features, steps, rate, decay
        self.words, self.weights, self.bias, self.risks = np.empty(0, np.int64), np.empty(0), -4.0, []

    def _choose(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
        found, a = np.unique(np.concatenate(positive), return_counts=True)
        found, a = found[a >= self.least], a[a >= self.least]
        if not len(found):
            return found
        b = np.zeros(len(found), np.int64)
        for r in unlabelled:
            at = np.minimum(np.searchsorted(found, r), len(found) - 1)
            b[at[found[at] == r]] += 1
        n, m = len(positive), len(unlabelled)
        p = (a + b + 1) / (n + m + 2)
        z = np.abs(a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
        best = np.argsort(-z, kind="stable")[: self.most]
        return np.sort(found[best[z[best] >= self.least_z]])

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> NonNegativePU:
        """From each text's sorted features."""
        if not positive or not unlabelled:
            return self
        words = self._choose(positive, unlabelled)
        place = lambda r: (lambda at: at[words[at] == r])(np.minimum(np.searchsorted(words, r), len(words) - 1)) if len(words) else np.empty(0, np.int64)
        return self.learn(words, [*map(place, positive)], [*map(place, unlabelled)], prior)

    def learn(self, words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> NonNegativePU:
        """From the chosen features, sorted, and the numbers of those that each text holds."""
        if not positive or not unlabelled or not 0 < prior < 1:
            return self  # nothing to learn from: every score is that of the bias
        self.words, self.weights = words, np.zeros(len(words))
        if not len(words):
            return self
        kept, n_p = [*positive, *unlabelled], len(positive)
        theta = np.append(self.weights, self.bias)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        cols, own = np.concatenate(kept), np.repeat(np.arange(len(kept)), np.fromiter(map(len, kept), np.int64, len(kept)))
        for t in range(1, self.steps + 1):
            risk, grad = risk_and_step(theta, cols, own, n_p, len(kept), prior)
            self.risks.append(risk)
            grad += self.decay * np.append(theta[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = theta[:-1], float(theta[-1])
        return self

    def table(self, least_weight: float = 1e-3) -> dict[int, float]:
        big = np.abs(self.weights) >= least_weight
        return dict(zip(self.words[big].tolist(), self.weights[big].tolist(), strict=True))


REMEMBERED = 250_000


def _scores(table, bias: float):
    table = table.value
    key = ("toxicity", hash((bias, tuple(table.items()))))
    known = kept_in_worker(key, dict)

    def learn(word: str) -> tuple:
        if len(known) > REMEMBERED:
            known.clear()
        found = known[word] = tuple((f, table[f]) for f in features(word) if f in table)
        return found

    def score(text: str | None) -> float:
        hits: dict[int, float] = {}
        for word in set((text or "").lower().split()):
            if (found := known.get(word)) is None:
                found = learn(word)
            if found:
                hits.update(found)
        total = bias + sum(hits[f] for f in sorted(hits))  # in one order, so that reruns agree
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))

    def each(rows):
        return [(*row[:-1], score(row[-1])) for row in rows]

    return each


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, **args) -> NonNegativePU:
    """Fits on the driver from bounded, documented draws. Labels that are null or of held-out rows aren't read."""
    model = NonNegativePU(**args)
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return model.fit([], [], 0.0)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = _drawn(usable.where("toxic = 1").join(ids, "doc_id", "left_semi"), most_positive).withColumn("positive", F.lit(1))
    drawn = drawn.union(_drawn(ids.distinct(), most_unlabelled).withColumn("positive", F.lit(0)))
    drawn = F.broadcast(drawn)  # at most most_positive + most_unlabelled rows of two numbers
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "positive", "text")
    rows = arrow_map(texts.select("positive", "text"), "positive int, words array<long>", _features)
    rows = materialize(rows.dropDuplicates(["positive", "words"]), "toxicity-drawn")
    n = dict(map(tuple, rows.groupBy("positive").count().collect()))
    if len(n) < 2:
        return model.learn(np.empty(0, np.int64), [], [], float(prior))
    words = _chosen(rows, n[1], n[0], model)
    held = rows.mapInArrow(_places(docs.sparkSession.sparkContext.broadcast(words)), "positive int, at array<int>").toArrow()  # at most most_features numbers a drawn text
    label, lists = held.column("positive").to_numpy(), held.column("at").combine_chunks()
    at = np.split(lists.flatten().to_numpy().astype(np.int64), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    order = sorted(range(len(at)), key=lambda i: at[i].tobytes())  # reruns agree whatever the order of partitions
    return model.learn(words, [at[i] for i in order if label[i]], [at[i] for i in order if not label[i]], float(prior))


def _chosen(rows: DataFrame, n: int, m: int, model: NonNegativePU) -> np.ndarray:
    """As ``NonNegativePU._choose``, counted in Spark: at most ``most_features`` numbers come to the driver."""
    each = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("a"), F.sum(1 - F.col("positive")).alias("b")).where(F.col("a") >= model.least)
    p = (F.col("a") + F.col("b") + 1) / float(n + m + 2)
    z = F.abs(F.col("a") / float(n) - F.col("b") / float(m)) / F.sqrt(p * (1 - p) * (1 / n + 1 / m))
    best = each.select("word", z.alias("z")).where(F.col("z") >= model.least_z).orderBy(F.col("z").desc(), "word").limit(model.most)
    return np.sort(np.array([r.word for r in best.collect()], np.int64))


def _places(words):
    def run(batches):
        forget()
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(words.value, flat), max(len(words.value) - 1, 0))
            hit = words.value[at] == flat if len(words.value) else np.zeros(len(flat), bool)
            own = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            ends = np.append(0, np.cumsum(np.bincount(own[hit], minlength=b.num_rows)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit], pa.int32()))], names=["positive", "at"])

    return run


def scored(docs: DataFrame, model: NonNegativePU, columns: list[str]) -> DataFrame:
    """``row``, a struct of the given columns, and toxic_score (0 to 1): no names of ``docs`` clash."""
    table = docs.sparkSession.sparkContext.broadcast(model.table())
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("scored_text"))
    return arrow_map(rows, f"row {dict(rows.dtypes)['row']}, toxic_score double", _scores, table, model.bias)


def score(docs: DataFrame, model: NonNegativePU, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and toxic_score."""
    return scored(docs, model, list(keep)).select("row.*", "toxic_score")
