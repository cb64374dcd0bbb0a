"""Queries over whole tables and texts, against brute force."""

import math
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.operators import pointwise_udf as U
from gradeloom.operators import setwise as S
from gradeloom.queries.registry import QUERIES

WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
TEXTS = [" ".join(WORDS[i:k]) for i in range(3) for k in range(i + 1, 9)] + ["x " * 400 + "one two", "y " * 2000 + "one", "one " * 900 + "x"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_perplexity_has_long_documents(spark, folder):
    lp, w = np.array([-len(t) / 100 for t in TEXTS]), sum(map(len, TEXTS))
    r = QUERIES["perplexity"](spark, folder).first()
    assert r.perplexity == pytest.approx(math.exp(-lp.mean()), abs=1e-4)
    assert r.weighted_perplexity == pytest.approx(math.exp(-lp.sum() / w), abs=1e-6)
    assert r.bits_per_byte == pytest.approx(-lp.sum() / w / math.log(2), abs=1e-6)


def test_pair_jaccard_has_long_documents(spark, folder):
    sets = [set(re.findall(r"\w+", t)) for t in TEXTS]
    n = len(sets)
    want = np.mean([len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]])
    exact, about = QUERIES["apjs_direct"](spark, folder).first(), QUERIES["apjs_minhash"](spark, folder).first()
    assert exact.score == pytest.approx(want, abs=1e-6)
    assert about.score == pytest.approx(want, abs=0.05)
    assert exact[1:3] == about[1:3] == (n, n * (n - 1) // 2)


def test_counted_minima_equal_all_pairs(spark):
    rows = [(i, [f"w{j}" for j in range(i % 5, i + 20)]) for i in range(12)] + [(98, None), (99, [])]
    df = spark.createDataFrame(rows, "id long, v array<string>")
    low = lambda i: F.array_min(F.transform("v", lambda g: F.xxhash64(g, F.lit(i))))
    sign = F.array(*map(low, range(16)))
    a = np.array([r[0] for r in df.limit(12).select(sign).collect()])
    want = sum((a[i] == a[k]).mean() for i in range(12) for k in range(i)) / 91
    got = S.minhash_pair_jaccard(df, num_perm=16).first()
    assert got.score == pytest.approx(want)
    assert (got.num_samples, got.num_pairs) == (14, 91)


def test_drop_aligns_best_above_six_answers(spark):
    rng = np.random.default_rng(0)
    for shape in [(7, 7), (7, 8), (8, 7), (2, 7), (1, 1)]:
        for _ in range(10):
            t = np.round(rng.random(shape) * (rng.random(shape) < 0.6), 2)
            u = t if shape[0] <= shape[1] else t.T
            want = max(sum(u[i, k] for i, k in enumerate(c)) for c in permutations(range(u.shape[1]), u.shape[0]))
            assert U.best_assignment(t) == pytest.approx(want)
    # Greedy pairs "p q r" with "p q r s" (6 / 7) first, which leaves nothing to "r s t u".
    gold = ["p q r", "r s t u", *WORDS[:5]]
    pred = ["p q r s", "p q", *WORDS[:5]]
    assert U.drop_of(gold, pred)[1] == pytest.approx(round((0.8 + 2 * 2 / 8 + 5) / 7, 2))
    for _ in range(20):
        g, p = ([" ".join(rng.choice(list("pqrstuv"), rng.integers(1, 4))) for _ in range(7)] for _ in range(2))
        sets = [[frozenset(x.split()) for x in y] for y in (g, p)]
        table = [[2 * len(a & b) / (len(a) + len(b)) for b in sets[1]] for a in sets[0]]
        want = max(sum(table[i][k] for i, k in enumerate(c)) for c in permutations(range(7)))
        assert U.drop_of(g, p)[1] == pytest.approx(want / 7, abs=0.0051)


def test_drop_query_has_whole_texts(spark, tmp_path):
    said = [(1, 0, "user", "q q q same words here at once"), (1, 1, "assistant", "z z z same words here at once")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = QUERIES["drop_metrics"](spark, str(tmp_path)).first()
    assert (r.em, r.f1) == (0.0, 5 / 8)


def test_novelty_sum_has_no_row_cap(spark, monkeypatch):
    n = 20100
    x = np.random.default_rng(1).normal(size=(n, 2))
    monkeypatch.setattr(S, "nearest", lambda rows, *a, **b: rows.select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), (F.col("id") % 7 + 1).cast("double").alias("distance")))
    got = S.novelty_sum(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), (5,), (0.5,), (1,)).first()
    density = (1 / (np.arange(n) % 7 + 1 + 1e-9)) ** 0.5
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    w, scores, means = 1 / np.arange(1, n + 1), [], []
    for i in range(0, n, 100):
        d = 1 - u[i : i + 100] @ u.T
        means.append(d.mean())
        scores += (density[i : i + 100] * (np.sort(d, axis=1) @ w / w.sum())).tolist()
    assert got.scores["neighbor_5_density_0.5_distance_1"] == pytest.approx(np.mean(scores), rel=1e-9)
    assert (got.cos_distance, got.num_samples) == (pytest.approx(np.mean(means), rel=1e-9), n)


def test_bootstrap_query_has_1000_resamples(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got, few = QUERIES["bootstrap_stderr"](spark, str(tmp_path)).first().stderr, A.bootstrap_stderr(labels, "quality", "doc_id", 200).first().stderr
    assert got == pytest.approx(A.bootstrap_stderr(labels, "quality", "doc_id").first().stderr, abs=1e-8)
    assert got != pytest.approx(few)
