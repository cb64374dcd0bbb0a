import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import model_scores as P
from gradeloom.functions import vector as V
from gradeloom.operators import checkers as K
from gradeloom.operators import judge as J
from gradeloom.operators import merging as M
from gradeloom.operators import setwise as S
from gradeloom.plans.plan import ScorePlan, _subset
from gradeloom.sources import records as R
from gradeloom.streaming.resume import read_stream, score_stream


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(0).normal(size=(60, 4))
    x[3], x[4] = x[2], 0.0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_vector_functions(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 0.0, 1.0]
    df = spark.createDataFrame([(a, b, [0.0] * 3)], "a array<double>, b array<double>, z array<double>")
    x, y, z = F.col("a"), F.col("b"), F.col("z")
    got = df.select(V.cosine_similarity(x, y), V.cosine_similarity(x, z), V.cosine_distance(x, z), V.euclidean(x, y), V.manhattan(x, y), V.pearson(x, y), V.rbf(x, y), V.polynomial(x, y), V.pearson(z, x)).first()
    n = np.array
    assert tuple(got) == pytest.approx((n(a) @ b / np.linalg.norm(a) / np.linalg.norm(b), 0, 1, math.sqrt(9), 5, np.corrcoef(a, b)[0, 1], math.exp(-9), 6.0**3, 0))
    with pytest.raises(ValueError):
        V.named(V.DISTANCES, "none")


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "pearson", "euclidean"])
def test_average_similarity_equals_all_pairs(points, metric):
    from gradeloom.operators.grid import similarities

    x, df = points
    s = similarities(x, x, metric)
    want = s[np.triu_indices(len(x), 1)].mean()
    row = S.average_pair_similarity(df, metric).first()
    assert row.score == pytest.approx(want)
    assert (row.num_samples, row.num_pairs) == (60, 1770)
    one, none = S.average_pair_similarity(df.limit(1), metric).first(), S.average_pair_similarity(df.limit(0), metric).first()
    assert one.score is None and none.score == 0.0


def test_vendi_and_log_det(points):
    x, df = points
    u = np.delete(x, 4, 0)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    v = np.linalg.eigvalsh(u @ u.T / len(x))
    v = v[v > 1e-12]
    assert S.vendi(df).first().vendi_score == pytest.approx(np.exp(-(v * np.log(v)).sum()), rel=1e-6)
    full = np.vstack([u, np.zeros(4)])
    cosine = full @ full.T
    np.fill_diagonal(cosine, 1)  # a row without length too
    ridged = cosine + 1e-6 * np.eye(60)
    got = S.log_determinant(df).first()
    assert got.log_det == pytest.approx(np.linalg.slogdet(ridged)[1], rel=1e-6)
    assert got.similarity_matrix_stats.mean == pytest.approx(ridged.mean()) and got.similarity_matrix_stats.std == pytest.approx(ridged.std())
    assert got.eigenvalue_stats.max == pytest.approx(np.linalg.eigvalsh(ridged).max()) and got.is_positive_definite and (got.num_samples, got.embedding_dimension) == (60, 4)
    two = S.log_determinant(df.sparkSession.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "id long, v array<double>")).first()
    assert two.log_det == pytest.approx(2 * np.log1p(1e-6)) and two.is_valid
    same = S.log_determinant(df.sparkSession.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, v array<double>"), ridge=0.0).first()
    assert same.log_det is None and same.log_det_is_inf and same.sign == 0 and same.warning
    assert S.log_determinant(df.limit(0)).first().num_samples == 0
    with pytest.raises(ValueError):
        S.vendi(df, metric="euclidean", most_rows=10)


def test_novelty_sum(points):
    x, df = points
    n = len(x)
    ref = np.unique(x, axis=0)
    near = np.sort(((x[:, None] - ref[None]) ** 2).sum(2), axis=1)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    d = np.sort(1 - u @ u.T, axis=1)
    got = S.novelty_sum(df).first()
    assert len(got.scores) == 18 and got.num_samples == n and got.cos_distance == pytest.approx(d.mean())
    for k, p, q in ((5, 0.5, 1), (10, 0.25, 2), (5, 0, 0)):
        density = (1 / (near[:, 1 : k + 1].mean(1) + 1e-9)) ** p
        want = np.mean([density[i] * np.average(d[i], weights=1 / np.arange(1, n + 1) ** float(q)) for i in range(n)])
        assert got.scores[f"neighbor_{k}_density_{p}_distance_{q}"] == pytest.approx(want, rel=1e-6)


def test_minhash_estimates_jaccard(spark):
    rows = [(i, [f"w{j}" for j in range(i, i + 30)]) for i in range(12)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, v array<string>")
    exact, about = S.average_pair_jaccard(df).first(), S.minhash_pair_jaccard(df).first()
    sets = [set(v) for _, v in rows]
    want = np.mean([len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]])
    assert exact.score == pytest.approx(want)
    assert about.score == pytest.approx(want, abs=0.05)


def test_top_percent_ties_and_equal_scores(spark):
    df = spark.createDataFrame([(i, i // 10, 1.0 if i < 10 else float(i % 3)) for i in range(20)], "pos long, cluster_label int, score double")
    got = M.top_of_clusters(df, 25).collect()
    assert sum(r.cluster_label == 0 for r in got) == 3
    assert sorted(r.pos for r in got if r.cluster_label == 1) == [11, 14, 17]
    assert sorted(r.pos for r in M.top_of_clusters(df, 25).collect()) == sorted(r.pos for r in got)


def test_jsonl_ids_and_resume(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "7", "instruction": "a", "output": "b"}\n{bad\n{"instruction": "c", "output": "d"}\n')
    df = R.read_jsonl(spark, str(p))
    assert df.count() == 2 and R.count_valid(spark, str(p)) == 2
    got = {r.instruction: r.id for r in R.add_ids(df, ["instruction"]).collect()}
    assert got == {"a": "7", "c": "1"}
    done = spark.createDataFrame([("7",), ("",)], "id string")
    assert [r.instruction for r in M.resume(df, done).collect()] == ["c"]
    R.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_npy(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    rows = R.read_npy(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.vec for r in rows] == [[0, 1], [2, 3], [4, 5]]


def test_stream_resumes(spark, tmp_path):
    plan = ScorePlan.from_yaml("scorers:\n  - {name: str_length}\n  - {name: str_length, alias: again}\n")
    schema = "id string, instruction string, input string, output string"

    def run():
        score_stream(read_stream(spark, str(tmp_path / "in"), schema), plan, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted((r.id, r.str_length) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add = lambda *ids: spark.createDataFrame([(i, "x", "", "yy") for i in ids], schema).write.mode("append").parquet(str(tmp_path / "in"))
    add("1", "2")
    assert run() == [("1", 4.0), ("2", 4.0)]
    assert len(run()) == 2
    add("3")
    assert run() == [("1", 4.0), ("2", 4.0), ("3", 4.0)]


def test_plan_errors_and_subset():
    with pytest.raises(ValueError):
        ScorePlan.from_yaml("scorers:\n  - {name: nothing}\n")
    with pytest.raises(ValueError):
        ScorePlan.from_yaml("scorers:\n  - {name: str_length}\n  - {name: str_length}\n")
    assert _subset("a: 1\nscorers:\n  - name: hdd\n    sample_size: 10\n  - {name: x, words: [a, b]}\n") == {"a": 1, "scorers": [{"name": "hdd", "sample_size": 10}, {"name": "x", "words": ["a", "b"]}]}


PROMPT = [("Q", "All", '{instruction} "Clarity": <score_integer>')]


def judged(spark, tmp_path, rows, answer, **args):
    """Tables of a run, and the prompts that the backend was asked, from files as it runs in other processes."""
    at = str(tmp_path / "asked")

    def backend(prompts, temperature):
        with open(at, "a") as f:
            f.writelines(f"{temperature:g} {p}\n" for p in prompts)
        return [answer(p, temperature) for p in prompts]

    rec = spark.createDataFrame([(str(i), x, "x") for i, x in enumerate(rows)], "id string, instruction string, output string").coalesce(1)
    prompts = spark.createDataFrame(PROMPT, "mode string, metric string, template string")
    tables = J.collect(J.call(J.fan_out(rec, prompts), backend, wait=lambda s: None, **args))
    out = [sorted(map(tuple, t.collect())) for t in tables]
    with open(at) as f:
        return (*out, f.read().splitlines())


def test_judge_asks_each_prompt_once(spark, tmp_path):
    scored, errors, complete, asked = judged(spark, tmp_path, ["good"] * 100, lambda p, t: (json.dumps({"Clarity": 5}), "stop"))
    assert len(asked) == 100 and len(complete) == 100 and not errors and scored[0] == ("0", {"Q.All": {"Clarity": 5}})


def test_judge_asks_bad_answers_again_hotter(spark, tmp_path):
    def answer(p, t):
        if "raise" in p:
            raise ValueError("no")
        bad = {"json": "{", "keys": '{"Other": 5}', "high": '{"Clarity": 11}', "list": "[1]", "late": '{"Clarity": 5}' if t > 0.3 else "no"}
        return next((v for k, v in bad.items() if k in p), '{"Clarity": 5}'), "length" if "cut" in p else "stop"

    rows = ["good"] * 58 + ["raise", "json", "keys", "high", "late", "cut"]
    scored, errors, complete, asked = judged(spark, tmp_path, rows, answer, retries=2)
    assert [(i, e) for i, _, _, e in errors] == [("58", "no"), ("59", "no JSON object"), ("60", "other keys"), ("61", "bad score"), ("63", "cut off")]
    assert len(scored) == len(complete) == 59
    assert sum("late" in x for x in asked) >= 3 and max(float(x.split()[0]) for x in asked) == 0.4
    one_by_one = sum("good" in x for x in asked)
    assert one_by_one <= 2 * 58  # a batch that fails as a whole is asked one by one, once


@pytest.mark.parametrize("text", ['{"a": 3}', '{"a": " 7 "}', '{"a": 0}', '{"a": 11}', '{"a": "x"}', '{"b": 3}', '{"a": 3, "b": 1}', "[1]", "no", "{}", None, '{"a": null}', '{"a": 3, "reason": "so"}', '{"a": true}', '{"a": 2.5}'])
def test_answer_rules_agree(spark, text):
    for expected in (["a"], []):
        for finish in ("stop", "length"):
            df = spark.createDataFrame([(text, finish, expected)], "r string, f string, e array<string>")
            assert J.answer_error(text, finish, expected) == df.select(J.validation_error(F.col("r"), F.col("f"), F.col("e"))).first()[0]


def test_pass_at_is_monotone(spark):
    df = spark.createDataFrame([(10, 3)], "n int, c int")
    got = df.select(*(A.pass_at(F.col("n"), F.col("c"), k) for k in range(1, 11))).first()
    assert list(got) == pytest.approx([1 - math.comb(7, k) / math.comb(10, k) for k in range(1, 11)])
    g = df.select(A.g_pass_at(F.col("n"), F.col("c"), 4, 0.5)).first()[0]
    assert g == pytest.approx(sum(math.comb(3, j) * math.comb(7, 4 - j) for j in (2, 3)) / math.comb(10, 4))


def test_model_scores(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.3, 0.9],), ([],)], "v array<double>")
    got = df.select(P.perplexity(F.col("v")), P.high_entropy_sum(F.col("v"), 0.25)).collect()
    assert got[0][0] == pytest.approx(math.exp(0.45)) and got[1][0] == 0.0
    assert got[0][1] == pytest.approx(0.9) and got[1][1] == 0.0


@pytest.mark.parametrize(
    ("text", "check", "args", "want"),
    [
        ("", K.no_comma, (), False),
        ("a *** b", K.paragraphs, (2,), True),
        ("a ***  *** b", K.paragraphs, (2,), False),
        ("<<t>> x", K.title, (), True),
        ("a****** b", K.two_responses, (), True),
        ("a****** a", K.two_responses, (), False),
        ('"x"', K.quoted, (), True),
        ("* a\n- b", K.bullets, (2,), True),
        ('```json\n{"a": 1}\n```', K.json_format, (), True),
        ("x\n\nThe end", K.paragraph_first_word, (2, 2, "the"), True),
        ("a *changed* b", lambda v: K.rephrased(v, F.lit("a *old* b")), (), True),
        ("P.S. hi", K.postscript, (), True),
    ],
)
def test_checks(spark, text, check, args, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(K.followed(F.col("v"), check, *args)).first()[0] is want


def test_loose_drops_marks(spark):
    df = spark.createDataFrame([("Sure, here:\nno commas",)], "v string")
    assert not df.select(K.followed(F.col("v"), K.no_comma)).first()[0]
    assert df.select(K.followed_loosely(F.col("v"), K.no_comma)).first()[0]
