"""Answer metrics, mathematics, normal forms, texts of model scorers, plans, sinks: on literal rows and against brute force."""

import json
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import assembly as X
from gradeloom.functions import model_scores as P
from gradeloom.functions import normalizers as N
from gradeloom.functions import text as T
from gradeloom.functions import vector as V
from gradeloom.operators import checkers as K
from gradeloom.operators import corpus_metrics as C
from gradeloom.operators import grid as G
from gradeloom.operators import math_answers as MA
from gradeloom.operators import merging as M
from gradeloom.operators import pointwise_udf as U
from gradeloom.operators import setwise as S
from gradeloom.operators.backends import stub_factory
from gradeloom.plans.plan import ScorePlan
from gradeloom.plans.registry import MODELS
from gradeloom.sources import records as R
from gradeloom.streaming.resume import running_entropy, windowed_scores


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("form", "text", "want"),
    [
        (N.quiz, "The 007 well-known Cats, a dog!", "7.0 well known cats dog"),
        (N.quiz, "  the an a ", ""),
        (N.quiz, "1e3 1.5", "1000.0 15.0"),
        (N.trivia, "It's (OK)", "its ok"),
        (N.task_lines, "one . two", "one.\ntwo"),
        (N.school_math, "so it is #### -1,234.5 apples", "-1234.5"),
        (N.school_math, "none", "[invalid]"),
        (lambda v: N.multilingual(v, "en"), "the  Cat　and a ant…", "cat and ant"),
        (lambda v: N.multilingual(v, "fr"), "l'été, les amis", "été amis"),
        (lambda v: N.multilingual(v, "de", lower=False), "der Hund—das Tier", "Hund Tier"),
        (lambda v: N.multilingual(v, "xx"), "The cat.", "the cat"),
        (A.last_number, "1,234 and 5.5 left", "5.5"),
        (A.last_number, "none", "none"),
        (A.graded_letter, "A: fine", 1.0),
        (A.graded_letter, "It is B", 0.0),
        (A.bracket_rating, "Rating: [[7.5]] [[2]]", 7.5),
        (A.bracket_rating, "7", 0.0),
    ],
)
def test_normal_forms(spark, form, text, want):
    assert one(spark, text, form) == want


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("1/2", "0.5", 1), (r"\frac12", "0.5", 1), (r"\dfrac{3}{4}", "75%", 1), ("1,234", "1234", 1), (r"\sqrt{16}", "4", 1), (r"\sqrt[3]{27}", "3", 1), ("2^{10}", "1024", 1), ("x=5", "5", 1), (r"(1,\ 2)", "(1, 2.0)", 1), ("(1,2)", "[1,2]", 0), ("(1,2)", "(2,1)", 0),
     (r"50\text{ kg}", "50", 1), (r"\text{Yes}", "yes", 1), ("3", "4", 0), (r"1\frac{1}{2}", "1.5", 1), (r"2\pi", "6.283185307179586", 1), ("x^2+1", "x^2 + 1", 1), ("", "", 0), ("9^{9^{9}}", "1", 0), ("1/0", "1/0", 1), ("1/0", "2", 0), (r"90^\circ", "90", 1), ("-.5", r"-\frac{1}{2}", 1), (r"\$5.00", "5", 1), ("007", "7", 1)],
)
def test_equal_answers(a, b, same):
    assert MA.equal(a, b) == MA.equal(b, a) == bool(same)


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"so \boxed{\frac{1}{2}} yes", r"\frac{1}{2}"), (r"\boxed{1} then \boxed{2}", "2"), (r"\boxed 5", "5"), ("The final answer is $42$.", "42"), ("Answer: 3/4", "3/4"), ("we get 1,200 apples", "1,200"), (r"thus $x+1$ done", "x+1"), ("none", None), ("", None), (None, None), (r"\boxed{open", "ope")],
)
def test_extracted_answers(text, want):
    assert MA.extract(text) == want


def test_shares_of_samples(spark):
    df = spark.createDataFrame([("4", ["it is 4", r"\boxed{5}", r"\frac{8}{2}", ""]), ("4", []), (None, ["4"])], "g string, p array<string>")
    assert [r[0] for r in df.select(MA.solved_share(F.col("g"), F.col("p"))).collect()] == [0.5, None, None]
    assert df.select(MA.fail_rate(F.col("g"), F.col("p"))).first()[0] == 0.5
    assert df.select(MA.extracted(F.col("g"))).first()[0] == "4"


def test_lcs_and_edits_against_tables():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        common, edits = np.zeros((len(a) + 1, len(b) + 1), int), np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                common[i, j] = common[i - 1, j - 1] + 1 if x == y else max(common[i - 1, j], common[i, j - 1])
                edits[i, j] = min(edits[i - 1, j] + 1, edits[i, j - 1] + 1, edits[i - 1, j - 1] + (x != y))
        assert U.lcs(a, b) == common[-1, -1] == len(U.common_places(a, b)) and U.edit_distance(a, b) == edits[-1, -1]


def test_rouge_of_lines_and_novelty():
    assert U.rouge_lsum_of("the cat sat\non the mat", "on the mat\nthe cat sat") == 1.0
    assert U.rouge_of("the cat sat\non the mat", "on the mat\nthe cat sat")[2] == 0.5
    assert U.rouge_lsum_of("a b", "c d") == 0.0 == U.rouge_lsum_of("", "")
    assert U.novelty_of("a b c d", "a b x a b") == [1 / 3, 2 / 3, 2 / 3, 1 / 3, 1.0, 0.0]
    assert U.novelty_of("a", "") == [0.0] * 6


def test_translation_metrics(spark):
    same = spark.createDataFrame([("The cat sat on the mat, twice.", "The cat sat on the mat, twice.")] * 3, "g string, p string")
    assert {r.metric: r.score for r in C.corpus_scores(same, "g", "p").collect()} == pytest.approx({"bleu": 100.0, "chrf": 100.0, "chrf++": 100.0, "ter": 0.0})
    rows = [("the cat sat on the mat", "on the mat the cat sat"), ("a b c d e f", "a b x d e f g"), ("x", None), ("one two three four five", "one two three four")]
    df = spark.createDataFrame(rows, "g string, p string").repartition(3)
    got = {r.metric: r.score for r in C.corpus_scores(df, "g", "p").collect()}
    hits, totals, mine, theirs = [0] * 4, [0] * 4, 0, 0
    for g, p in rows:
        g, p = g.split(), (p or "").split()
        mine, theirs = mine + len(p), theirs + len(g)
        for n in range(4):
            a, b = (Counter(tuple(x[i : i + n + 1]) for i in range(len(x) - n)) for x in (g, p))
            hits[n] += sum(min(c, a[k]) for k, c in b.items())
            totals[n] += sum(b.values())
    want = 100 * math.exp(sum(math.log(h / t) for h, t in zip(hits, totals, strict=True)) / 4 + min(0, 1 - theirs / mine))
    assert got["bleu"] == pytest.approx(want)
    assert got["ter"] == pytest.approx(100 * (1 + 2 + 1 + 1) / 18)  # a shift; a change and an insertion; two deletions
    assert 0 < got["chrf++"] < 100 and 0 < got["chrf"] < 100
    assert C.corpus_scores(df.limit(0), "g", "p").count() == 0
    assert C.words_13a('He said: "3,5 and 4.", &amp; left.') == ["He", "said", ":", '"', "3,5", "and", "4", ".", '"', ",", "&", "left", "."]
    assert C.ter_counts("", "a") == [1, 0] and C.ter(np.array([1.0, 0.0])) == 100.0


def test_renyi_and_matching(spark):
    df = spark.createDataFrame([([0.5, 0.25, 0.25, 0.0], [[1.0, 0.0], [0.0, 2.0]], [[2.0, 0.0]], [[0.1, 0.9], [0.4, 0.2]])], "p array<double>, a array<array<double>>, b array<array<double>>, e array<array<double>>")
    p = F.col("p")
    got = df.select(V.renyi_entropy(p), V.renyi_entropy(p, 2), V.renyi_entropy(p, float("inf")), U.token_matching(F.col("a"), F.col("b")), U.singular_values(F.col("a")), A.faithfulness(F.col("e"))).first()
    assert got[0] == pytest.approx(1.5 * math.log(2)) and got[1] == pytest.approx(-math.log(0.375)) and got[2] == pytest.approx(math.log(2))
    assert tuple(got[3]) == pytest.approx((0.5, 1.0, 2 / 3)) and got[4] == pytest.approx([2.0, 1.0]) and got[5] == pytest.approx(0.65)


@pytest.mark.parametrize(
    ("text", "check", "args", "want"),
    [
        ("It is the end.\n", K.ends_with, ("the end.",), True),
        ('"It is the end."\n\t', K.ends_with, ("the end.",), True),
        ("\n\t　", K.no_comma, (), False),
        ("漢字 かな é", K.word_count, ("at least", 3), True),
        ("L'ÉTÉ est là", K.forbidden, (["été"],), False),
        ("étéx", K.forbidden, (["été"],), True),
        ("L'ÉTÉ", K.keywords, (["été"],), True),
        ("ÉTÉ NASA x", K.capital_words, ("at least", 2), True),
        (' "quoted"\n', K.quoted, (), True),
        ("<<\t　>>", K.title, (), False),
        ("a\n***\n　", K.paragraphs, (1,), True),
        ("\n　\nThe end", K.paragraph_first_word, (1, 1, "the"), True),
        ("a b c", lambda v: K.word_overlap(v, F.lit("b c d"), 2, 2), (), True),
        ("Il dit", lambda v: K.language(F.lit(None).cast("string"), "en"), (), True),
    ],
)
def test_checks_of_other_scripts(spark, text, check, args, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(K.followed(F.col("v"), check, *args)).first()[0] is want


def test_texts_of_model_scorers(spark):
    rows = [("i", "x", " o ", "r", "c", "a"), ("i ", "", "o", "r", "c\n", "a"), ("{output}", None, "One. Two!", None, None, None), ("", "  ", "", "", "", "")]
    df = spark.createDataFrame(rows, "instruction string, input string, output string, reference string, context string, answer string").selectExpr("*", "'q' example_question", "'e' example_output")
    got = {k: [tuple(r) for r in df.select(*(c.alias(n) for n, c in X.texts(k).items())).collect()] for k in X.TEXTS}
    assert len(got) == 40
    assert got["deberta"][0] == ("i\nx\n o ",) and got["deberta"][2] == ("{output}\nOne. Two!",)
    assert got["athene"] == [("i\nx", " o "), ("i ", "o"), ("{output}", "One. Two!"), ("\n  ", "")]
    assert got["skywork_qwen"][1] == ("i \n", "o") and got["skywork_qwen"][2] == ("{output}", "One. Two!")
    assert got["fineweb_edu"][2] == ("{output}\n\nOne. Two!",) and got["textbook"][0] == ("i x  o ",) and got["textbook"][2] == ("{output} One. Two!",)
    assert "#Question#:\n{output}\n#Response#:\nOne. Two! \n##Quality: " in got["deita_quality"][2][0]
    assert got["grand"][0] == ("i\nx\n", "o") and got["nuclear_norm"][1] == ("i ", "o") and got["grand"][3] == ("\n", "")
    assert got["ppl"] == [("i\nx\n o ",), ("i \no",), ("{output}\nOne. Two!",), ("  ",)]
    assert got["miwv"][1] == ("User: i \nAssistant: ", "User: i \nAssistant: o", "User: q\nAssistant: e\nUser: i \nAssistant: ", "User: q\nAssistant: e\nUser: i \nAssistant: o")
    assert got["selectit_token"][1][0] == ["Rate the response from 1 to 5.\nInstruction:i \nResponse:o\nThe answer is: \n"]
    assert got["unieval_fact"][2][0] == [f"question: Is this claim consistent with the document? </s> claim: {s} </s> document: {{output}}" for s in ("One.", "Two!")]
    assert got["unieval_dialog"][0][3] == ["question: Is this response consistent with knowledge in the fact? </s> response:  o  </s> fact: c\n"]
    assert [len(x) for x in got["unieval_sum"][2]] == [1, 2, 2, 1] and got["unieval_sum"][3][1] == []
    assert df.select(X.texts("norm_loss", compat=True)["text"]).first()[0] == "i\n o "
    with pytest.raises(ValueError):
        X.texts("none")
    lengths = spark.createDataFrame([(0,), (1,), (512,), (1100,)], "n int").select(X.chunk_lengths(F.col("n")))
    assert [r[0] for r in lengths.collect()] == [[], [1], [512], [512, 512, 76]]


def test_plan_reaches_all_kinds(spark, tmp_path):
    rec = spark.createDataFrame([("1", "say it", "", "it"), ("2", "why", "x", "so, because")], "id string, instruction string, input string, output string")
    vec = spark.createDataFrame([("1", [1.0, 0.0], 0), ("2", [0.0, 1.0], 0), ("3", [1.0, 1.0], 1)], "id string, v array<double>, label int")
    names = [m for m in MODELS if m != "miwv"]
    lines = "\n".join(f"  - {{name: {n}}}" for n in (*names, "str_length", "token_length", "token_entropy", "unique_ntoken", "knn", "aps", "cluster_inertia", "apjs", "partition_entropy"))
    plan = ScorePlan.from_yaml(f"scorers:\n{lines}\n  - {{name: knn, alias: near, k: 1}}\n  - {{name: aps, alias: some, sample_pairs: 2}}\n")
    words = lambda: lambda texts: ["<bos>7</eos>"] * len(texts)
    both = rec.selectExpr("*", "'r' reference", "'c' context", "'a' answer")
    plan.run(both, str(tmp_path), vec, {n: words if MODELS[n].kind == "string" else stub_factory(6) for n in names})
    point = {r.id: r.scores.asDict() for r in spark.read.json(str(tmp_path / "pointwise_scores")).collect()}
    assert set(point) == {"1", "2", "3"} and point["1"]["complexity"] == 7.0 and point["2"]["str_length"] == 17.0 and point["3"]["near"] == 1.0
    assert all(point["1"][n] is not None for n in names if n != "qurate")  # whose weights, from the stub, may add up to less than 0
    sets = {r.scorer: json.loads(r.result) for r in spark.read.json(str(tmp_path / "setwise_scores")).collect()}
    assert sets["some"]["is_sampled"] and sets["some"]["num_pairs"] == 2 and sets["some"]["total_possible_pairs"] == 3 and not sets["aps"]["is_sampled"]
    assert sets["cluster_inertia"]["cluster_sizes"] == {"0": 2, "1": 1} and sets["partition_entropy"]["counts"] == {"0": 2, "1": 1} and sets["apjs"]["num_pairs"] == 1


def test_dimension_scores(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.4, 0.9],), ([],)], "v array<double>")
    got = df.select(*P.dimension_scores(F.col("v"), [F.lit(1), F.lit(2), F.lit(1)], (1,))).collect()
    assert tuple(got[0]) == pytest.approx((0.1, 0.6, 0.9)) and tuple(got[1]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("metric", ["euclidean", "squared_euclidean", "manhattan", "cosine"])
def test_nearest_rows_against_all_distances(metric):
    rng = np.random.default_rng(0)
    r = np.round(rng.normal(size=(80, 3)), 1) + 1e6 * (metric != "cosine")
    r[20:40] = r[0]
    q = r[::4]
    d = G.distances(q, r, metric)
    skip = np.arange(0, 80, 4)[:, None] == np.arange(80)[None, :]
    for k, s in ((3, skip), (3, None), (79, skip), (200, skip)):
        i, j, got = G.nearest_of(q, r, k, metric, s)
        for x in range(len(q)):
            order = sorted((d[x, y], y) for y in range(80) if s is None or not s[x, y])[:k]
            assert j[i == x].tolist() == [y for _, y in order] and got[i == x] == pytest.approx([v for v, _ in order])


def test_ngram_diversity_by_hand(spark):
    rows = [["a", "b", "a", "b", "a"], ["a"], [], None, ["b", "a", "b"]]
    got = {r.n: (r.distinct, r.total) for r in S.ngram_diversity(spark.createDataFrame([(r,) for r in rows], "tokens array<string>"), sizes=(1, 2, 3, 6)).collect()}
    want = {}
    for n in (1, 2, 3):
        grams = [tuple(r[i : i + n]) for r in rows if r for i in range(len(r) - n + 1)]
        want[n] = (len(set(grams)), len(grams))
    assert got == want


def test_common_counts_against_sets():
    rng = np.random.default_rng(0)
    for n, m, v in ((30, 20, 8), (200, 150, 3000), (1, 1, 1), (40, 40, 400)):
        sets = [[set(rng.integers(0, max(1, int(v * rng.random() ** 3)) + 1, rng.integers(0, 60)).tolist()) for _ in range(k)] for k in (n, m)]
        flat = [np.array([x for s in side for x in s], np.int64) for side in sets]
        owner = [np.array([i for i, s in enumerate(side) for _ in s], np.int64) for side in sets]
        got = S.common_counts(flat[0], owner[0], n, flat[1], owner[1], m)
        assert (got == [[len(x & y) for y in sets[1]] for x in sets[0]]).all()


def test_nearest_by_map_and_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[10] = x[20]
    monkeypatch.setattr(G, "BLOCK_ROWS", 16)
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if kind == "long" else f"k{i:02}", v.tolist()) for i, v in enumerate(x)], f"id {kind}, v array<double>")
        got = []
        for most in (64 << 20, 0):
            monkeypatch.setattr(G, "BROADCAST_BYTES", most)
            got.append(sorted(map(tuple, G.nearest(df, df, 4).collect())))
            assert G.nearest(df.limit(0), df, 4).count() == G.nearest(df, df.limit(0), 4).count() == 0
        assert got[0] == got[1] and len(got[0]) == 240


def test_sampled_pairs_are_distinct_and_even(spark):
    for n, k in ((2, 5), (7, 21), (60, 700), (3000, 20000)):
        got = [tuple(r) for r in S.sampled_pairs(spark, n, k).collect()]
        assert len(set(got)) == len(got) == min(k, n * (n - 1) // 2) and all(0 <= i < j < n for i, j in got)
    assert abs(np.mean([j for _, j in got]) - 2000) < 25 and abs(np.mean([i for i, _ in got]) - 1000) < 25
    assert {tuple(r) for r in S.sampled_pairs(spark, 7, 21).collect()} == set(combinations(range(7), 2))
    sets = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 4)]) for i in range(40)], "id long, v array<string>")
    some = S.average_pair_jaccard(sets, sample_pairs=300).first()
    assert some.is_sampled and some.num_pairs == 300 and some.score == pytest.approx(S.average_pair_jaccard(sets).first().score, abs=0.05)


def test_positions_without_gathering(spark):
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k long, t string").repartition(5)
    got = R.with_positions(df, ["k"]).collect()
    assert sorted((r.k, r.pos) for r in got) == [(i, i) for i in range(50)]
    assert R.with_positions(df.limit(0), ["k"]).count() == 0


def test_records_in_and_out(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "7", "instruction": "a", "output": "b"}\n{bad\n')
    good, bad = R.read_jsonl_strict(spark, str(p))
    assert [r.id for r in good.collect()] == ["7"]
    assert [(r.id, r.score, r.error) for r in bad.collect()] == [("unknown", 0.0, "malformed line: {bad")]
    (tmp_path / "words").write_text("# list\nthe\nThe\n\nthe\n")
    assert R.read_words(str(tmp_path / "words")) == ["the", "The"]
    (tmp_path / "prompts").mkdir()
    for name in ("Q_All", "QA_Math_Difficulty", "notes"):
        (tmp_path / "prompts" / f"{name}.txt").write_text(f"{name} é\n")
    assert sorted(map(tuple, R.read_prompts(spark, str(tmp_path / "prompts")).collect())) == [("Q", "All", "Q_All é\n"), ("QA", "Math_Difficulty", "QA_Math_Difficulty é\n")]
    ids = spark.createDataFrame([(3,), (4,)], "id long")
    R.write_ids(ids, str(tmp_path / "ids"))
    R.write_ids(ids.limit(1), str(tmp_path / "ids"))
    assert sorted(r.id for r in R.read_ids(spark, str(tmp_path / "ids")).collect()) == ["3", "3", "4"]
    scored = spark.createDataFrame([("a", 1.0, 2, "x"), ("b", 3.0, 4, "y")], "id string, score double, other_score int, word string")
    R.write_summary(scored, str(tmp_path / "s"), details=True)
    assert spark.read.json(str(tmp_path / "s" / "summary")).first().asDict() == {"score": 2.0, "other_score": 3.0}
    assert spark.read.json(str(tmp_path / "s" / "details")).count() == 2
    R.write_details(scored.select("id", F.create_map(F.lit("pass"), "score").alias("metrics")), str(tmp_path / "d"))
    assert sorted(map(tuple, R.read_details(spark, str(tmp_path / "d"), "pass").collect())) == [("a", 0.0), ("b", -2.0)]
    assert [r.fail_rate for r in R.read_details(spark, str(tmp_path / "d"), "none").collect()] == [None, None]
    placed = R.with_positions(spark.range(7).toDF("id"), ["id"])
    shards = R.split_shards(placed, 3)
    assert sorted((r.id, r.shard) for r in shards.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)]
    assert R.union_shards(ids, ids.withColumn("more", F.lit(1))).count() == 4
    docs = spark.createDataFrame([(5, "t")], "doc_id long, text string")
    assert tuple(R.document_records(docs).first()) == ("5", "", "", "t")


def test_merging_odds_and_ends(spark):
    a = spark.createDataFrame([("1", 2.0, None), ("2", 0.0, "bad")], "id string, score double, error string")
    got = {r.id: r.scores for r in M.merge_records({"len": a, "again": a.limit(1)}).collect()}
    assert json.loads(got["2"]["len"]) == {"score": 0.0, "error": "bad"} and set(got["1"]) == {"len", "again"}
    assert {r.scorer: json.loads(r.result) for r in M.merge_setwise({"n": a.agg(F.count("*").alias("n"))}).collect()} == {"n": {"n": 2}}
    assert [json.loads(r.global_scores) for r in M.attach_global(a, a.agg(F.max("score").alias("m"))).collect()] == [{"m": 2.0}] * 2
    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, t string")
    batches = M.length_batches(rows, F.length("t"), 4).select("id", F.spark_partition_id().alias("p")).collect()
    longest = {p: min(r.id for r in batches if r.p == p) for p in {r.p for r in batches}}
    assert sorted(r.id for r in batches) == list(range(20)) and all(r.id <= longest[q] for r in batches for q in longest if q < r.p)
    labels = spark.createDataFrame([(0, 5), (2, 6), (9, 7)], "pos long, label int")
    assert sorted((r.pos, r.label) for r in M.attach_labels(spark.range(4).toDF("pos"), labels).collect()) == [(0, 5), (2, 6)]


def test_top_of_one_large_cluster(spark):
    rng = np.random.default_rng(0)
    scores = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(i, 0, float(s)) for i, s in enumerate(scores)] + [(5000 + i, None, None) for i in range(5)], "pos long, cluster_label int, score double")
    got = sorted(r.pos for r in M.top_of_clusters(df, 7).collect() if r.pos < 5000)
    assert got == sorted(sorted(range(3000), key=lambda i: (-scores[i], i))[: math.ceil(3000 * 7 / 100)])
    assert sum(r.pos >= 5000 for r in M.top_of_clusters(df, 7).collect()) == 1


def test_small_functions(spark):
    df = spark.createDataFrame([("a b c", "a b d", 10, 4)], "x string, y string, n int, c int")
    got = df.select(A.longest_common_prefix(F.col("x"), F.col("y")), A.longest_common_prefix(F.col("x"), F.col("x")), A.mean_g_pass_at(F.col("n"), F.col("c"), 4)).first()
    g = lambda t: sum(math.comb(4, j) * math.comb(6, 4 - j) for j in range(t, 5)) / math.comb(10, 4)
    assert tuple(got) == (2, 3, pytest.approx((g(3) + g(4)) * 2 / 4))
    t = spark.createDataFrame([(" i ", None, " o"), ("", " ", "")], "instruction string, input string, output string")
    assert [r[0] for r in t.select(T.stripped_fields()).collect()] == ["i\no", ""] and [r[0] for r in t.select(T.single_field()).collect()] == [" o", ""]
    by = spark.createDataFrame([(0, 2, 3.0), (1, 1, 5.0)], "label int, size long, inertia double")
    assert tuple(S.inertia_totals(by, 4).first()) == (8.0, 2.0)
    counts = one(spark, "The then", lambda v: T.logical_word_counts(v, ["the", "then", "no"]))
    assert counts == {"the": 2, "then": 1, "no": 0}


def test_truncated_texts(spark):
    df = spark.createDataFrame([("one two three four five",), ("漢字 かな",), ("",), (None,)], "t string")
    cut = U.truncated(spark, 3)
    got = [r[0] for r in df.select(cut(F.col("t"))).collect()]
    assert got[0] == "one two three" and "漢字 かな".startswith(got[1]) and got[2:] == ["", None]


def test_streamed_aggregates(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0, "3"), ("2024-01-01 00:01:00", "a", 3.0, "3"), ("2024-01-01 00:09:00", "b", 5.0, "x")], "t string, k string, v double, c string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = run(windowed_scores(stream(), "t", "v", "k"), "windows", "complete").collect()
    assert sorted((r.k, r.n, r["mean"]) for r in got) == [("a", 2, 2.0), ("b", 1, 5.0)]
    assert sorted((r.cluster, r["count"]) for r in run(running_entropy(stream(), "c"), "clusters", "complete").collect() if r.cluster) == [(3, 2)]


@pytest.mark.parametrize("metric", ["euclidean", "squared_euclidean", "cosine", "manhattan"])
def test_nearest_by_slices_computes_few_pairs(metric, monkeypatch):
    """The same rows and distances as from all pairs, of which few are computed in full."""
    rng, counted = np.random.default_rng(5), []
    x = rng.normal(size=(6000, 24))
    x[50:60] = x[40]
    x[70] = np.nan
    exactly = G._exactly
    monkeypatch.setattr(G, "_exactly", lambda q, r, i, j, m: counted.append(len(i)) or exactly(q, r, i, j, m))
    near = G.Nearest(np.arange(100), x[:100], 5, metric, True)
    for k in range(0, 6000, 500):
        near.add(np.arange(k, k + 500), x[k : k + 500])
    got = {}
    for parts in near.found():
        for q, rank, i, d in zip(*parts, strict=True):
            got.setdefault(int(q), []).append((rank, d, int(i)))
    d = G.distances(x[:100], x, metric)
    d[np.arange(100), np.arange(100)] = np.inf
    assert sorted(got) == [i for i in range(100) if i != 70]
    for q, found in got.items():
        want = sorted((v, i) for i, v in enumerate(d[q]) if np.isfinite(v))[:5]
        assert [v for _, v, _ in found] == pytest.approx([v for v, _ in want], abs=1e-12) and [r for r, *_ in found] == [1, 2, 3, 4, 5]
        if q not in (40, *range(50, 60)) or metric == "manhattan":
            assert [i for *_, i in found] == [i for _, i in want]
    assert sum(counted) < 100 * 6000 / 5


def test_absolute_values_have_a_curve_below():
    t = np.random.default_rng(0).normal(size=2000)
    half, c = G.under_absolute(t)
    x = np.linspace(-40, 40, 200001)
    assert (np.cos(np.pi / half * np.outer(x, np.arange(len(c)))) @ c <= np.abs(x) + 1e-12).all()


def test_novelty_sum_reads_the_vectors_once_a_task(spark, monkeypatch, tmp_path):
    slices = S.slices

    def counted(path, columns, rows=4096):
        import os
        import uuid

        open(os.path.join(str(tmp_path), uuid.uuid4().hex), "w").close()
        return slices(path, columns, rows)

    x = np.random.default_rng(3).normal(size=(600, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = S.novelty_sum(df).first()
    monkeypatch.setattr(S, "slices", counted)
    monkeypatch.setattr(S, "HELD_DISTANCES", 6000)
    assert S.novelty_sum(df).first().scores == pytest.approx(want.scores)
    assert 1 <= len(list(tmp_path.iterdir())) <= 12


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_blocks_are_read_and_not_copied_to_each_other(spark, monkeypatch, metric):
    x = np.random.default_rng(2).normal(size=(300, 5)) + 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = [(i, k) for i in range(300) for k in range(i)]
    d = np.array([np.abs(x[i] - x[k]).sum() if metric == "manhattan" else np.linalg.norm(x[i] - x[k]) for i, k in pairs])
    for rows in (40, 43, 2048):  # even and odd numbers of blocks
        monkeypatch.setattr(G, "BLOCK_ROWS", rows)
        s = S.average_pair_similarity(df, metric)
        plan = s._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan
        got = s.first()
        assert got.score == pytest.approx((1 / (1 + d)).mean(), rel=1e-6) and (got.num_samples, got.num_pairs) == (300, len(pairs))


def test_minima_make_no_objects_of_hashes():
    import tracemalloc

    import pyarrow as pa

    flat = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 1_200_000)
    b = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, 1_200_001, 300, dtype=np.int32), pa.array(flat))], names=["v"])
    tracemalloc.start()
    n = sum(x.num_rows for x in S._signed([b], 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < 16 << 20


def test_hashes_are_sent_once_and_packed(spark, monkeypatch):
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50000, dtype=np.uint64) << np.uint64(1))
    for some in (x, x[:1], x[:2], np.arange(7, dtype=np.uint64)):
        assert (S.unpacked(S.packed(some)) == some).all()
    assert len(S.packed(x[: len(x) // 512])) < 8 * len(x) // 512
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 40, rng.integers(1, 60)).astype(str).tolist() for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<string>").repartition(3)
    monkeypatch.setattr(S, "GATHERED", 500)
    monkeypatch.setattr(S, "TOKENS_AT_ONCE", 100)
    got = {r.n: (r.distinct, r.total) for r in S.ngram_diversity(df).collect()}
    for n in (1, 2, 3, 4):
        grams = [tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)]
        assert got[n] == (len(set(grams)), len(grams))


def test_character_counts_are_made_once_and_by_numbers(spark, monkeypatch):
    rng, made = np.random.default_rng(4), []
    for _ in range(60):
        g, p = ("".join(rng.choice(list("ab é日\U0001f600"), rng.integers(0, 30))) for _ in range(2))
        want = []
        for n in range(1, 7):
            a, b = ([t[i : i + n] for i in range(len(t) - n + 1)] for t in ("".join(p.split()), "".join(g.split())))
            want += [len(a), len(b), sum(min(a.count(x), b.count(x)) for x in set(a))]
        assert C.chrf_counts(g, p) == want == C.chrf_counts(g, p, 2)[:18]
        made.append((g, p))
    names = ("chrf", "chrf++")
    one = lambda m: C.corpus_scores(spark.createDataFrame(made, "g string, p string"), "g", "p", m).collect()
    both = {r.metric: r.score for r in one(names)}
    assert both == {r.metric: r.score for m in names for r in one((m,))}
    monkeypatch.setattr(C, "common_places", None)  # a text that has all its words in place but one needs no places
    assert C.ter_counts("a b c d e", "a b c d x") == [1, 5]


def test_gram_sets_are_read_and_not_copied_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    sets = [sorted({str(x) for x in rng.integers(0, 30, rng.integers(0, 20))}) for _ in range(40)]
    j = S.average_pair_jaccard(spark.createDataFrame(list(enumerate(sets)), "id long, v array<string>"))
    assert "Generate" not in j._jdf.queryExecution().optimizedPlan().toString()
    want = [len(set(a) & set(b)) / max(1, len(set(a) | set(b))) for i, a in enumerate(sets) for b in sets[:i]]
    got = j.first()
    assert got.score == pytest.approx(np.mean(want)) and (got.num_samples, got.num_pairs) == (40, 780)
