"""Normal forms of answers, translation metrics, mathematics, judged answers, plans with model scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import normalizers as N
from ..functions import vector as V
from ..operators import math_answers as MA
from ..operators import pointwise_udf as U
from ..operators.backends import stub_factory
from ..operators.corpus_metrics import corpus_scores
from .base import REC, SPACES, query, records, rounded, table, vectors

_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_OTHER = r"[^\p{L}\p{N}_]"


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACES}]+', ' ', 'g'))"


def _articles(x: str, language: str) -> str:
    """Twice, as neighbours share the sign between them."""
    words = "|".join(w for w in N.ARTICLES[language] if not w.endswith("'"))
    out = f"(' ' || {x} || ' ')"
    for _ in range(2):
        out = f"regexp_replace({out}, '({_OTHER})(?:{words})({_OTHER})', '\\1 \\2', 'g')"
    for w in N.ARTICLES[language]:
        if w.endswith("'"):
            out = f"regexp_replace({out}, '({_OTHER}){w}''([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')".replace(f"{w}''", w.replace("'", "''"))
    return f"substr({out}, 2, length({out}) - 2)"


def quiz_sql(x: str) -> str:
    bare = f"translate(lower(t), '{_PUNCTUATION}', '')"
    number = f"case when regexp_matches({bare}, '^[0-9]+$') then regexp_replace({bare}, '^0+([0-9])', '\\1') || '.0' when regexp_matches({bare}, '^[0-9]{{1,300}}e[0-9]{{1,3}}$') then try_cast({bare} as double)::varchar else {bare} end"
    return f"trim(array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '[ -]'), lambda t: {_spaced(_articles(number, 'en'))}), lambda t: t <> ''), ' '))"


def _multilingual(x: str, language: str) -> str:
    return _spaced(f"lower(regexp_replace({_articles(x, language)}, '[\\p{{P}}$+<=>^`|~]', '', 'g'))")


_MADE = "output || case length(output) % 4 when 0 then ' The 007 a-an end. It costs 1e3 . so' when 1 then chr(10) || '#### -1,234.5' when 2 then ' l''été et les amis, un jour' else '' end"


@query(f"""with {REC}, m as (select id, {_MADE} x from rec)
select id, md5({quiz_sql("x")}) quiz, md5(translate(lower(x), '{_PUNCTUATION}', '')) trivia, md5(replace(x, ' . ', '.' || chr(10))) task_lines,
  case when regexp_matches(x, '#### -?[0-9.,]+') then replace(regexp_extract(x, '#### (-?[0-9.,]+)', 1), ',', '') else '[invalid]' end school_math,
  md5({_multilingual("x", "en")}) english, md5({_multilingual("x", "fr")}) french from m""")
def normal_forms(spark, sf_dir):
    n, o = F.length("output") % 4, F.col("output")
    x = F.concat(o, F.when(n == 0, " The 007 a-an end. It costs 1e3 . so").when(n == 1, "\n#### -1,234.5").when(n == 2, " l'été et les amis, un jour").otherwise(""))
    r = records(spark, sf_dir).select("id", x.alias("x"))
    x = F.col("x")
    return r.select("id", F.md5(N.quiz(x)).alias("quiz"), F.md5(N.trivia(x)).alias("trivia"), F.md5(N.task_lines(x)).alias("task_lines"), N.school_math(x).alias("school_math"), F.md5(N.multilingual(x, "en")).alias("english"), F.md5(N.multilingual(x, "fr")).alias("french"))


@query("""with e as (select vec_id id, embedding::double[] v from embeddings), c as (select id, v[1:3] p, v[4:6] q, ['a', ' bcd', 'ef'] c from e)
select id, round(p[1], 6) by_char_1, round(p[2] / 4, 6) by_char_2, round(p[2] / 3, 6) no_space_2, round(p[3] / 3, 6) by_token_3, round(p[1] - q[1], 6) pmi_1 from c""")
def choice_norms(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.slice("v", 1, 3).alias("p"), F.slice("v", 4, 3).alias("q"), F.array(F.lit("a"), F.lit(" bcd"), F.lit("ef")).alias("c"))
    char, bare = N.per_character(F.col("p"), F.col("c")), N.per_character(F.col("p"), F.col("c"), True)
    token, pmi = N.per_token(F.col("p"), F.array(F.lit(1), F.lit(2), F.lit(3))), N.over_unconditioned(F.col("p"), F.col("q"))
    return v.select("id", rounded(char[0]).alias("by_char_1"), rounded(char[1]).alias("by_char_2"), rounded(bare[1]).alias("no_space_2"), rounded(token[2]).alias("by_token_3"), rounded(pmi[0]).alias("pmi_1"))


@query("""with e as (select vec_id id, list_transform(embedding::double[], lambda x: abs(x)) a from embeddings), p as (select id, list_transform(a, lambda x: x / list_sum(a)) p from e)
select id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) shannon, round(-ln(list_sum(list_transform(p, lambda x: x * x))), 6) collision, round(-ln(list_max(p)), 6) least from p""")
def renyi_entropy(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.transform("v", F.abs).alias("a"))
    p = v.select("id", F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda s, y: s + y)).alias("p"))
    return p.select("id", rounded(V.renyi_entropy(F.col("p"))).alias("shannon"), rounded(V.renyi_entropy(F.col("p"), 2)).alias("collision"), rounded(V.renyi_entropy(F.col("p"), float("inf"))).alias("least"))


@query("select doc_id, (doc_id % 3 = 0)::int::double letter, case when doc_id % 4 = 3 then 0.0 else (doc_id % 7) + 0.5 end::double rating from documents")
def judged_answers(spark, sf_dir):
    k = F.col("doc_id")
    letter = F.when(k % 3 == 0, "A: right").when(k % 3 == 1, "It is B").otherwise("no grade")
    rating = F.when(k % 4 == 3, "none").otherwise(F.concat(F.lit("Rating: [["), (k % 7 + F.lit(0.5)).cast("string"), F.lit("]] and [[1]]")))
    return table(spark, sf_dir, "documents").select("doc_id", A.graded_letter(letter).alias("letter"), A.bracket_rating(rating).alias("rating"))


@query("""with e as (select vec_id id, embedding::double[] v from embeddings), p as (select id, list_dot_product(v[1:32], v[33:64]) d, list_dot_product(v[1:32], v[1:32]) a, list_dot_product(v[33:64], v[33:64]) b from e)
select id, round(sqrt((a + b + sqrt((a - b) * (a - b) + 4 * d * d)) / 2), 6) largest, round(sqrt(greatest(a + b - sqrt((a - b) * (a - b) + 4 * d * d), 0) / 2), 5) smallest from p""")
def singular_values(spark, sf_dir):
    """Of a matrix of two rows, which have a closed form."""
    v = vectors(spark, sf_dir).select("id", U.singular_values(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("s"))
    return v.select("id", rounded(F.col("s")[0]).alias("largest"), rounded(F.col("s")[1], 5).alias("smallest"))


@query("""with e as (select vec_id id, embedding::double[] v from embeddings), p as (select id, list_cosine_similarity(v[1:16], v[17:32]) x, list_cosine_similarity(v[1:16], v[33:48]) y from e)
select id, round(greatest(x, y), 6) "precision", round((x + y) / 2, 6) recall from p""")
def token_matching(spark, sf_dir):
    """One candidate token, two reference tokens."""
    s = lambda i: F.slice("v", 16 * i + 1, 16)
    z = vectors(spark, sf_dir).select("id", U.token_matching(F.array(s(0)), F.array(s(1), s(2))).alias("z"))
    return z.select("id", rounded(F.col("z")["precision"]).alias("precision"), rounded(F.col("z")["recall"]).alias("recall"))


@query()
def corpus_translation(spark, sf_dir):
    """BLEU, chrF, chrF++ and TER of answers against the same with four words moved and one changed."""
    words = F.split("output", " ")
    turned = F.array_join(F.concat(F.slice(words, F.lit(5), F.size(words)), F.slice(words, 1, 4), F.array(F.lit("changed"))), " ")
    return corpus_scores(records(spark, sf_dir).select("output", turned.alias("turned")), "output", "turned").select("metric", rounded(F.col("score")).alias("score"))


@query("""select doc_id, case doc_id % 6 when 3 then 0.0 when 5 then 0.0 else 1.0 end::double matched, case doc_id % 6 when 3 then 1.0 when 5 then 1.0 else 0.5 end::double fail_rate from documents""")
def math_answers(spark, sf_dir):
    """Answers that equal the gold one in another spelling, and wrong ones."""
    k = (F.col("doc_id") % 6).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k + 1)
    gold = pick("so \\boxed{\\frac{1}{2}}", "1,234", "75\\%", "(1, 2)", "$x=5$", "7")
    pred = pick("The answer is 0.5.", "we get 1234 in all", "Thus $\\dfrac{3}{4}$", "\\boxed{(1, 3)}", "Answer: 5", "none")
    d = table(spark, sf_dir, "documents").select("doc_id", gold.alias("g"), pred.alias("p"))
    return d.select("doc_id", MA.matches(F.col("g"), F.col("p")).alias("matched"), MA.fail_rate(F.col("g"), F.array("p", F.lit("no"))).alias("fail_rate"))


@query(f"""with {REC}, h as (select id, instruction || case when input <> '' then chr(10) || input else '' end || chr(31) || output pair from rec)
select id, (('0x' || substr(md5('0:' || pair), 1, 4))::int % 2001 - 1000) / 250.0::double athene, (('0x' || substr(md5('0:' || pair), 1, 4))::int % 2001 - 1000) / 250.0::double rm from h""")
def model_plan(spark, sf_dir):
    """Model scorers from a YAML plan, with stubs as backends: texts assembled, asked and read in one pass."""
    from ..plans.plan import ScorePlan

    plan = ScorePlan.from_yaml("scorers:\n  - {name: athene}\n  - {name: rm_deberta, alias: rm}\n")
    return plan.model_scores(records(spark, sf_dir), {"athene": stub_factory(1), "rm": stub_factory(1)})
