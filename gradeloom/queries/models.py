"""Judges, model outputs, answer metrics, instruction checks. Embedding components stand in for what models put out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import model_scores as P
from ..functions import normalizers as N
from ..functions import text as T
from ..operators import checkers as K
from ..operators import judge as J
from ..operators import pointwise_udf as U
from ..operators.backends import stub_factory, with_model
from .answers import _PUNCTUATION, quiz_sql
from .base import REC, SPACES, query, records, rounded, table, vectors

E = "e as (select vec_id id, embedding::double[] v, label, list_transform(embedding::double[], lambda x: abs(x)) nll from embeddings)"
SOFT = "list_transform(v[1:6], lambda x: exp(x - list_max(v[1:6])))"


def _nll(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("nll", F.transform("v", lambda x: F.abs(x)))


@query(f"""with {E}, s as (select *, {SOFT} s from e) select id,
  round(list_sum(list_transform(list_zip(s, range(0, 6)), lambda z: z[1] * z[2])) / list_sum(s), 6) class_0_5,
  round(list_sum(list_transform(list_zip(s, range(1, 7)), lambda z: z[1] * z[2])) / list_sum(s), 6) class_1_6,
  (list_position(v[1:6], list_max(v[1:6])) - 1)::int best, round((s[2] + 2 * s[3]) / list_sum(s[1:3]), 6) three_level, round(s[1] / (s[1] + s[2]), 6) yes_share from s""")
def class_scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    six, p = F.slice("v", 1, 6), P.softmax(F.slice("v", 1, 6))
    three = p[0] + p[1] + p[2]
    return v.select("id", rounded(P.expected_class(six)).alias("class_0_5"), rounded(P.expected_class(six, 1)).alias("class_1_6"), P.best_class(six).alias("best"), rounded(P.three_level(p[0], p[1], p[2]) / three).alias("three_level"), rounded(P.yes_share(p[0], p[1])).alias("yes_share"))


@query(f"""with {E} select id, round(exp(list_avg(nll)), 6) ppl, round(list_avg(nll) / ln(2), 6) norm_loss, round(exp(list_avg(nll[1:32])) / exp(list_avg(nll[33:64])), 6) ifd, round(list_avg(list_transform(v[1:8], lambda x: -abs(x))), 6) ask_llm,
  round(list_avg(nll[1:10]) - list_avg(nll[11:20]), 6) miwv, round(1 - nll[1], 3) thinking_prob,
  round(list_avg(list_transform(list_zip(nll[1:32], nll[33:64]), lambda z: 1 / (1 + exp(-z[1])) * greatest(1 - z[2] / ln(50.0), 0))), 6) upd from e""")
def loss_scores(spark, sf_dir):
    v, n = _nll(spark, sf_dir), F.col("nll")
    a, b = F.slice(n, 1, 32), F.slice(n, 33, 32)
    return v.select("id", rounded(P.perplexity(n)).alias("ppl"), rounded(P.bits_per_token(n)).alias("norm_loss"), rounded(P.follow_difficulty(a, b)).alias("ifd"), rounded(P.ask_yes(F.transform(F.slice("v", 1, 8), lambda x: -F.abs(x)))).alias("ask_llm"), rounded(P.one_shot_gain(P.mean(F.slice(n, 1, 10)), P.mean(F.slice(n, 11, 10)))).alias("miwv"), P.thinking_probability(n[0]).alias("thinking_prob"), rounded(P.surprise_difference(a, b, 50)).alias("upd"))


@query(f"""with {E}, c as (select *, list_sort(nll) s, 63 * 0.8 spot from e), q as (select *, s[floor(spot)::int + 1] + (s[floor(spot)::int + 2] - s[floor(spot)::int + 1]) * (spot - floor(spot)) cut from c)
select id, round(list_sum(list_filter(nll, lambda x: x >= cut)), 6) hes, round(list_avg(nll[1:5]) / (1 + 0.2 * sqrt(list_var_pop(nll[1:5]))), 6) selectit,
  round(list_sum(list_transform(list_zip(v[1:4], [4, 3, 2, 1]), lambda z: z[1] * z[2])) / 10, 6) qurate, round((nll[1] + nll[2] + nll[3]) / 3, 6) unieval_overall, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) grand from q""")
def rating_scores(spark, sf_dir):
    v, n = _nll(spark, sf_dir), F.col("nll")
    four = F.array(*(F.lit(float(x)) for x in (4, 3, 2, 1)))
    return v.select("id", rounded(P.high_entropy_sum(n, 0.2)).alias("hes"), rounded(P.steady_rating(F.slice(n, 1, 5))).alias("selectit"), rounded(P.weighted_mean(F.slice("v", 1, 4), four)).alias("qurate"), rounded(P.choice_means(n[0], n[1], n[2])).alias("unieval_overall"), rounded(P.gradient_norm(F.col("v"))).alias("grand"))


@query(f"""with {E}, p as (select id, nll, list_transform(nll, lambda x: x / list_sum(nll)) p from e)
select id, round(list_sum(nll), 6) nuclear_norm, round(-list_sum(list_transform(p, lambda x: case when x > 1e-10 then x * ln(x) else 0 end)), 6) svd_entropy, round(exp(-list_sum(list_transform(p, lambda x: case when x > 1e-10 then x * ln(x) else 0 end))), 5) effective_rank from p""")
def spectrum_scores(spark, sf_dir):
    n = F.col("nll")
    return _nll(spark, sf_dir).select("id", rounded(P.nuclear_norm(n)).alias("nuclear_norm"), rounded(P.spectrum_entropy(n)).alias("svd_entropy"), rounded(P.effective_rank(n), 5).alias("effective_rank"))


_RAW = "case doc_id % 4 when 0 then '<bos>' || (doc_id % 15)::varchar || '</eos>' when 1 then 'none' when 2 then '[1, 2, 3]' else '{\"a\": 1}' end"


@query(f"""with d as (select doc_id, {_RAW} raw from documents) select doc_id, case when regexp_matches(raw, '\\d') then least(greatest(regexp_extract(raw, '-?\\d+')::int, 1), 10) end level, case when doc_id % 4 = 2 then 3 when doc_id % 4 = 3 then 1 else 0 end::int tags from d""")
def generated_scores(spark, sf_dir):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("<bos>"), (F.col("doc_id") % 15).cast("string"), F.lit("</eos>"))).when(k == 1, "none").when(k == 2, "[1, 2, 3]").otherwise('{"a": 1}')
    return table(spark, sf_dir, "documents").select("doc_id", P.parsed_level(raw).alias("level"), P.tag_count(raw).alias("tags"))


@query(f"with {REC} select id, (('0x' || substr(md5('0:' || output), 1, 4))::int % 2001 - 1000) / 250.0::double score from rec")
def reward_model(spark, sf_dir):
    """How a backend is called, with a stub in a model's place: one number a text."""
    return with_model(records(spark, sf_dir), "output", stub_factory(1)).select("id", F.col("model_output")[0].alias("score"))


G = f"""{REC}, m as (select id, output, case hash_k % 4 when 0 then ' ' || output when 1 then output || ' more' when 2 then lower(output) else '' end pred from (select *, length(output) hash_k from rec))"""


def _answers(spark, sf_dir):
    o, k = F.col("output"), F.length("output") % 4
    pred = F.when(k == 0, F.concat(F.lit(" "), o)).when(k == 1, F.concat(o, F.lit(" more"))).when(k == 2, F.lower(o)).otherwise("")
    return records(spark, sf_dir).select("id", F.array("output").alias("golds"), F.array(pred).alias("preds"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
@query(f"""with {G}, s as (select id, {_STRIP.format("output")} g, {_STRIP.format("pred")} p, {quiz_sql("output")} gn, {quiz_sql("pred")} pn from m)
select id, (p <> '' and p = g)::int::double em, (p <> '' and starts_with(p, g))::int::double prefix_em, (p <> '' and ends_with(p, g))::int::double suffix_em, (pn <> '' and pn = gn)::int::double quasi_em from s""")
def exact_match(spark, sf_dir):
    g, p = F.col("golds"), F.col("preds")
    return _answers(spark, sf_dir).select("id", A.exact_match(g, p).alias("em"), A.exact_match(g, p, "prefix").alias("prefix_em"), A.exact_match(g, p, "suffix").alias("suffix_em"), A.exact_match(g, p, "full", N.quiz).alias("quasi_em"))


@query(f"""with {G}, s as (select id, list_distinct(list_filter(regexp_split_to_array(output, '\\s+'), lambda x: x <> '')) a, list_distinct(list_filter(regexp_split_to_array(pred, '\\s+'), lambda x: x <> '')) b from m)
select id, round(case when len(list_intersect(a, b)) > 0 then 2 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0 end, 6)::double f1 from s""")
def f1_bow(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", rounded(A.f1_words(F.col("golds"), F.col("preds"))).alias("f1"))


@query(f"""with {E}, r as (select id, v[1:4] v, label % 4 g from e), k as (select *, len(list_filter(list_zip(v, range(0, 4)), lambda z: z[1] > v[g + 1] or (z[1] = v[g + 1] and z[2] < g))) b from r)
select id, (b < 1)::int::double recall_at_1, (b < 2)::int::double recall_at_2, round(1 / (b + 1), 6)::double mrr, (list_position(v, list_max(v)) - 1 = g)::int::double acc,
  round(exp(v[g + 1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) gold_probability,
  (v[1] > list_max(v[3:4]))::int::double mc1, round((exp(v[1] - list_max(v)) + exp(v[2] - list_max(v))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) mc2 from k""")
def choice_metrics(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.slice("v", 1, 4).alias("v"), (F.col("label") % 4).cast("int").alias("g"))
    s, g = F.col("v"), F.col("g")
    mc1, mc2 = A.truthful_mc(s, F.lit(2))
    return v.select("id", A.recall_at(s, g, 1).alias("recall_at_1"), A.recall_at(s, g, 2).alias("recall_at_2"), rounded(A.reciprocal_rank(s, F.array(g))).alias("mrr"), A.likelihood_accuracy(s, F.array(g)).alias("acc"), rounded(A.gold_probability(s, F.array(g))).alias("gold_probability"), mc1.alias("mc1"), rounded(mc2).alias("mc2"))


@query(f"""with {E}, p as (select id, label, list_transform(v[1:8], lambda x: floor(x * 8)::int) p from e), u as (select id, unnest(p) x, unnest(range(1, 9)) i from p),
c as (select id, x, count(*) n, min(i) spot from u group by all), m as (select id, arg_max(x, (n, -spot)) majority from c group by id)
select m.id, majority, (majority = 0)::int::double maj_at_8 from m""")
def maj_at_k(spark, sf_dir):
    p = F.transform(F.slice("v", 1, 8), lambda x: F.floor(x * 8).cast("int"))
    return vectors(spark, sf_dir).select("id", A.majority(p, 8).alias("majority"), A.majority_at(F.lit(0), p, 8).alias("maj_at_8"))


def _choose(n: str, k: str) -> str:
    return f"(case when {k} < 0 or {k} > {n} then 0.0 when {k} = 0 then 1.0 else list_product(list_transform(range(1, ({k})::bigint + 1), lambda j: ({n} - {k} + j) / j)) end)"


@query(f"""with {E}, c as (select id, 48 n, len(list_filter(v[1:48], lambda x: x > 0)) c from e)
select id, round(case when n - c < 10 then 1.0 when c = 0 then 0.0 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 10 / i)) end, 6)::double pass_at_10,
  round(list_sum(list_transform(range(8, 17), lambda i: {_choose("c", "i")} * {_choose("(n - c)", "(16 - i)")})) / {_choose("n", "16")}, 6)::double g_pass_16_05 from c""")
def pass_at_k(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.lit(48).alias("n"), F.size(F.filter(F.slice("v", 1, 48), lambda x: x > 0)).alias("c"))
    return v.select("id", rounded(A.pass_at(F.col("n"), F.col("c"), 10)).alias("pass_at_10"), rounded(A.g_pass_at(F.col("n"), F.col("c"), 16, 0.5)).alias("g_pass_16_05"))


@query("""with k as (select g.c, count(*) filter (quality = g.c and toxic = g.c) tp, count(*) filter (quality <> g.c and toxic = g.c) fp, count(*) filter (quality = g.c and toxic <> g.c) fn from labels cross join (values (0), (1)) g(c) group by 1),
f as (select *, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end f1 from k)
select round(avg(f1), 6) macro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) micro, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) weighted from f""")
def corpus_f1(spark, sf_dir):
    return A.corpus_f1(table(spark, sf_dir, "labels"), "quality", "toxic").select(*(rounded(F.col(c)).alias(c) for c in ("macro", "micro", "weighted")))


@query("""with c as (select sum((quality = 1 and toxic = 1)::int)::double tp, sum((quality = 0 and toxic = 0)::int)::double tn, sum((quality = 0 and toxic = 1)::int)::double fp, sum((quality = 1 and toxic = 0)::int)::double fn from labels)
select round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) mcc from c""")
def matthews(spark, sf_dir):
    return A.matthews(table(spark, sf_dir, "labels"), "quality", "toxic").select(rounded(F.col("mcc")).alias("mcc"))


@query("""with d as (select -length(text) / 100.0::double lp, strlen(text) w from documents) select round(exp(-avg(lp)), 4) perplexity, round(exp(-sum(lp) / sum(w)), 6) weighted_perplexity, round(-sum(lp) / sum(w) / ln(2), 6) bits_per_byte from d""")
def perplexity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((-F.length("text") / F.lit(100.0)).alias("lp"), F.octet_length("text").alias("w"))
    return A.corpus_perplexity(d, "lp", "w").select(rounded(F.col("perplexity"), 4).alias("perplexity"), rounded(F.col("weighted_perplexity")).alias("weighted_perplexity"), rounded(F.col("bits_per_byte")).alias("bits_per_byte"))


@query("select round(avg(quality), 6) mean, round(stddev_samp(quality) / sqrt(count(quality)), 6) stderr from labels")
def mean_stderr(spark, sf_dir):
    return A.mean_stderr(table(spark, sf_dir, "labels"), "quality").select(rounded(F.col("mean")).alias("mean"), rounded(F.col("stderr")).alias("stderr"))


_EDGES = " + ".join(f"(u > {e!r})::int" for e in A.poisson_edges())


@query(f"""with r as (select quality v, k, md5('0:' || doc_id || ':' || k) m from labels cross join range(250) t(k) where quality is not null),
u as (select v, 4 * k + j b, (('0x' || substr(m, 8 * j::int + 1, 8))::bigint + 0.5::double) / 4294967296::double u from r cross join range(4) s(j)), w as (select b, v, {_EDGES} w from u)
select round(stddev_samp(x), 8) stderr from (select sum(w * v)::double / sum(w)::double x from w group by b)""")
def bootstrap_stderr(spark, sf_dir):
    return A.bootstrap_stderr(table(spark, sf_dir, "labels"), "quality", "doc_id", 1000).select(rounded(F.col("stderr"), 8).alias("stderr"))


@query()
def overlap_metrics(spark, sf_dir):
    return records(spark, sf_dir).select("id", U.overlap(F.col("instruction"), F.col("output")).alias("z")).select("id", "z.*")


_W = r"[\p{L}\p{N}_]"


def _overlap_sql() -> str:
    two = lambda t: f"[{t}[i] || ' ' || {t}[i + 1] for i in range(1, len({t}))]"
    part = lambda n, s, v: f"select id, {n} n, {s} s, unnest({v}) k from t"
    rows = " union all ".join([part(1, 0, "g"), part(1, 1, "p"), part(2, 0, two("g")), part(2, 1, two("p")), part(3, 0, "a"), part(3, 1, "w")])
    return f"""with {REC}, t as (select id, regexp_extract_all(lower(instruction), '[a-z0-9]+') g, regexp_extract_all(lower(output), '[a-z0-9]+') p, regexp_extract_all(lower(instruction), '{_W}+') a, regexp_extract_all(lower(output), '{_W}+') w from rec),
u as (select id, n, k, count(*) filter (s = 0) a, count(*) filter (s = 1) b from ({rows}) group by 1, 2, 3),
f as (select id, n, sum(least(a, b)) m, sum(a) x, sum(b) y, count(*) filter (b > 0) own, count(*) filter (b > 0 and a = 0) novel, count(*) filter (b > 1) again from u group by 1, 2)
select t.id, round(coalesce(max(2 * m / (x + y)) filter (n = 1), 0), 6)::double rouge1, round(coalesce(max(2 * m / (x + y)) filter (n = 2), 0), 6)::double rouge2,
  round(coalesce(max(novel / own) filter (n = 3 and own > 0), 0), 6)::double novel_1, round(coalesce(max(again / own) filter (n = 3 and own > 0), 0), 6)::double repeated_1 from t left join f using (id) group by 1"""




@query(_overlap_sql())
def ngram_overlap(spark, sf_dir):
    """Those of the overlap scores that SQL can count."""
    z = records(spark, sf_dir).select("id", U.ngram_overlap(F.col("instruction"), F.col("output")).alias("z"))
    return z.select("id", *(rounded(F.col(f"z.{c}")).alias(c) for c in ("rouge1", "rouge2", "novel_1", "repeated_1")))


_BAG = lambda c: f"list_transform(regexp_extract_all({c}, '[^{SPACES}]+'), lambda t: case when translate(lower(t), '{_PUNCTUATION}', '') in ('a', 'an', 'the') then '' else translate(lower(t), '{_PUNCTUATION}', '') end)"


@query(f"""with {REC}, b as (select id, {_BAG("instruction")} g, {_BAG("output")} p from rec), u as (select id, x, count(*) filter (s = 0) a, count(*) filter (s = 1) b from (select id, unnest(g) x, 0 s from b union all select id, unnest(p), 1 from b) group by 1, 2),
s as (select id, sum(least(a, b)) shared, bool_and(a = b) same from u group by 1)
select b.id, coalesce(same, true)::int::double em, floor(coalesce(shared, 0) / greatest(len(g), len(p), 1) * 1000000 + 0.5) / 1000000 f1 from b left join s using (id)""")
def drop_metrics(spark, sf_dir):
    """Every word of a text is an answer: of bags of one word, the best alignment has a closed form."""
    z = records(spark, sf_dir).select("id", U.drop_scores(T.words(F.col("instruction")), T.words(F.col("output")), None).alias("z"))
    return z.select("id", "z.em", (F.floor(F.col("z.f1") * 1000000 + 0.5) / 1000000).alias("f1"))


_S = rf"[{SPACES}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_V = _TRIM("v")
#: name -> check, arguments, SQL over v (the response), p (the prompt), t (v without white space around it)
_CHECKS = {
    "keywords": (K.keywords, (["the", "is"],), "regexp_matches(v, '(?i)the') and regexp_matches(v, '(?i)is')"),
    "keyword_frequency": (K.keyword_frequency, ("the", "at least", 3), "len(regexp_extract_all(v, '(?i)the')) >= 3"),
    "forbidden": (K.forbidden, (["idiot", "of", "été"],), " and ".join(f"not regexp_matches(v, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){w}(?:$|[^\\p{{L}}\\p{{N}}_])')" for w in ("idiot", "of", "été"))),
    "letter_frequency": (K.letter_frequency, ("e", "less than", 40), "length(lower(v)) - length(replace(lower(v), 'e', '')) < 40"),
    "sentences": (K.sentences, ("at least", 3), "len(regexp_extract_all(v, '[^.!?]+[.!?]+')) >= 3"),
    "words": (K.word_count, ("less than", 50), f"len(regexp_extract_all(v, '{_W}+')) < 50"),
    "placeholders": (K.placeholders, (1,), r"len(regexp_extract_all(v, '\[.*?\]')) >= 1"),
    "postscript": (K.postscript, (), rf"regexp_matches(lower(v), '(?m){_S}*p\.{_S}?s\..*$')"),
    "bullets": (K.bullets, (0,), r"len(regexp_extract_all(v, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(v, '(?m)^\s*-.*$')) = 0"),
    "constrained": (K.constrained, (), "contains(v, 'My answer is yes.') or contains(v, 'My answer is no.') or contains(v, 'My answer is maybe.')"),
    "title": (K.title, (), f"len(list_filter(regexp_extract_all(v, '<<([^\\n]+)>>', 1), lambda x: {_TRIM('x')} <> '')) > 0"),
    "ends_with": (K.ends_with, ("the.",), """ends_with(lower(regexp_replace(t, '^"+|"+$', '', 'g')), 'the.')"""),
    "quoted": (K.quoted, (), """length(t) > 1 and starts_with(t, '"') and ends_with(t, '"')"""),
    "capital_words": (K.capital_words, ("less than", 2), rf"len(list_filter(regexp_extract_all(v, '{_W}+'), lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '\p{{Ll}}'))) < 2"),
    "no_comma": (K.no_comma, (), "not contains(v, ',')"),
    "starts_some_line": (K.starts_some_line, ("The",), rf"regexp_matches(v, '(?m)^{_S}*The.*$')"),
    "key_sentences": (K.key_sentences, (["the", "of"], 2), "contains(v, 'the') and contains(v, 'of')"),
    "paragraphs": (K.paragraphs, (1,), rf"len(list_filter(q, lambda x: x <> '')) = 1 and len(list_filter(q[2:-2], lambda x: x = '')) = 0".replace("q", rf"list_transform(regexp_split_to_array(v, '\s?\*\*\*\s?'), lambda y: {_TRIM('y')})")),
    "highlights": (K.highlights, (1,), rf"len(list_filter(regexp_extract_all(v, '\*([^\n\*]*)\*', 1), lambda x: {_TRIM('x')} <> '')) + len(list_filter(regexp_extract_all(v, '\*\*([^\n\*]*)\*\*', 1), lambda x: {_TRIM('x')} <> '')) >= 1"),
    "sections": (K.sections, ("Section", 1), r"len(regexp_split_to_array(v, '\s?Section\s?\d+\s?')) - 1 >= 1"),
    "json": (K.json_format, (), r"json_valid(regexp_replace(t, '(?i)^```(?:json)?\s*|\s*```$', '', 'g'))"),
    "two_responses": (K.two_responses, (), rf"len(list_filter(q, lambda x: x <> '')) = 2 and len(list_distinct(list_filter(q, lambda x: x <> ''))) = 2 and len(list_filter(q[2:-2], lambda x: x = '')) = 0".replace("q", rf"list_transform(string_split(v, '******'), lambda y: {_TRIM('y')})")),
}
#: Checks that also see the prompt or a language label.
_MORE = {
    "repeats_prompt": (lambda v, p, en: K.repeats_prompt(v, p), f"starts_with(lower(t), lower({_TRIM('p')}))"),
    "all_capitals": (lambda v, p, en: K.all_capitals(v, en), r"v = upper(v) and regexp_matches(v, '\p{Lu}')"),
    "all_lower": (lambda v, p, en: K.all_lower(v, en), r"v = lower(v) and regexp_matches(v, '\p{Ll}')"),
    "first_word": (lambda v, p, en: K.paragraph_first_word(v, 1, 1, "the"), rf"""len(q) = 1 and lower(regexp_extract(q[1], '^\s*[''"]*([^\s.,?!''"]*)', 1)) = 'the'""".replace("q", rf"list_filter(string_split(v, chr(10) || chr(10)), lambda y: {_TRIM('y')} <> '')")),
    "rephrased": (lambda v, p, en: K.rephrased(v, p), r"regexp_replace(v, '\*[^*]*\*', '', 'g') = regexp_replace(p, '\*[^*]*\*', '', 'g')"),
    "word_overlap": (lambda v, p, en: K.word_overlap(v, p, 1, 50), f"len(list_intersect(list_distinct(regexp_extract_all(lower(v), '{_W}+')), list_distinct(regexp_extract_all(lower(p), '{_W}+')))) between 1 and 50"),
    "language": (lambda v, p, en: K.language(en, "en"), "true"),
}
#: Responses with ends that ASCII rules misread: white space of other kinds, letters of other scripts, marks that checks look for.
_ENDS = ["", "\n", "\n\t　", "\n漢字かな the.\n", "\n***\nmore", "******other", " *bright* <<Title>> [x]", "\nP.S. été"]
_ADD = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in _ENDS) + "]"
_RESPONSES = f"r as (select id, instruction p, case when length(output) % 9 = 8 then chr(10) || chr(9) when length(output) % 11 = 1 then '{{\"a\": [1, 2]}}' || chr(10) else output || {_ADD}[(length(output) % 8 + 1)::int] end v from rec), w as (select *, {_V} t from r)"


def _responses(spark, sf_dir):
    n, o = F.length("output"), F.col("output")
    v = F.when(n % 9 == 8, "\n\t").when(n % 11 == 1, '{"a": [1, 2]}\n').otherwise(F.concat(o, F.element_at(F.array(*map(F.lit, _ENDS)), (n % 8 + 1).cast("int"))))
    return records(spark, sf_dir).select("id", F.col("instruction").alias("p"), v.alias("v"))


@query(f"with {REC}, {_RESPONSES} select id, " + ", ".join(f"(t <> '' and ({s})) \"{k}\"" for k, (_, _, s) in _CHECKS.items()) + " from w")
def ifeval_checks(spark, sf_dir):
    return _responses(spark, sf_dir).select("id", *(K.followed(F.col("v"), f, *a).alias(k) for k, (f, a, _) in _CHECKS.items()))


@query(f"with {REC}, {_RESPONSES} select id, " + ", ".join(f"(t <> '' and ({s})) \"{k}\"" for k, (_, s) in _MORE.items()) + " from w")
def ifeval_more(spark, sf_dir):
    """Checks that see the prompt or a label too."""
    p, en = F.col("p"), F.lit("en")
    return _responses(spark, sf_dir).select("id", *(K.followed(F.col("v"), f, p, en).alias(k) for k, (f, _) in _MORE.items()))


_LOOSE = ["no_comma", "words", "ends_with", "quoted"]


def _loose_sql() -> str:
    lines = "string_split(v, chr(10))"
    part = lambda a, e: _TRIM(f"array_to_string({lines}[{a}:{e}], chr(10))")
    base = ["v", part(2, f"len({lines})"), part(1, f"len({lines}) - 1"), part(2, f"len({lines}) - 1")]
    made = f"select id, unnest([{', '.join([*base, *(f'replace({x}, chr(42), {chr(39) * 2})' for x in base)])}]) v from r"
    each = ", ".join(f"bool_or(t <> '' and ({_CHECKS[k][2]})) \"{k}\"" for k in _LOOSE)
    return f"with {REC}, {_RESPONSES}, x as ({made}), y as (select *, {_V} t from x) select id, {each} from y group by id"


@query(_loose_sql())
def ifeval_loose(spark, sf_dir):
    """Some checks with any of eight variants of the response."""
    return _responses(spark, sf_dir).select("id", *(K.followed_loosely(F.col("v"), _CHECKS[k][0], *_CHECKS[k][1]).alias(k) for k in _LOOSE))


PROMPTS = [("Q", "All", 'Rate: {instruction}\n{"Clarity": <score_integer>, "Difficulty": <score_integer>}'), ("QA", "All", 'Rate: {instruction} / {output}\n{"Relevance": <score_integer>}'), ("Q", "Clarity", 'Rate: {instruction}\n{"score": , "reason": }')]


def _prompts(spark):
    return spark.createDataFrame(PROMPTS, "mode string, metric string, template string")


@query(f"""with {REC}, p(mode, metric, template, expected) as (values ('Q', 'All', '{PROMPTS[0][2]}', ['Clarity', 'Difficulty']), ('QA', 'All', '{PROMPTS[1][2]}', ['Relevance']), ('Q', 'Clarity', '{PROMPTS[2][2]}', []::varchar[]))
select id, mode, metric, md5(replace(replace(template, '{{instruction}}', instruction), '{{output}}', output)) prompt, array_to_string(expected, ',') expected from rec, p""".replace("\n{", "' || chr(10) || '{"))
def judge_prompts(spark, sf_dir):
    return J.fan_out(records(spark, sf_dir), _prompts(spark)).select("id", "mode", "metric", F.md5("prompt").alias("prompt"), F.array_join("expected", ",").alias("expected"))


_ANSWERS = """case doc_id % 8 when 0 then '{"a": 3, "b": 7}' when 1 then '{"a": 0, "b": 7}' when 2 then '{"a": "7", "b": 11}' when 3 then '{"a": "x", "b": 1}' when 4 then '{"a": 3}' when 5 then 'no' when 6 then '{"a": 3, "b": 7, "reason": "so"}' else '{"a": 3, "b": 7, "c": 1}' end"""


@query("select doc_id, case doc_id % 8 when 0 then null when 1 then 'bad score' when 2 then 'bad score' when 3 then 'bad score' when 4 then 'other keys' when 5 then 'no JSON object' when 6 then null else 'other keys' end error from documents")
def judge_validate(spark, sf_dir):
    r = F.expr(_ANSWERS)
    return table(spark, sf_dir, "documents").select("doc_id", J.validation_error(r, F.lit("stop"), F.array(F.lit("a"), F.lit("b"))).alias("error"))


def _judge_sql() -> str:
    size = lambda t: f"length(replace(replace('{t}', '{{instruction}}', instruction), '{{output}}', output))".replace("\n", "' || chr(10) || '")
    all_q, all_qa, clarity = (size(t) for _, _, t in PROMPTS)
    return f"""with {REC} select id, '{{"Q.All":{{"Clarity":' || (1 + {all_q} % 10) || ',"Difficulty":' || (1 + ({all_q} + 1) % 10) || '}},"Q.Clarity":{{"score":' || (1 + {clarity} % 10) || '}},"QA.All":{{"Relevance":' || (1 + {all_qa} % 10) || '}}}}' scores from rec"""


@query(_judge_sql())
def judge_run(spark, sf_dir):
    """Prompts, the stub backend, validation and collection."""
    scored, errors, complete = J.collect(J.call(J.fan_out(records(spark, sf_dir), _prompts(spark))))
    return scored.join(complete, "id").select("id", F.to_json("scores").alias("scores"))


@query(f"""with {REC} select id, (1 + length(instruction) % 10)::double q_clarity, case when length(instruction) % 3 = 0 then 5.0 else (1 + length(output) % 10) end::double q_difficulty, null::double qa_relevance from rec""")
def judge_fold(spark, sf_dir):
    from ..operators.merging import Q_KEYS, QA_KEYS, with_empty_keys

    r = records(spark, sf_dir)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    n, k = F.length("instruction"), F.length("output")
    q = F.create_map(F.lit("Clarity"), 1 + n % 10, F.lit("Difficulty"), 1 + k % 10)
    one = F.struct(F.lit("Q.All").alias("key"), q.alias("value"))
    two = F.struct(F.lit("Q.Math_Difficulty").alias("key"), F.create_map(F.lit("Difficulty"), F.lit(5)).alias("value"))
    judged = r.select("id", F.map_from_entries(F.when(n % 3 == 0, F.array(one, two)).otherwise(F.array(one))).alias("scores"))
    out = J.fold(r.select("id", with_empty_keys(none, Q_KEYS).alias("Q_scores"), with_empty_keys(none, QA_KEYS).alias("QA_scores")), judged)
    return out.select("id", F.col("Q_scores")["Clarity"].alias("q_clarity"), F.col("Q_scores")["Difficulty"].alias("q_difficulty"), F.col("QA_scores")["Relevance"].alias("qa_relevance"))
