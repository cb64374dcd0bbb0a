"""Pointwise scores over instruction / output pairs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pointwise_udf as U
from ..operators.merging import merge_pointwise
from .base import GRAM, REC, T1, T2, WORD, query, records, rounded, table

LOGICAL = ["because", "therefore", "however", "if", "then", "The", "the", "and", "or", "not"]
DOC_TOKENS = f"regexp_extract_all(lower(text), '{GRAM}')"


@query(f"with {REC} select id, length({T2})::bigint score from rec")
def str_length(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.length(T.field_text()).cast("long").alias("score"))


def _substring_sql() -> str:
    low = f"lower({T2})"
    return " + ".join(f"(length({low}) - length(replace({low}, '{w.lower()}', ''))) // {len(w)}" for w in LOGICAL)


@query(f"with {REC} select id, ({_substring_sql()})::bigint score from rec")
def logical_words_substring(spark, sf_dir):
    return records(spark, sf_dir).select("id", T.logical_words(T.field_text(), LOGICAL).alias("score"))


_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~，。！？；：、（）【】《》“”‘’"


@query(f"""with {REC} select id, len(list_filter(regexp_extract_all(translate(lower({T2}), '{_MARKS}', '{" " * (len(_MARKS) - 1)}'), '{WORD}'),
  lambda w: list_contains(['because', 'therefore', 'however', 'if', 'then', 'the', 'and', 'or', 'not'], w)))::bigint score from rec""")
def logical_words_token(spark, sf_dir):
    return records(spark, sf_dir).select("id", T.logical_words(T.field_text(), LOGICAL, "token").alias("score"))


@query(r"select doc_id, case when regexp_matches(coalesce(text, ''), '(?i)</?(?:think|redacted_reasoning)\s*>') then 1.0 else 0.0 end::double score from documents")
def think_or_not(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_think(F.col("text")).alias("score"))


_BLOCK = r"<(think|redacted_reasoning)\s*>(.*?)</(?:think|redacted_reasoning)\s*>"
_MADE = "case doc_id % 5 when 0 then '<think>' || text || '</think>' || chr(96) || chr(96) || chr(96) || 'x' || chr(96) || chr(96) || chr(96) when 1 then '<think>a' || chr(96) || chr(96) || chr(96) || '</think>' || chr(96) || chr(96) || chr(96) when 2 then '<THINK >' || text when 3 then '<think>a</think>' || text else text end"


@query(f"""with d as (select doc_id, {_MADE} t from documents), e as (select *, regexp_replace(t, '{_BLOCK}', '', 'gis') o, regexp_extract(t, '{_BLOCK}', 2, 'is') f from d)
select doc_id, case when not regexp_matches(t, '(?i)</?(?:think|redacted_reasoning)\\s*>') then -2.0 when not contains(o, chr(96) || chr(96) || chr(96)) then -1.0
  when contains(f, chr(96) || chr(96) || chr(96)) then 0.0 else 1.0 end::double score from e""")
def pure_think(spark, sf_dir):
    """Over documents given tags and fences by id, as they hold none."""
    t, k = F.col("text"), F.col("doc_id") % 5
    made = F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</think>```x```"))).when(k == 1, "<think>a```</think>```").when(k == 2, F.concat(F.lit("<THINK >"), t)).when(k == 3, F.concat(F.lit("<think>a</think>"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", T.pure_think(made).alias("score"))


@query(f"""with {REC}, g as (select id, unnest(regexp_extract_all(lower({T1}), '{GRAM}')) g from rec), c as (select id, g, count(*) c from g group by all), s as (select id, sum(c) n, sum(c * log2(c)) l from c group by 1)
select rec.id, round(coalesce(greatest(log2(n) - l / n, 0), 0), 6)::double score from rec left join s using (id)""")
def gram_entropy(spark, sf_dir):
    return records(spark, sf_dir).select("id", rounded(T.entropy_bits(T.grams(T.record_text()))).alias("score"))


@query(f"""with {REC}, g as (select id, regexp_extract_all(lower({T1}), '{GRAM}') g from rec)
select id, round(case when len(g) < 2 then 0 else len(list_distinct([g[i] || chr(31) || g[i + 1] for i in range(1, len(g))])) / (len(g) - 1) end, 6)::double score from g""")
def unique_ngram(spark, sf_dir):
    return records(spark, sf_dir).select("id", rounded(T.unique_share(T.ngrams(T.grams(T.record_text()), 2))).alias("score"))


@query(f"""with {REC}, w as (select id, regexp_extract_all({T1}, '{WORD}') w from rec),
t as (select id, lower(translate(x, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')) x from (select id, unnest(w) x from w)),
c as (select id, x, count(*) f from t where x <> '' group by all),
s as (select c.id, sum((1 - list_product(list_transform(range(0, least(42, len(w))), lambda i: greatest(len(w) - f - i, 0) / (len(w) - i)))) / least(42, len(w))) score from c join w using (id) group by 1)
select w.id, round(coalesce(score, 0), 6)::double score from w left join s using (id)""")
def hdd(spark, sf_dir):
    return records(spark, sf_dir).select("id", rounded(U.hdd(T.record_text())).alias("score"))


_MTLD = f"""with recursive {REC}, w as (select id, list_transform(regexp_extract_all({T1}, '{WORD}'), lambda x: lower(translate(x, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''))) w from rec),
b as (select id, d, case when d = 0 then w else list_reverse(w) end w from w cross join (values (0), (1)) g(d)),
s(id, d, i, n, types, k) as (select id, d, 0, 0.0::double, []::varchar[], 0 from b union all
  select id, d, i + 1, n + (len(t) / (k + 1) <= 0.72)::int, case when len(t) / (k + 1) <= 0.72 then [] else t end, case when len(t) / (k + 1) <= 0.72 then 0 else k + 1 end
  from (select s.id, s.d, i, n, k, case when list_contains(types, w[i + 1]) then types else list_append(types, w[i + 1]) end t from s join b on b.id = s.id and b.d = s.d where i < len(w))),
f as (select s.id, len(w) l, n + case when k > 0 then (1 - len(types) / k) / (1 - 0.72::double) else 0 end f from s join b on b.id = s.id and b.d = s.d where i = len(w))
select id, round(avg(case when l = 0 then 0 when f > 0 then l / f else -1 end), 6)::double score from f group by id"""


@query(_MTLD)
def mtld(spark, sf_dir):
    return records(spark, sf_dir).select("id", rounded(U.mtld(T.record_text())).alias("score"))


@query()
def vocd_d(spark, sf_dir):
    return records(spark, sf_dir).select("id", U.vocd(T.record_text()).alias("score"))


@query()
def compress_ratio(spark, sf_dir):
    return records(spark, sf_dir).select("id", U.compress_ratio(T.field_text()).alias("score"))


@query()
def ts_python(spark, sf_dir):
    return records(spark, sf_dir).select("id", U.parses_as_python(F.col("output")).alias("score"))


@query()
def token_scores(spark, sf_dir):
    """Token length, entropy and unique bigram share in one pass, by the public 50k byte-level vocabulary."""
    z = U.token_scores(spark)(T.record_text())
    return records(spark, sf_dir).select("id", z.alias("z")).select("id", F.col("z.length").alias("token_length"), F.col("z.entropy").alias("token_entropy"), F.col("z.unique_share").alias("unique_ntoken"))


@query(f"""with {REC}, w as (select id, len(regexp_extract_all({T2}, '{WORD}')) n from rec) select id, n::int nodes, case when n > 0 then floor(log2(n))::int + 1 else 0 end::int depth from w""")
def tree_stats(spark, sf_dir):
    """Size and depth of trees from parent positions. No parser runs here: each word's parent is the one at half its position, which gives depths a closed form."""
    w = T.words(T.field_text())
    heads = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(i == 0, -1).otherwise(F.floor((i - 1) / 2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return records(spark, sf_dir).select("id", U.tree_stats(heads).alias("z")).select("id", "z.nodes", "z.depth")


@query(f"""with {REC}, s as (select id, length({T2})::double a, ({_substring_sql()})::double b, case when regexp_matches(output, '(?i)</?(?:think|redacted_reasoning)\\s*>') then 1.0 else 0.0 end::double c from rec)
select id, a str_length, b logical_words, c think_or_not from s""")
def pointwise_plan(spark, sf_dir):
    """The flagship: a YAML plan of pointwise scores, fused into one projection."""
    from ..plans.plan import ScorePlan

    plan = ScorePlan.from_yaml(f"""
scorers:
  - {{name: str_length}}
  - {{name: logical_words, words: [{", ".join(LOGICAL)}]}}
  - {{name: think_or_not}}
""")
    return plan.score(records(spark, sf_dir))


@query(f"with {REC} select id, map {{'a_length': length(output)::double, 'q_length': length(instruction)::double}}::varchar is not null has_scores, length(output)::double a_length, case when length(instruction) > 40 then length(instruction)::double end q_length from rec")
def pointwise_merge(spark, sf_dir):
    r = records(spark, sf_dir)
    a = r.select("id", F.length("output").alias("score"))
    q = r.where(F.length("instruction") > 40).select("id", F.length("instruction").alias("score"))
    m = merge_pointwise({"a_length": a, "q_length": q})
    return m.select("id", F.col("scores").isNotNull().alias("has_scores"), F.try_element_at("scores", F.lit("a_length")).alias("a_length"), F.try_element_at("scores", F.lit("q_length")).alias("q_length"))
