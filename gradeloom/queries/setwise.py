"""Whole-set scores, neighbours and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merging as M
from ..operators import setwise as S
from ..operators.grid import nearest
from .base import GRAM, query, rounded, table, vectors

V = "v as (select vec_id id, embedding::double[] v, label from embeddings)"
EUCLID = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
MANHATTAN = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
_APS = {"cosine": "list_cosine_similarity(a.v, b.v)", "euclidean": f"1 / (1 + {EUCLID})", "manhattan": f"1 / (1 + {MANHATTAN})", "dot_product": "list_dot_product(a.v, b.v)", "pearson": "list_cosine_similarity(x.c, y.c)"}


def _aps(metric: str):
    def f(spark, sf_dir):
        return S.average_pair_similarity(vectors(spark, sf_dir), metric).select(rounded(F.col("score")).alias("score"), "num_samples", "num_pairs", "total_possible_pairs", "is_sampled")

    f.__name__ = f"aps_{metric}"
    sql = f"with {V}, c as (select id, list_transform(v, lambda x: x - list_avg(v)) c from v) select round(avg({_APS[metric]}), 6) score, (select count(*) from v) num_samples, count(*) num_pairs, count(*) total_possible_pairs, false is_sampled from v a join v b on a.id < b.id join c x on x.id = a.id join c y on y.id = b.id"
    return query(sql)(f)


for _m in ("cosine", "euclidean", "manhattan", "dot_product", "pearson"):
    _aps(_m)


@query(f"""with g as (select doc_id, list_distinct(regexp_extract_all(lower(text), '{GRAM}')) g from documents), u as (select doc_id, len(g) n, unnest(g) x from g),
i as (select a.doc_id a, b.doc_id b, any_value(a.n) x, any_value(b.n) y, count(*) i from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2), n as (select count(*) n from g)
select round((select sum(i / (x + y - i)) from i) / (n * (n - 1) / 2), 6) score, n num_samples, (n * (n - 1) // 2)::bigint num_pairs from n""")
def apjs_direct(spark, sf_dir):
    """Over all documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.grams(F.col("text"))).alias("v"))
    return S.average_pair_jaccard(d).select(rounded(F.col("score")).alias("score"), "num_samples", "num_pairs")


@query()
def apjs_minhash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.grams(F.col("text"))).alias("v"))
    return S.minhash_pair_jaccard(d)


@query(f"""with {V}, p as (select a.id, {EUCLID} d from v a join v b on a.id <> b.id), r as (select id, d, row_number() over (partition by id order by d) k from p)
select id, round(avg(d), 6) score from r where k <= 5 group by id""")
def knn_distance(spark, sf_dir):
    return S.knn_score(vectors(spark, sf_dir).select("id", "v")).select("id", rounded(F.col("score")).alias("score"))


def _knn(metric: str, distance: str):
    def f(spark, sf_dir):
        return S.knn_score(vectors(spark, sf_dir).select("id", "v"), metric=metric).select("id", rounded(F.col("score")).alias("score"))

    f.__name__ = f"knn_{metric}"
    return query(f"""with {V}, p as (select a.id, {distance} d from v a join v b on a.id <> b.id), r as (select id, d, row_number() over (partition by id order by d) k from p)
select id, round(avg(d), 6) score from r where k <= 5 group by id""")(f)


_knn("cosine", "1 - list_cosine_similarity(a.v, b.v)")
_knn("manhattan", MANHATTAN)


_GRAMS = " union all ".join(f"select {n} n, unnest([{' || chr(31) || '.join(f't[i + {k}]' for k in range(n))} for i in range(1, len(t) - {n - 2})]) g from t" for n in (1, 2, 3, 4))


@query(f"""with t as (select doc_id, regexp_extract_all(lower(text), '{GRAM}') t from documents), g as ({_GRAMS}),
c as (select n, g, count(*) c from g group by 1, 2) select n, count(*) "distinct", sum(c)::bigint total, round(count(*) / sum(c), 6) diversity from c group by n""")
def ngram_diversity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.grams(F.col("text")).alias("tokens"))
    return S.ngram_diversity(d).select("n", "distinct", "total", rounded(F.col("diversity")).alias("diversity"))


@query(f"""with {V}, d as (select i, stddev_pop(x) sd from (select unnest(range(1, len(v) + 1)) i, unnest(v) x from v) group by 1)
select round(exp(avg(ln(case when sd > 0 then sd else 1e-10 end))), 6) radius, round(avg(sd), 6) arithmetic_mean, round(min(sd), 6) "min", round(max(sd), 6) "max", round(quantile_cont(sd, 0.5), 6) median, sum(case when sd = 0 then 1 else 0 end)::bigint zero_std_dimensions from d""")
def radius(spark, sf_dir):
    r = S.radius(vectors(spark, sf_dir))
    return r.select(*(rounded(F.col(c)).alias(c) if c != "zero_std_dimensions" else F.col(c) for c in r.columns))


@query("""with c as (select label, count(*) c from embeddings group by 1), t as (select sum(c) n, count(*) k from c)
select round(-sum(c / n * ln(c / n)), 6) entropy, round(-sum(c / n * ln(c / n)) / ln(max(k)), 6) normalized_entropy, max(k)::bigint clusters, max(n)::bigint num_samples from c, t""")
def partition_entropy(spark, sf_dir):
    e = S.partition_entropy(table(spark, sf_dir, "embeddings"), "label")
    return e.select(rounded(F.col("entropy")).alias("entropy"), rounded(F.col("normalized_entropy")).alias("normalized_entropy"), F.col("clusters").cast("long").alias("clusters"), "num_samples")


@query(f"""with {V}, e as (select id, label, unnest(range(1, len(v) + 1)) i, unnest(v) x from v), c as (select label, i, avg(x) m from e group by all)
select label, count(distinct id) size, round(sum((x - m) * (x - m)), 6) inertia from e join c using (label, i) group by label""")
def cluster_inertia(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.cluster_inertia(v, S.centroids(v)).select("label", "size", rounded(F.col("inertia")).alias("inertia"))


@query(f"""with {V}, m as (select a.id, min({EUCLID}) d from v a cross join v b where b.label = 0 group by 1)
select round(sum(d), 5) facility_location_score, round(avg(d), 6) avg_min_distance, round(max(d), 6) max_min_distance, round(quantile_cont(d, 0.5), 6) median_min_distance, round(stddev_pop(d), 6) std_min_distance,
  round((select count(*) from v where label = 0) / count(*), 6) subset_ratio from m""")
def facility_location(spark, sf_dir):
    v = vectors(spark, sf_dir)
    f = S.facility_location(v.select("id", "v"), v.where("label = 0").select("id", "v"))
    return f.select(*(rounded(F.col(c), 5 if c.startswith("fac") else 6).alias(c) for c in f.columns))


def _novel_sum_sql() -> str:
    keys = [(k, p, q) for p in (0, 0.25, 0.5) for k in (5, 10) for q in (0, 1, 2)]
    rows = ", ".join(f"('neighbor_{k}_density_{p}_distance_{q}', {k}, {p}, {q})" for k, p, q in keys)
    return f"""with {V}, u as (select v from v group by v), s as (select id, d, row_number() over (partition by id order by d) k from (select a.id, {EUCLID} * {EUCLID} d from v a cross join u b)),
n as (select id, avg(d) filter (k between 2 and 6) n5, avg(d) filter (k between 2 and 11) n10 from s group by 1),
l as (select id, v, sqrt(list_dot_product(v, v)) + 1e-10 l from v),
d as (select id, d, row_number() over (partition by id order by d) k from (select a.id, 1 - list_dot_product(a.v, b.v) / (a.l * b.l) d from l a cross join l b)),
m as (select id, q, sum(d / pow(k, q)) / sum(1 / pow(k, q)) m from d cross join (values (0), (1), (2)) g(q) group by 1, 2),
p(score_key, k, p, q) as (values {rows})
select score_key, round(avg(m.m / pow(case when p.k = 5 then n5 else n10 end + 1e-9, p.p)), 6) score from p join m on m.q = p.q join n on n.id = m.id group by score_key"""


@query(_novel_sum_sql())
def novel_sum(spark, sf_dir):
    return S.novelty_sum(vectors(spark, sf_dir).select("id", "v")).select(F.explode("scores").alias("score_key", "score")).select("score_key", rounded(F.col("score")).alias("score"))


@query(f"with {V} select count(*) num_pairs, (select count(*) * (count(*) - 1) // 2 from v)::bigint total_possible_pairs, true is_sampled, true near_the_mean from range(2000)")
def aps_sampled(spark, sf_dir):
    """2,000 of all pairs: their mean is within four of its own standard errors, about 0.01, of that of all pairs."""
    v = vectors(spark, sf_dir)
    some, every = S.average_pair_similarity(v, sample_pairs=2000), S.average_pair_similarity(v)
    return some.join(every.select(F.col("score").alias("mean"))).select("num_pairs", "total_possible_pairs", "is_sampled", (F.abs(F.col("score") - F.col("mean")) < 0.0125).alias("near_the_mean"))


@query()
def vendi(spark, sf_dir):
    return S.vendi(vectors(spark, sf_dir))


@query()
def log_det(spark, sf_dir):
    return S.log_determinant(vectors(spark, sf_dir))


@query(f"with {V} select round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) score, (select count(*) from v) num_samples from v a join v b on a.id < b.id")
def task2vec(spark, sf_dir):
    return S.task_distance(vectors(spark, sf_dir)).select(rounded(F.col("score")).alias("score"), "num_samples")


@query(f"""with {V}, p as (select a.id, b.id other, {EUCLID} d from v a join v b on a.id <> b.id)
select id query_id, arg_min(other, (d, other)) id, round(min(d), 6) distance from p group by 1""")
def nearest_example(spark, sf_dir):
    """The nearest other row, which one-shot prompts take as their example."""
    v = vectors(spark, sf_dir).select("id", "v")
    return nearest(v, v, 1).select("query_id", "id", rounded(F.col("distance")).alias("distance"))


@query()
def kmeans_clusters(spark, sf_dir):
    return S.kmeans(vectors(spark, sf_dir).select("id", "v"), 10).groupBy("cluster_label").count()


@query("""with e as (select vec_id, label, embedding[1]::double s, count(*) over (partition by label) n from embeddings), r as (select *, row_number() over (partition by label order by s desc, vec_id) k from e)
select vec_id, label, s score from r where k <= ceil(n * 30 / 100.0)""")
def cluster_top_percent(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"))
    return M.top_of_clusters(e, 30, "label", "score", "vec_id")


@query("select vec_id, round(list_avg(embedding::double[]), 6) score from embeddings")
def list_mean(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), rounded(M.list_mean(F.col("v"))).alias("score"))


@query("select d.doc_id, l.quality, l.toxic from documents d join labels l using (doc_id)")
def label_attach(spark, sf_dir):
    return M.attach_labels(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select min(doc_id) doc_id, lang from documents group by text, lang")
def first_of_each_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.concat_ws("\x1f", "text", "lang"), 256).alias("digest"))
    return M.first_of_each(d, F.col("digest"), "doc_id").select("doc_id", "lang")


@query("""with r as (select item_id, row_number() over (partition by item_id % 3 order by item_id) t from benchmark) select item_id from r order by t, item_id % 3 limit 8""")
def few_shot_balanced(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("label"))
    return M.few_shot(b, 8, "label", "item_id").select("item_id")


@query("select doc_id, coalesce(nullif(lang, 'en'), (row_number() over (order by doc_id) - 1)::varchar) id from documents")
def add_id(spark, sf_dir):
    """Documents in English count as having no id; the others' language stands for one."""
    from ..sources.records import add_ids

    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("id"))
    return add_ids(d, ["doc_id"]).select("doc_id", "id")


@query("select doc_id, lang from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def resume_anti_join(spark, sf_dir):
    return M.resume(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("select id from (select doc_id::varchar id from labels union select item_id::varchar from benchmark) order by id")
def track_merge(spark, sf_dir):
    return M.merge_tracks([table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))])


@query("""select doc_id, quality::double "Clarity", null::double "Coherence", toxic::double "Extra", 10::bigint n_keys from labels""")
def empty_keys(spark, sf_dir):
    have = F.create_map(F.lit("Clarity"), F.col("quality").cast("double"), F.lit("Extra"), F.col("toxic").cast("double"))
    m = M.with_empty_keys(have, M.Q_KEYS)
    get = lambda k: F.try_element_at(m, F.lit(k)).alias(k)
    return table(spark, sf_dir, "labels").select("doc_id", get("Clarity"), get("Coherence"), get("Extra"), F.size(m).cast("long").alias("n_keys"))


@query("""select d.doc_id, case when l.doc_id is not null then l.quality::double end q_clarity, case when l.doc_id is not null then l.toxic::double end qa_relevance, null::double qa_clarity from documents d left join labels l using (doc_id)""")
def score_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    r = d.select("doc_id", M.with_empty_keys(none, M.Q_KEYS).alias("Q_scores"), M.with_empty_keys(none, M.QA_KEYS).alias("QA_scores"))
    s = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("Clarity"), F.col("quality").cast("double"), F.lit("Relevance"), F.col("toxic").cast("double")).alias("values"))
    out = M.merge_scores(r, s, "doc_id")
    return out.select("doc_id", F.col("Q_scores")["Clarity"].alias("q_clarity"), F.col("QA_scores")["Relevance"].alias("qa_relevance"), F.col("QA_scores")["Clarity"].alias("qa_clarity"))
