"""Query op2_dual_tree_top_k and its SQL."""

from .top_k import top_k


def op2_dual_tree_top_k(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
QUERIES = {"op2_dual_tree_top_k": op2_dual_tree_top_k}
ORACLES = {"op2_dual_tree_top_k": SQL}
