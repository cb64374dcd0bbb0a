"""Query op3_substring_dedup and its SQL."""

from .substring import substring_dedup


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) k from g) where k > 1),
c as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) p from r)),
m as (select doc_id, count(*) n, list(p) ps from c group by 1)
select w.doc_id, len(w)::bigint n_words, coalesce(m.n, 0)::bigint n_removed,
  sha256(array_to_string(case when m.ps is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(m.ps, z[2])), lambda z: z[1]) end, ' ')) kept_sha256
from w left join m using (doc_id)
"""
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES = {"op3_substring_dedup": SQL}
