"""Query op1_pareto_mixing and its SQL."""

from .mixing import mix


def op1_pareto_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with base as (
  select doc_id, coalesce(source, '') sk, source is null sn, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    (cast('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0 u,
    coalesce(doc_id, -9223372036854775808) id
  from documents),
b1 as (select *, length(bin(size)) + 8 v from base),
bands as (select sk, sn, v, sum(size)::bigint bs from b1 group by all),
s1 as (select sk, sn, sum(bs)::bigint ss from bands group by all),
s2 as (select *, [3.0, 1.0, 2.0][((row_number() over (order by sn, sk) - 1) % 3 + 1)::int]::double w, ss * 2.0::double cap from s1),
s3 as (select *, coalesce(sum(cap) over (order by cap / w, sn, sk rows between unbounded preceding and 1 preceding), 0.0::double) capped,
  sum(w) over (order by cap / w, sn, sk rows between current row and unbounded following) wr, sum(ss) over ()::double total from s2),
s4 as (select *, case when (total * 1.5::double - capped) / wr <= cap / w then (total * 1.5::double - capped) / wr end lv from s3),
s5 as (select sk, sn, ss, least(cap, coalesce(max(lv) over () * w, cap))::double target from s4),
c1 as (select b.*, s.ss, s.target,
  coalesce(sum(bs) over (partition by sk, sn order by v desc rows between unbounded preceding and 1 preceding), 0)::bigint fb,
  (sum(v * bs) over (partition by sk, sn order by v desc rows between current row and unbounded following))::bigint lf
  from bands b join s5 s using (sk, sn)),
c2 as (select *, case when lf > 0 then (target - (2 * fb)::double) / lf::double end c0 from c1),
c3 as (select *, max(case when c0 * v <= 2 then c0 end) over (partition by sk, sn) c from c2),
c4 as (select *, least(2.0::double, coalesce(c * v, 2.0::double)) e from c3),
c5 as (select sk, sn, v, ss, target, floor(e)::bigint copies, e - floor(e) p, target - (sum(floor(e)::bigint * bs) over (partition by sk, sn))::double need from c4),
r as (select b.*, ss, target, copies, p, need, case when size > 0 and p > 0 then (u / (1 - u)) / (p / (1 - p)) end q from b1 b join c5 using (sk, sn, v)),
k as (select sk, sn, q, id, need, sum(size)::bigint size from r where q is not null group by all),
k2 as (select sk, sn, q, id, ((sum(size) over (partition by sk, sn order by q, id))::double - size + size / 2.0::double) <= need drawn from k)
select doc_id, size, ss source_size, target,
  (size * (case when size > 0 then copies + case when k2.drawn then 1 else 0 end else 0 end))::bigint taken
from r left join k2 on r.sk = k2.sk and r.sn = k2.sn and r.q = k2.q and r.id = k2.id
"""
QUERIES = {"op1_pareto_mixing": op1_pareto_mixing}
ORACLES = {"op1_pareto_mixing": SQL}
