"""Query op6_url_filter and its SQL."""

from .common import arrow_map
from .url_filter import HOST_RULES, PATTERN_RULES, UrlFilter

SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def _rows(host_rules, pattern_rules):
    judge = UrlFilter(host_rules, pattern_rules).judge
    return lambda rows: [(page_id, *judge(url)[:4]) for page_id, url in rows]


def url_filter(pages, host_rules=None, pattern_rules=None):
    """One row per page; only page_id and url are read. Null urls and urls without ``://`` have an empty host and path; pattern rules still see the latter."""
    return arrow_map(pages.select("page_id", "url"), SCHEMA, _rows, host_rules or HOST_RULES, pattern_rules or PATTERN_RULES, slice_rows=4096)


def op6_url_filter(spark, sf_dir):
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in HOST_RULES)
    hit = lambda a: " or ".join(f"regexp_matches(low, '{p}')" for x, p in PATTERN_RULES if x == a)
    return f"""
with u as (select page_id, url, {_lower("coalesce(url, '')")} low,
    case when url is null or strpos(url, '://') = 0 then '' else regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') end rest from pages),
p as (select page_id, low, {_lower("regexp_extract(rest, '^[^/]*')")} host, case when strpos(rest, '/') = 0 then '' else substr(rest, strpos(rest, '/')) end path from u),
r(rh, rp, action) as (values {rules}),
m as (select page_id, arg_max(rh || rp, length(rh || rp)) rule, arg_max(action, length(rh || rp)) action
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select p.page_id, host, path, rule, case when rule is not null then action when ({hit("block")}) and not ({hit("allow")}) then 'block' else 'allow' end verdict
from p left join m using (page_id)
"""


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": _sql()}
