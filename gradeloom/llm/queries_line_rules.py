"""Query op10_line_rules and its SQL."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .line_rules import BARS, CAPITAL, CODE, ENDS, LEAST_PLACES, LETTERS, MARKED, MENU, MOST_LINES, NOTICE, SENTENCE, judge, line_hash, line_places, widespread

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words")
SCHEMA = "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept_words long, line array<long>, place array<long>, words array<int>"


def _rows(args):
    number = TaskContext.get().partitionId() << 33

    def each(rows):
        nonlocal number
        out = []
        for doc_id, text in rows:
            x = judge(text, **args)
            places = line_places((text or "").encode("utf-8", "surrogatepass"))
            words = dict.fromkeys(places, 0)  # of the lines that are left by their own form
            for line, k in x["kept_lines"]:
                words[line_hash(line.strip())] += k
            out.append((number, doc_id, *(x[f] for f in FIELDS), list(places), list(places.values()), list(words.values())))
            number += 1
        return out

    return each


def line_rules(docs, least_places=LEAST_PLACES, least_kept=0.5, **args):
    """One row per row of ``docs``."""
    judged = materialize(arrow_map(docs.select("doc_id", "text"), SCHEMA, _rows, args), "line-judged")
    lines = materialize(widespread(judged, least_places), "line-widespread")  # Spark broadcasts it if it is small
    each = judged.select("row", F.explode(F.arrays_zip("line", "words")).alias("z")).select("row", "z.line", "z.words").where("words > 0")
    lost = each.join(lines, "line").groupBy("row").agg(F.sum("words").alias("lost"))
    left = F.col("kept_words") - F.coalesce("lost", F.lit(0))
    kept = ~F.col("base_failed") & (F.col("left") >= F.lit(float(least_kept)) * F.col("n_words"))
    out = judged.join(lost, "row", "left").withColumn("left", left)
    return out.select("doc_id", *FIELDS[:-1], kept.alias("kept"), F.col("left").alias("kept_words"))


def op10_line_rules(spark, sf_dir):
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_WORDS = r"[^\x20\x09-\x0D]+"
SQL = rf"""
with w as (select row_number() over () rid, doc_id, coalesce(text, '') text, coalesce(regexp_extract_all(text, '{_WORDS}'), []) w from documents),
g as (select rid, i, list_slice(w, i, i + 7)::varchar g from (select rid, w, unnest(range(1, len(w) - 6)) i from w)),
h as (select rid, i from (select *, count(*) over (partition by rid, g) c from g) where c > 1),
r as (select rid, count(distinct p)::bigint n from (select rid, unnest(range(i, i + 8)) p from h) group by 1),
l as (select rid, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from w),
m as (select rid, i, line, {_STRIP.format("line")} bare, len(regexp_extract_all(line, '{_WORDS}')) k from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
d as (select rid, sum(c - 1)::bigint n from (select rid, line, count(*) c from m group by all) group by 1),
a as (select *, lag(bare) over o before, lead(bare) over o after, row_number() over (partition by rid, bare order by i) nth from m window o as (partition by rid order by i)),
p as (select bare, count(distinct (before, after)) places, count(*) texts from (select bare, coalesce(before, '') before, coalesce(after, '') after from a where nth = 1) group by 1),
f as (select bare from p where places >= greatest({LEAST_PLACES}, (select ceil(sum(texts) / {MOST_LINES}) from p)) and 2 * places >= texts),
t as (select rid, k, line, bare, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low, list_filter(regexp_extract_all(bare, {_Q(LETTERS)}), lambda x: length(x) > 3) long from m),
j as (select rid, k, 3 * len(regexp_extract_all(bare, {_Q(BARS)})) >= k or regexp_matches(low, {_Q(MENU)}) or bare in (select bare from f)
  or (regexp_matches(low, {_Q(NOTICE)}) and 2 * coalesce(list_sum(list_transform(list_filter(regexp_extract_all(low, {_Q(SENTENCE)}), lambda x: regexp_matches(x, {_Q(NOTICE)})), lambda x: length(x))), 0) >= length(low))
  or (k >= 5 and not contains({_Q(ENDS)}, right(bare, 1)) and not (regexp_matches(bare, {_Q(MARKED)}) or regexp_matches(line, {_Q(CODE)})
    or (len(long) > 0 and len(list_filter(long, lambda x: regexp_matches(x, {_Q(CAPITAL)}))) = len(long)))) fails from t),
s as (select rid, coalesce(sum(k) filter (not fails), 0)::bigint n from j group by 1),
b as (select w.rid, doc_id, len(w)::bigint n_words, list_sum([length(x) for x in w] || [0])::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, coalesce(d.n, 0) n_dup_lines,
  coalesce(r.n, 0) n_repeat_words, coalesce(s.n, 0) kept_words from w left join r using (rid) left join d using (rid) left join s using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 2 * kept_words >= n_words kept, kept_words from b
"""
QUERIES = {"op10_line_rules": op10_line_rules}
ORACLES = {"op10_line_rules": SQL}
