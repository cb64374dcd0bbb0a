"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every document of a source gets an expected number of copies. Its whole part is certain; the rest is an
inclusion probability p. Documents rank by (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of the id,
and the sample is the prefix of that order whose words are nearest to what the source still needs. The
sample's fixed size is thus counted in words, not in documents, which keeps every source near its target.

Expected copies are unequal: c * (length_base + bits of the document's word count), at most ``max_copies``,
so that longer texts are somewhat likelier; c is exact for each source since a source has few word-count bands.

Scale: one scan of the texts gives (id, source, size). Everything per source is a pre-aggregated sum. The cut
in the order is found from a histogram of ranks for each source, then by ordering one bin only, so a source
with a third of all rows is never sorted or gathered in one task. Tables with a row per source and band are
broadcast only after their rows were counted.

Nulls and odd rows: a null text has size 0; a null source is a source of its own, last in order; a null id ranks as
the text 'null'; rows that repeat an id are taken or left together; documents of size 0 are never taken. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 20_000
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def _small(df: DataFrame, what: str) -> DataFrame:
    """Broadcast it if its counted rows are few; else leave the join to adaptive execution."""
    df = materialize(df, what)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, length_base: int, seed: str) -> DataFrame:
    size = word_count(F.col(text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("sk"), F.col("source").isNull().alias("sn"), "size", (F.length(F.bin("size")) + length_base).alias("v"), _uniform(F.col("doc_id"), seed).alias("u"))


def mix_plan(base: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> tuple[DataFrame, DataFrame]:
    """From a measured table: (sk, sn, v -> source_size, target, copies, p) and (sk, sn -> cut bin, last rank, last id)."""
    bands = materialize(base.groupBy("sk", "sn", "v").agg(F.sum("size").alias("band_size")), "mix-bands")
    sources = bands.groupBy("sk", "sn").agg(F.sum("band_size").alias("source_size"))
    order = W.orderBy("sn", "sk")  # a row per source
    k = (F.row_number().over(order) - 1) % len(weights)
    sources = sources.select("*", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double").alias("w"))
    # Water-filling: the sources that stop at their cap are a prefix in the order of cap / weight; the first level that fits is the highest.
    cap = F.col("source_size") * float(max_copies)
    filled = W.orderBy(cap / F.col("w"), "sn", "sk").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(cap / F.col("w"), "sn", "sk").rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    sources = sources.select("*", F.coalesce(F.sum(cap).over(filled), F.lit(0.0)).alias("capped"), F.sum("w").over(rest).alias("w_rest"), F.sum("source_size").over(every).alias("total"))
    level = (F.col("total") * float(share) - F.col("capped")) / F.col("w_rest")
    sources = sources.select("*", F.when(level <= cap / F.col("w"), level).alias("level"))
    sources = sources.select("*", F.max("level").over(every).alias("lam"))
    target = F.least(cap, F.coalesce(F.col("lam") * F.col("w"), cap))
    sources = sources.select("sk", "sn", "source_size", target.alias("target"))
    # The same within a source: bands of the highest intensity reach max_copies first.
    b = bands.join(_small(sources, "mix-sources"), ["sk", "sn"])
    own = W.partitionBy("sk", "sn").orderBy(F.col("v").desc())
    full = F.coalesce(F.sum("band_size").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("v") * F.col("band_size")).over(own.rowsBetween(W.currentRow, W.unboundedFollowing))
    b = b.select("*", F.when(left > 0, (F.col("target") - max_copies * full) / left).alias("c0"))
    b = b.select("*", F.max(F.when(F.col("c0") * F.col("v") <= max_copies, F.col("c0"))).over(W.partitionBy("sk", "sn")).alias("c"))
    e = F.least(F.lit(float(max_copies)), F.coalesce(F.col("c") * F.col("v"), F.lit(float(max_copies))))
    b = b.select("sk", "sn", "v", "source_size", "target", "band_size", F.floor(e).alias("copies"), (e - F.floor(e)).alias("p"))
    sure = F.sum(F.col("copies") * F.col("band_size")).over(W.partitionBy("sk", "sn"))
    rates = _small(b.select("*", (F.col("target") - sure).alias("need")), "mix-rates")
    ranked = base.join(rates.select("sk", "sn", "v", "p", "need"), ["sk", "sn", "v"]).where("size > 0 and p > 0")
    ranked = ranked.select("sk", "sn", "size", "need", _id().alias("id"), _rank().alias("q"))
    bins = ranked.groupBy("sk", "sn", "need", _bin().alias("bin")).agg(F.sum("size").alias("size"))
    upto = W.partitionBy("sk", "sn").orderBy("bin")
    bins = bins.select("sk", "sn", "need", "bin", F.sum("size").over(upto).alias("upto"), "size")
    cut = bins.where("upto > need").groupBy("sk", "sn").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("size")).alias("before")), "bin").alias("x"))
    cut = _small(cut.select("sk", "sn", "x.bin", "x.before"), "mix-cut")
    edge = ranked.withColumn("bin", _bin()).join(cut, ["sk", "sn", "bin"])
    edge = edge.groupBy("sk", "sn", "q", "id", "need", "before").agg(F.sum("size").alias("size"))
    so_far = F.col("before") + F.sum("size").over(W.partitionBy("sk", "sn").orderBy("q", "id")) - F.col("size")
    last = edge.select("sk", "sn", "q", "id", ((so_far + F.col("size") / 2) <= F.col("need")).alias("in"))
    last = last.where("in").groupBy("sk", "sn").agg(F.max(F.struct("q", "id")).alias("last"))
    cut = _small(cut.join(last, ["sk", "sn"], "left").select("sk", "sn", F.col("bin").alias("cut_bin"), "last"), "mix-last")
    return rates, cut


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _rank() -> Column:
    return (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))


def _bin(q: str = "q") -> Column:
    return F.floor(F.col(q) / (1 + F.col(q)) * BINS)


def apply_mix(base: DataFrame, rates: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds source_size, target and times (copies that the mix takes) to every row; a map where the tables are broadcast."""
    out = base.join(rates.drop("need", "band_size"), ["sk", "sn", "v"]).join(cut, ["sk", "sn"], "left")
    q, id_ = _rank(), _id()
    drawn = F.col("cut_bin").isNull() | (F.floor(q / (1 + q) * BINS) < F.col("cut_bin")) | ((F.floor(q / (1 + q) * BINS) == F.col("cut_bin")) & F.coalesce(F.struct(q.alias("q"), id_.alias("id")) <= F.col("last"), F.lit(False)))
    times = F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("p") > 0, drawn.cast("long")).otherwise(0)).otherwise(0)
    return out.withColumn("times", times.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, length_base: int = 8, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken = size * times."""
    base = materialize(measured(docs, id_col, text_col, source_col, length_base, seed), "mix-base")
    out = apply_mix(base, *mix_plan(base, weights, share, max_copies))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, length_base: int = 8, seed: str = "mix:") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    base = materialize(measured(docs, "doc_id", "text", "source", length_base, seed), "mix-base")
    rates, cut = mix_plan(base, weights, share, max_copies)
    whole = docs.select(F.struct(*docs.columns).alias("doc")).select("doc", F.col("doc.doc_id"), F.coalesce("doc.source", F.lit("")).alias("sk"), F.col("doc.source").isNull().alias("sn"), word_count(F.col("doc.text")).alias("size"))
    whole = whole.select("*", (F.length(F.bin("size")) + length_base).alias("v"), _uniform(F.col("doc_id"), seed).alias("u"))
    taken = apply_mix(whole, rates, cut).where("times > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
