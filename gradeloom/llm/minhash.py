"""Near-duplicates by MinHash with tensored banding.

A text's shingles are runs of five words, A-Z lower-cased. Two small collections of ``halves`` half keys each are
made of ``width`` minimum hashes; table (i, j) is keyed by the i-th half key of the first and the j-th of the second. So
halves ** 2 tables, whose keys have 2 * width hashes, need only 2 * halves * width minimum hashes. A pair of similarity s meets in
a table with probability (1 - (1 - s ** width) ** halves) ** 2: with 7 and 2, 0.99975 at 0.85 and 0.99998 at 0.9.

1. Texts with equal shingle sets form a class (a 128-bit digest of the set, pre-aggregated); only its smallest id goes on.
2. Candidates come from the tables by minimum hashes alone. A table of up to ``ALL_PAIRS`` texts gives its pairs. In a larger one all texts are compared with a hub,
   its smallest id. With ``NEAR`` or more of 48 equal minima a text is tied to the hub; with ``DONE`` or more it leaves the table: what is linked with it
   shares 0.85 of those minima, and so is tied to the hub too, but for a chance of 0.0001 in each table where both stand. The rest of the table, texts that
   share its key but little else with the hub, are compared with each other by their minima, block by block; only a spanning forest of the
   pairs with ``AGREE`` or more equal minima, and each text's best partner, come out. No group gives all its pairs, and unlike texts aren't tied together.
3. Candidate pairs with ``AGREE`` or more equal minima (at 0.85 fewer are with probability below 1e-6) are compared on full sets: a hub against its texts, in blocks.
4. Where texts are tied together but not all linked so far, those outside the largest linked part are compared with all the
   others on full sets, block by block, by a matrix product over the shingles that two texts share.
5. The components of the confirmed links are the result.

No task gathers a group of unbounded size. A link can be missed only as far as minimum hashes mislead, with the probabilities above; what is
confirmed is right as far as shingles, compared as 64-bit hashes, and sets, compared as 128-bit digests, don't collide. Rows that repeat an id count as one document
with several texts. Null ids take the component of their set's other rows, if any. Null and empty texts are linked with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, discard, kept_in_worker, materialize
from .shingles import WordHashes, shingle_set

HALVES, WIDTH, SIGNS = 7, 2, 48
NEAR, AGREE, DONE = 19, 26, 32
#: Ids of texts to be compared up to which they are broadcast: 64 MB.
BROADCAST_IDS = 1 << 22
ALL_PAIRS, BLOCK_TEXTS, BLOCK_SHINGLES, BLOCK_SIGNS = 8, 1024, 1 << 20, 2048


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; parted at \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash a * x + b, its upper 32 bits; in steps, so that very long texts need little memory."""
    low = np.full(len(a), np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, (a[:, None] * shingles[None, k : k + 4096] + b[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def _sketches(size: int):
    hashes = kept_in_worker("words", WordHashes)
    a, b = hash_family(SIGNS)

    def each(rows):
        out = []
        for doc_id, text in rows:
            x = shingle_set(words_of(text), hashes, size)
            out.append((doc_id, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), signature(x, a, b) if len(x) else None))
        return out

    return each


def _sets(size: int):
    hashes = kept_in_worker("words", WordHashes)
    return lambda rows: [(node, cells, shingle_set(words_of(text), hashes, size).view(np.int64)) for node, cells, text in rows]


def confirmed(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Booleans for left x right: 100 * intersection >= percent * union, over whole sets."""
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), lens)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    use = shared[inverse]
    owner, column = owner[use], column[use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for k in range(0, int(shared.sum()), 4096):
        i, e = np.searchsorted(column, [k, k + 4096])
        o, c = owner[i:e], column[i:e] - k
        a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        m = at_left[o] >= 0
        a[at_left[o[m]], c[m]] = 1
        m = at_right[o] >= 0
        b[at_right[o[m]], c[m]] = 1
        both += a @ b.T
    inter = both.astype(np.int64)
    union = lens[left][:, None] + lens[right][None, :] - inter
    return 100 * inter >= percent * union


def forest(n: int, left: np.ndarray, right: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    label = np.arange(n)
    i, k = np.nonzero(links)
    i, k = left[i], right[k]
    while True:
        low = np.minimum(label[i], label[k])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, k, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(percent: int):
    """One cell: the links between its left and its right texts, as a spanning forest."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        node, is_left, is_right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "is_left", "is_right"))
        lists = t.column("shingles").combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
        at = np.empty(0, np.int64)
        if len(left) and len(right):
            label = forest(len(node), left, right, confirmed(sets, left, right, percent))
            at = np.flatnonzero(node[label] != node)
        return pa.table({"a": pa.array(node[label[at]] if len(at) else at, pa.int64()), "b": pa.array(node[at], pa.int64())})

    return run


CELL = "array<struct<comp:long,i:int,k:int,is_left:boolean,is_right:boolean>>"


def _cell(comp, i, k, left: bool, right: bool):
    return F.struct(F.col(comp).alias("comp"), i.cast("int").alias("i"), k.cast("int").alias("k"), F.lit(left).alias("is_left"), F.lit(right).alias("is_right"))


def _confirmed(text: DataFrame, cells: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between left and right texts of each cell. cells: (node, cell), a row for each cell of a node."""
    # A node twice in a cell is one row there.
    one = cells.select("node", "cell.*").groupBy("node", "comp", "i", "k").agg(F.max("is_left").alias("is_left"), F.max("is_right").alias("is_right"))
    own = materialize(one.groupBy("node").agg(F.collect_list(F.struct("comp", "i", "k", "is_left", "is_right")).alias("cells")), "near-cells")
    if own.count() <= BROADCAST_IDS:  # else all texts travel
        text = text.join(F.broadcast(own.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    found = text.join(own, text.doc_id == own.node).select("node", "cells", "text")
    found = arrow_map(found, f"node long, cells {CELL}, shingles array<long>", _sets, size)
    found = found.select("node", F.explode("cells").alias("cell"), "shingles").select("node", "cell.*", "shingles")
    return found.groupBy("comp", "i", "k").applyInArrow(_compare(percent), "a long, b long")


def _blocks(n: str, shingles: str):
    """How many blocks hold texts of such a count and sum of set sizes."""
    return F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _agreeing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """(a, b, agree): equal minima of distinct pairs."""
    side = lambda c: signs.select(F.col("node").alias(c), F.col("signs").alias(f"s{c}"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", agree.alias("agree"))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal minima of all rows of x with all rows of y, by 16 bits of each: two others pass for equal once in 65,536."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(x.astype(np.uint16).T, y.astype(np.uint16).T, strict=True):
        out += a[:, None] == b[None, :]
    return out


def _like(t: pa.Table) -> pa.Table:
    """One cell of a table's rest: a forest of the pairs that agree, and best partners."""
    t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
    node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
    signs = t.column("signs").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    low, high = (t.column(c)[0].as_py() for c in ("low", "high"))
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    a = b = np.empty(0, np.int64)
    if len(left) and len(right):
        same = agreement(signs[left], signs[right])
        same[left[:, None] == right[None, :]] = 0
        label = forest(len(node), left, right, same >= AGREE)
        at = np.flatnonzero(node[label] != node)
        best = same.argmax(1)
        fine = same[np.arange(len(left)), best] >= AGREE
        a, b = np.append(node[label[at]], node[left[fine]]), np.append(node[at], node[right[best[fine]]])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def candidates(hits: DataFrame, signs: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """(a, b, agree) of pairs that tables tie together. hits: (key, node, n), n texts in a table, at least two. ``held`` gets the tables that it is read from."""
    few = hits.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("v")).select("v").distinct()
    pairs = few.select(F.explode(F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, ALL_PAIRS), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    few = _agreeing(pairs.select("p.a", "p.b"), signs).where(F.col("agree") >= AGREE)

    many = hits.where(F.col("n") > ALL_PAIRS).select("key", "node")
    met = many.join(many.groupBy("key").agg(F.min("node").alias("hub")), "key").where("node <> hub")
    told = materialize(_agreeing(met.select(F.col("hub").alias("a"), F.col("node").alias("b")), signs), "near-hubs")
    gone = told.where(F.col("agree") >= DONE).select(F.col("a").alias("hub"), F.col("b").alias("node"))
    rest = materialize(met.join(gone, ["hub", "node"], "left_anti").select("key", "node"), "near-rest")
    if held is not None:
        held += [told, rest]

    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SIGNS).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    cells = rest.join(blocks, "key").join(signs, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.select("key", "node", "signs", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "node", "signs", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    like = cells.groupBy("key", "low", "high").applyInArrow(_like, "a long, b long").distinct()
    return few.union(told.where(F.col("agree") >= NEAR)).union(like.withColumn("agree", F.lit(AGREE)))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialize(arrow_map(text, "doc_id long, n_shingles long, digest binary, signs array<int>", _sketches, size), "near-sketches")
    reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signs").alias("signs"), F.first("n_shingles").alias("size"))
    reps = materialize(reps, "near-classes")

    s = F.col("signs")
    half = lambda side, i: F.xxhash64(F.lit(side * HALVES + i), *(s[(side * HALVES + i) * WIDTH + k] for k in range(WIDTH)))
    first, second = (F.array(*(half(side, i) for i in range(HALVES))) for side in (0, 1))
    keys = reps.select("node", first.alias("x"), second.alias("y"))
    keys = keys.select("node", F.explode(F.flatten(F.transform("x", lambda x: F.transform("y", lambda y: F.xxhash64(x, y))))).alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = materialize(keys.join(met, "key").distinct(), "near-hits")
    sizes = reps.groupBy("node").agg(F.sum("size").alias("size"))  # an id may stand on several sets
    held: list[DataFrame] = [hits]
    pairs = materialize(candidates(hits, reps.select("node", "signs"), held), "near-candidates")
    discard(*held)

    # Hubs against their texts. Of a pair the smaller id is the hub, whatever it was before.
    tried = pairs.where(F.col("agree") >= AGREE).select("a", "b").distinct()
    degree = tried.join(sizes, tried.b == sizes.node).groupBy("a").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select("a", _blocks("n", "s").alias("blocks"))
    members = tried.join(degree, "a").select(F.col("b").alias("node"), _cell("a", F.lit(0), F.pmod(F.xxhash64("b"), "blocks"), False, True).alias("cell"))
    hubs = degree.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("node", _cell("a", F.lit(0), F.col("k"), True, False).alias("cell"))
    parts = materialize(components(materialize(_confirmed(text, members.union(hubs), percent, size), "near-links"), "near-parts"), "near-part")

    # Ties between parts. From here on a part stands for its texts.
    of = lambda c: parts.select(F.col("node").alias(c), F.col("comp").alias(f"part_{c}"))
    ties = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    ties = materialize(ties.where("a <> b").distinct(), "near-ties")
    comps = parts
    if not ties.isEmpty():
        tied = components(ties, "near-tied").withColumnRenamed("node", "part")
        within = sizes.join(parts, "node", "left").select("node", "size", F.coalesce(parts["comp"], "node").alias("part"))
        within = materialize(within.join(tied, "part"), "near-within")  # node, size, part, comp
        each = within.groupBy("comp", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        main = each.groupBy("comp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        outside = each.join(main.select("comp", "main"), "comp").where("part <> main").groupBy("comp").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        shape = main.select("comp", "main", _blocks("n", "s").alias("all_blocks")).join(outside.select("comp", _blocks("n", "s").alias("out_blocks")), "comp")
        placed = within.join(shape, "comp")
        block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
        left = placed.where("part <> main").select("node", "comp", block("out_blocks", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("k"))
        right = placed.select("node", "comp", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), block("all_blocks", 2).alias("k"))
        cells = left.select("node", _cell("comp", F.col("i"), F.col("k"), True, False).alias("cell")).union(right.select("node", _cell("comp", F.col("i"), F.col("k"), False, True).alias("cell")))
        more = _confirmed(text, cells, percent, size)
        more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")).where("a <> b")
        whole = components(materialize(more, "near-more"), "near-whole")
        grown = parts.join(whole.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        alone = whole.join(parts.select("node"), "node", "left_anti").select("node", "comp")
        comps = materialize(grown.union(alone), "near-comps")

    classes = reps.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("of_class"))
    out = rows.join(classes, "digest", "left")
    mine = F.when(F.col("n_shingles") > 0, F.coalesce("of_class", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
