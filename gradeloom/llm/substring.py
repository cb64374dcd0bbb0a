"""Substring dedup with a count-min prefilter.

A window is 20 consecutive words. A word is removed if some window covers it whose words also start earlier (smaller
doc_id, or same document and earlier start); windows are judged on the input.

Texts are packed once into units of some megabytes, which bound every later task; the units are a table in the shared folder.

Pass 1 counts. A window's anchor is the run of ten words in it with the least hash. Equal windows have equal anchors, at different places
of the corpus, so a window stands no oftener than its anchor; and neighbours share anchors, so that there are six times fewer of
them. Each unit is a partition sketch: its distinct anchors, as cells of a count-min sketch of two rows with their counts.
Cells are dealt to shards by the anchor's hash. A task per shard adds the units' counts and answers each unit in bits: which of its anchors
are estimated to stand twice or more. A shard has ``cells_per_anchor`` cells a row for each anchor at any size of the corpus, as there are
as many shards as it takes; nothing is broadcast. An estimate is never too low, so no repeated window is lost.

Pass 2 groups exactly. Each unit takes its answers and sends the windows whose anchor is estimated repeated; of a window that stands in it
more than once only the first place, as the others are known to be repeats. Windows are dealt to buckets by their anchors, so that
a text's repeats come back as a few rows however many buckets there are, but by their own hashes where the merged sketch says that
an anchor is very frequent (at least ``hot`` places; the bound rises with the corpus so that there are at most 2 ** 22 such cells, 32 MB). A bucket
compares 96-bit hashes; windows that don't hold the first place of theirs are repeats and go back to their unit.

Pass 3 joins each unit with its repeats and cuts the covered words.

Two windows count as equal if their 96-bit hashes are: among 1e13 windows two others agree with probability below 0.001. Null texts have no words. Rows with a null doc_id keep all their words and take none from
others. Rows that repeat a doc_id are ordered by a hash of their texts; rows equal in both are one document and don't count as earlier than each other.
An empty table gives no rows; columns of ``docs`` may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, forget, kept_in_worker, materialize, small_batches, trim
from .shingles import WordHashes, joined, runs

WIDTH = 20
UNIT_BYTES = 6 << 20
SHARD_BITS, LEAST_SHARDS = 22, 64
HOT_LIST = 1 << 22
NEVER = np.uint64(2**64 - 1)


def words_of(raw: bytes) -> list[bytes]:
    """Unchanged words, parted at \\x20 and \\x09-\\x0D."""
    return raw.split()


def slid(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over all runs of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


class Unit:
    """The words of some documents in a row. ``starts[i]``: a window of one document starts at word i. ``h``: hashes of runs; ``low``: the least in each window."""

    def __init__(self, words: list[bytes], counts: np.ndarray, hashes: WordHashes, width: int):
        self._set(*hashes.of(words), counts, width)

    @classmethod
    def hashed(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, width: int) -> Unit:
        """Of the halves of the words' hashes."""
        u = cls.__new__(cls)
        u._set(a, b, counts, width)
        return u

    def _set(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, width: int) -> None:
        self.width, self.size = width, max(1, width // 2)
        self.span = width - self.size + 1
        self.n = max(0, len(a) - width + 1)
        self.a, self.b = a, b
        ends = np.repeat(np.cumsum(counts), counts)[: self.n]
        self.starts = np.arange(self.n) + width <= ends
        self.h = runs(self.a, self.size)
        self.low = slid(self.h, self.span, np.minimum) if self.n else np.empty(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Word numbers where a run stands that is the least of some window; every one, if equal ones stand in it."""
        if not self.starts.any():
            return np.empty(0, np.int64)
        edge = np.zeros(self.span - 1, np.uint64)
        most = slid(np.concatenate([edge, np.where(self.starts, self.low, np.uint64(0)), edge]), self.span, np.maximum)
        return np.flatnonzero((most == self.h) & (self.h > 0))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor stands at one of the places ``at``."""
        if not len(at):
            return at
        h = np.full(len(self.h), NEVER)
        h[at] = self.h[at]
        return np.flatnonzero((slid(h, self.span, np.minimum) == self.low) & self.starts)

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return runs(self.a, self.width)[at], (runs(self.b, self.width)[at] >> np.uint64(32)).astype(np.uint32)


def cells(h: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """shard << bits | cell in the first row, as one number; and the cell in the second."""
    x, y = joined(h, h), joined(h, ~h)
    shard = ((x >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    mask = np.uint64((1 << bits) - 1)
    return shard << np.uint64(bits) | (x & mask), (y & mask).astype(np.uint32)


def coded(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their gaps, a byte each; 255 stands for 255 more to come."""
    gaps = np.diff(numbers.astype(np.int64), prepend=0)
    more, last = np.divmod(gaps, 255)
    if more.sum() > 2 * len(gaps):  # far apart: four bytes each
        return b"\1" + numbers.astype("<u4").tobytes()
    out = np.full(int(more.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    z = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return b"\0" + z.compress(out.tobytes()) + z.flush()


def decoded(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    gaps = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def distinct(h: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, ...]:
    """The distinct hashes in the order of their cells: first cells, second cells, counts, and for each of ``h`` its number among them."""
    found, number, counts = np.unique(h, return_inverse=True, return_counts=True)
    first, second = cells(found, shards, bits)
    order = np.lexsort((second, first))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], second[order], counts[order], place[number]


# Packing


def _packed():
    """Map: (doc, of, rest, text) to units, a row each. A unit's number is the task's and its own, so it is the same if the task runs again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        z = zstandard.ZstdCompressor(level=3)
        number, raws, kept, size = TaskContext.get().partitionId() << 32, [], [], 0

        def unit() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            ends = pa.array([0, t.num_rows], pa.int32())
            doc, of, rest = (pa.ListArray.from_arrays(ends, t.column(c).combine_chunks()) for c in ("doc", "of", "rest"))
            sizes = pa.ListArray.from_arrays(ends, pa.array(list(map(len, raws)), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), doc, of, rest, sizes, pa.array([z.compress(b"".join(raws))], pa.binary())], names=["unit", "doc", "of", "rest", "size", "packed"])

        for batch in batches:
            done = 0
            for i, text in enumerate(batch.column(3).to_pylist()):
                raws.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(raws[-1])
                if size >= UNIT_BYTES or len(raws) >= 1 << 16:
                    kept.append(batch.slice(done, i + 1 - done).select(["doc", "of", "rest"]))
                    yield unit()
                    number, raws, kept, size, done = number + 1, [], [], 0, i + 1
            if done < batch.num_rows:
                kept.append(batch.slice(done).select(["doc", "of", "rest"]))
        if raws:
            yield unit()

    return run


def _raws(packed: bytes, sizes: list[int]) -> Iterator[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum([0, *sizes]).tolist()
    return (whole[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _each(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of batches, one in Python at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


def _unit(packed: bytes, sizes: list[int], doc: list[int | None], width: int, whole: bool = True) -> tuple[Unit, np.ndarray]:
    """The words of a unit, those of rows without an id left out; and the rows' word counts. A text's words are hashed and go before the next text's come.

    Without ``whole`` only the hashes' first halves are kept: enough for anchors, not for ``hashes``.
    """
    hashes = kept_in_worker("words", WordHashes)
    halves = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    counts = np.zeros(len(sizes), np.int64)
    for i, (raw, d) in enumerate(zip(_raws(packed, sizes), doc, strict=True)):
        if d is not None:
            words = words_of(raw)
            counts[i] = len(words)
            a, b = hashes.of(words)
            halves[0].append(a)
            if whole:
                halves[1].append(b)
    a = np.concatenate(halves[0])
    halves[0].clear()
    return Unit.hashed(a, np.concatenate(halves[1]), counts, width), counts


# Pass 1

SEEN = "shard int, unit long, first binary, second binary, often binary"


def _counted(shards: int, bits: int, width: int):
    """Map: units to their partition sketches, a row for each shard."""

    def sketch(number: int, doc: list, sizes: list, packed: bytes) -> pa.RecordBatch | None:
        u, _ = _unit(packed, sizes, doc, width, whole=False)
        first, second, counts, _ = distinct(u.h[u.anchors()], shards, bits)
        shard = (first >> np.uint64(bits)).astype(np.int32)
        if not len(shard):
            return None
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        first = first & np.uint64((1 << bits) - 1)
        three = np.ascontiguousarray(second.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
        often = np.minimum(counts, 255).astype(np.uint8)
        rows = [(int(shard[i]), number, coded(first[i:e]), three[i:e].tobytes(), zlib.compress(often[i:e].tobytes(), 1)) for i, e in zip(cut.tolist(), np.append(cut[1:], len(shard)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "unit", "first", "second", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches, "unit", "doc", "size", "packed"):
            if (found := sketch(*row)) is not None:  # all else of a unit is gone before the next
                yield found
                trim()

    return run


ANSWERS = "unit long, shard int, twice binary, hot array<long>"


def _merged(bits: int, hot: int):
    """One shard: adds all units' counts, then answers each unit. A row with a null unit lists very frequent first cells."""

    def run(t: pa.Table) -> pa.Table:
        shard, parts = t.column("shard")[0].as_py(), []
        total = [np.zeros(1 << bits, np.int64) for _ in range(2)]
        for first, second, often in zip(*(t.column(c).to_pylist() for c in ("first", "second", "often")), strict=True):
            x = decoded(first)
            y = np.frombuffer(second, np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
            w = np.frombuffer(zlib.decompress(often), np.uint8).astype(np.int64)
            w[w == 255] = max(hot, 255)  # as many in one unit: very frequent at once
            parts.append((x, y))
            for row, c in zip(total, (x, y), strict=True):
                np.add.at(row, c, w)
        # Cells hold sums of distinct anchors of one unit, of several units, or both: twice is twice.
        bits_of = [np.packbits((total[0][x] > 1) & (total[1][y] > 1)).tobytes() for x, y in parts]
        frequent = np.flatnonzero(total[0] >= hot) + (shard << bits)
        rows = [*zip(t.column("unit").to_pylist(), [shard] * len(parts), bits_of, [None] * len(parts), strict=True), *([(None, shard, None, frequent)] if len(frequent) else [])]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["unit", "shard", "twice", "hot"])

    return run


# Pass 2

SUSPECTED = "bucket int, unit long, a array<long>, b array<int>, doc array<long>, of array<long>, at array<int>, length array<int>"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def ordered(a, b, doc, of, at) -> tuple[np.ndarray, np.ndarray]:
    """An order by window, then place; and which of the ordered aren't at the first place of their window."""
    order = np.lexsort((at, of, doc, b, a))
    a, b, doc, of, at = (x[order] for x in (a, b, doc, of, at))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc != doc[first]) | (of != of[first]) | (at != at[first])


def as_runs(at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the places that start a run of consecutive ones under equal keys, and the runs' lengths."""
    new = np.append(True, at[1:] != at[:-1] + 1)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    i = np.flatnonzero(new) if len(at) else np.empty(0, np.int64)
    return i, np.diff(np.append(i, len(at)))


def _suspected(shards: int, bits: int, width: int, buckets: int, hot):
    """Map: units with their answers to windows that may be repeated, as arrays for a bucket. Known repeats are runs with a length and without hashes."""

    def batch_of(which, unit, sizes, *columns) -> pa.RecordBatch:
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        none = pa.array(np.zeros(len(which) + 1), pa.int32())
        lists = [pa.ListArray.from_arrays(none if x is None else ends, pa.array([] if x is None else x, t)) for x, t in zip(columns, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([unit] * len(which), pa.int64()), *lists], names=[x.split()[0] for x in SUSPECTED.split(", ")])

    def windows_of(often: np.ndarray, number: int, docs: list, ofs: list, sizes: list, packed: bytes, answers: list | None) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        u, counts = _unit(packed, sizes, docs, width)
        places = u.anchors()
        first, _, _, item = distinct(u.h[places], shards, bits)
        n = np.bincount((first >> np.uint64(bits)).astype(np.int64), minlength=shards)
        said = {x["shard"]: x["twice"] for x in answers}
        twice = np.concatenate([np.unpackbits(np.frombuffer(said[s], np.uint8), count=n[s]) for s in np.flatnonzero(n).tolist()]) if len(first) else np.empty(0, bool)
        start = u.windows(places[twice[item].astype(bool)])
        if not len(start):
            return
        # The anchor's first cell decides on the bucket; a window's own hash does where that cell is very frequent.
        cell = cells(u.low[start], shards, bits)[0]
        a, b = u.hashes(start)
        own = np.isin(cell, often) if len(often) else np.zeros(len(cell), bool)
        bucket = (joined(np.where(own, a, cell), np.uint64(7) + own.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        of_row = np.repeat(np.arange(len(counts)), counts)[start]
        doc, of = np.array([d or 0 for d in docs], np.int64)[of_row], np.array(ofs, np.int64)[of_row]
        at = (start - (np.cumsum(counts) - counts)[of_row]).astype(np.int32)
        order, repeat = ordered(a, b, doc, of, at)
        known = order[repeat]
        known = known[np.lexsort((at[known], of[known], doc[known]))]
        if len(known):
            i, length = as_runs(at[known], doc[known], of[known])
            yield batch_of([int(joined(np.array([number], np.uint64), np.uint64(9))[0]) % buckets], number, [len(i)], None, None, doc[known][i], of[known][i], at[known][i], length)
        left = np.sort(order[~repeat])
        left = left[np.argsort(bucket[left], kind="stable")]
        which, sizes_ = np.unique(bucket[left], return_counts=True)
        yield batch_of(which, number, sizes_, a[left].view(np.int64), b[left].view(np.int32), doc[left], of[left], at[left], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.asarray(hot.value, np.uint64)
        for row in _each(batches, "unit", "doc", "of", "size", "packed", "answers"):
            yield from windows_of(often, *row)
            trim()

    return run


def _exact(t: pa.Table) -> pa.Table:
    """One bucket: all places of its windows, grouped by the whole hash; gives those that aren't first, and the known runs, for each unit."""
    columns = {c: t.column(c).combine_chunks() for c in ("a", "b", "doc", "of", "at", "length")}
    flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in columns.items()}
    n = columns["at"].value_lengths().to_numpy()
    is_known = columns["length"].value_lengths().to_numpy() > 0
    unit = np.repeat(t.column("unit").to_numpy(), n)
    known = np.repeat(is_known, n)
    doc, of, at = flat["doc"], flat["of"], flat["at"]
    open_ = np.flatnonzero(~known)
    order, repeat = ordered(flat["a"], flat["b"], doc[open_], of[open_], at[open_])
    found = open_[order[repeat]]
    found = found[np.lexsort((at[found], of[found], doc[found], unit[found]))]
    i, length = as_runs(at[found], unit[found], doc[found], of[found])
    i = np.append(found[i], np.flatnonzero(known))
    length = np.append(length, flat["length"])
    order = np.argsort(unit[i], kind="stable")
    i, length = i[order], length[order]
    cut = np.flatnonzero(np.append(True, unit[i][1:] != unit[i][:-1])) if len(i) else np.empty(0, np.int64)
    ends = pa.array(np.append(cut, len(i)), pa.int32())
    lists = (pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((doc[i], pa.int64()), (of[i], pa.int64()), (at[i], pa.int32()), (length, pa.int32())))
    return pa.table([pa.array(unit[i][cut], pa.int64()), *lists], names=["unit", "doc", "of", "at", "length"])


# Pass 3


def removed_words(n: int, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """True for the words that windows starting in [at, at + length) cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(width: int, as_text: bool):
    def rows_of(raws: Iterator[bytes], docs: list, ofs: list, repeats: list | None) -> list[tuple]:
        by: dict[tuple, list[tuple]] = {}
        for r in repeats or ():
            for d, o, p, n in zip(r["doc"], r["of"], r["at"], r["length"], strict=True):
                by.setdefault((d, o), []).append((p, n))
        out = []
        for raw, d, o in zip(raws, docs, ofs, strict=True):
            words = words_of(raw)
            n, kept = len(words), words
            if found := by.get((d, o)):
                at, length = np.array(found, np.int64).T
                gone = removed_words(n, at, length, width)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            text = b" ".join(kept)
            last = (text if len(kept) < n else raw).decode("utf-8", "surrogatepass") if as_text else hashlib.sha256(text).hexdigest()
            out.append((n, n - len(kept), last))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rest = batch.column(batch.schema.get_field_index("rest"))
            for k, (docs, ofs, sizes, packed, repeats) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "of", "size", "packed", "repeats")), strict=True)):
                rows = rows_of(_raws(packed, sizes), docs, ofs, repeats)
                columns = [rest.slice(k, 1).flatten(), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))]
                whole = pa.RecordBatch.from_arrays(columns, names=["rest", "n_words", "n_removed", "last"])
                yield from (whole.slice(i, SLICE) for i in range(0, len(rows), SLICE))

    return run


def _apart(rows: DataFrame) -> DataFrame:
    """Adds ``of``: 0, or a hash of the text where a doc_id stands on several texts; such ids are few, and mostly none."""
    several = rows.groupBy("doc").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several")).where("several and doc is not null")
    several = materialize(several.select("doc"), "substring-ids")
    if not (n := several.count()):
        return rows.withColumn("of", F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(several.withColumn("several", F.lit(True))) if n <= 20_000 else several.withColumn("several", F.lit(True)), "doc", "left")
    return marked.withColumn("of", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).cast("long")).drop("several")


def layout(n: int, cells_per_anchor: int = 8, shard_bits: int = SHARD_BITS) -> tuple[int, int]:
    """Shards, and bits of a shard's cells a row, for about n windows: the cells for each anchor never get fewer, as shards get more."""
    need = max(1, cells_per_anchor * (n // 6 + 1))
    shards = max(LEAST_SHARDS, -(-need // (1 << shard_bits)))
    return shards, max(8, (-(-need // shards) - 1).bit_length())


def substring_dedup(docs: DataFrame, width: int = WIDTH, as_text: bool = False, bucket_windows: int = 1 << 20, cells_per_anchor: int = 8, shard_bits: int = SHARD_BITS, hot: int = 1 << 15) -> DataFrame:
    """A row per row: doc_id, n_words, n_removed, kept_sha256. With ``as_text`` the columns of ``docs``, the text cut (as it was, if nothing is removed)."""
    spark, rest = docs.sparkSession, [c for c in docs.columns if c != "text"] if as_text else ["doc_id"]
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.struct(*rest).alias("rest"), F.col("text").cast("string"))
    rows = _apart(rows).select("doc", "of", "rest", "text")
    kind = dict(rows.dtypes)["rest"]
    units = rows.mapInArrow(_packed(), f"unit long, doc array<long>, of array<long>, rest array<{kind}>, size array<int>, packed binary")
    units = materialize(units, "substring-units")
    n = (units.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0) // 6  # windows, about: only sizes depend on it
    shards, bits = layout(n, cells_per_anchor, shard_bits)
    buckets = max(32, n // bucket_windows)

    seen = units.select("unit", "doc", "size", "packed").mapInArrow(_counted(shards, bits, width), SEEN)
    answers = materialize(seen.groupBy("shard").applyInArrow(_merged(bits, max(hot, n // 6 // HOT_LIST)), ANSWERS), "substring-answers")
    frequent = np.array([c for r in answers.where("unit is null").select("hot").toLocalIterator() for c in r.hot], np.int64)  # at most HOT_LIST cells
    by_unit = answers.where("unit is not null").groupBy("unit").agg(F.collect_list(F.struct("shard", "twice")).alias("answers"))
    suspected = units.join(by_unit, "unit", "left").select("unit", "doc", "of", "rest", "size", "packed", "answers")
    suspected = suspected.mapInArrow(_suspected(shards, bits, width, buckets, spark.sparkContext.broadcast(frequent)), SUSPECTED)
    exact = suspected.groupBy("bucket").applyInArrow(_exact, "unit long, doc array<long>, of array<long>, at array<int>, length array<int>")
    repeats = exact.groupBy("unit").agg(F.collect_list(F.struct("doc", "of", "at", "length")).alias("repeats"))
    out = units.join(repeats, "unit", "left").select("unit", "doc", "of", "rest", "size", "packed", "repeats")
    out = out.mapInArrow(_cut(width, as_text), f"rest {kind}, n_words long, n_removed long, last string")
    if as_text:
        return out.select(*(F.col("last").alias(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
    return out.select("rest.doc_id", "n_words", "n_removed", F.col("last").alias("kept_sha256"))
