"""Pointwise scores that expressions can't state: Arrow-batched, one pass, no shuffle."""

from __future__ import annotations

import ast
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _factors(words: list[str], threshold: float) -> float:
    n, types, start = 0.0, set(), 0
    for i, w in enumerate(words):
        types.add(w)
        if len(types) / (i - start + 1) <= threshold:
            n, types, start = n + 1, set(), i + 1
    if start < len(words):
        n += (1 - len(types) / (len(words) - start)) / (1 - threshold)
    return len(words) / n if n > 0 else -1.0


def mtld_of(text: str, threshold: float = 0.72) -> float:
    """Words per factor, mean of both directions; a factor is complete when its type share falls to the threshold."""
    words = [w.translate(PUNCTUATION).lower() for w in text.split()]
    return (_factors(words, threshold) + _factors(words[::-1], threshold)) / 2 if words else 0.0


def hdd_of(text: str, sample_size: int = 42) -> float:
    """HD-D: over word types, the chance that a sample holds the type, divided by the sample's size. All words count in N; types that lose all signs don't."""
    words = text.split()
    n, s = len(words), min(int(sample_size), len(words))
    types = Counter(t for t in (w.translate(PUNCTUATION).lower() for w in words) if t)
    held = {f: 1 - math.prod(max(n - f - i, 0) / (n - i) for i in range(s)) for f in set(types.values())}
    return sum(held[f] / s for f in types.values()) if types else 0.0


def vocd_of(text: str, sample: int = 50, trials: int = 100, seed: int = 42) -> float:
    """vocd-D: D fitted to mean type shares of random samples of 35 to ``sample`` words by TTR(n) = D / n * (sqrt(1 + 2 n / D) - 1)."""
    words = [w for w in (x.translate(PUNCTUATION).lower() for x in text.split()) if w]
    if len(words) < sample:
        return 0.0
    # A trial draws ``sample`` places without replacement; its first n of them are a sample of n. Types are counted at their first place.
    numbers = np.unique(words, return_inverse=True)[1]
    rng, sizes = np.random.default_rng(seed), np.arange(35, sample + 1)
    drawn = numbers[np.stack([rng.choice(len(numbers), sample, replace=False) for _ in range(trials)])]
    order = np.argsort(drawn, axis=1, kind="stable")
    along = np.take_along_axis(drawn, order, 1)
    new = np.ones_like(drawn, bool)
    new[:, 1:] = along[:, 1:] != along[:, :-1]
    first = np.empty_like(new)
    np.put_along_axis(first, order, new, 1)
    shares = first.cumsum(1)[:, sizes - 1].mean(0) / sizes

    def loss(d: float) -> float:
        return float(((d / sizes * (np.sqrt(1 + 2 * sizes / d) - 1) - shares) ** 2).sum())

    low, high, g = 1e-3, 2000.0, (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(math.exp(c)) < loss(math.exp(d)) else (c, b)
    return math.exp((a + b) / 2)


def compress_ratio_of(text: str, level: int = 9) -> float:
    raw = text.encode("utf-8", "surrogatepass")
    return round(len(zlib.compress(raw, level)) / len(raw), 4) if raw else 0.0


_FENCE = re.compile(r"```[^\n`]*\n(.*?)```", re.S)


def python_parses(text: str) -> float:
    """1 if all fenced blocks (or the text, without any) parse as Python. Strict parsing: stricter than an error-tolerant tree."""
    for code in [b for b in _FENCE.findall(text) if b.strip()] or [text]:
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return 0.0
    return 1.0


def _double(f, *args) -> object:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", *args) for x in s], dtype="float64")

    return run


def mtld(text: Column, threshold: float = 0.72) -> Column:
    return _double(mtld_of, threshold)(text)


def hdd(text: Column, sample_size: int = 42) -> Column:
    return _double(hdd_of, sample_size)(text)


def vocd(text: Column, sample: int = 50, trials: int = 100, seed: int = 42) -> Column:
    return _double(vocd_of, sample, trials, seed)(text)


def compress_ratio(text: Column, level: int = 9) -> Column:
    return _double(compress_ratio_of, level)(text)


def parses_as_python(text: Column) -> Column:
    return _double(python_parses)(text)


def _ids(data: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_scores(spark, path: str | None = None, pattern: str | None = None, n: int = 2):
    """A function of a text column: struct of length, entropy (bits) and unique_share (of n-grams). The rank file, of fixed size, is broadcast; its encoder loads once a task.

    Without a path the public 50k byte-level vocabulary is taken, whose name the caller should record.
    """
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("length long, entropy double, unique_share double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = _ids(data.value, pattern)
        for s in batches:
            rows = []
            for x in s:
                ids = encode(x or "")
                h = sum(-c / len(ids) * math.log2(c / len(ids)) for c in sorted(Counter(ids).values()))
                g = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
                rows.append((len(ids), abs(h), len(set(g)) / len(g) if g else 0.0))
            yield pd.DataFrame(rows, columns=["length", "entropy", "unique_share"])

    return run


def truncated(spark, max_tokens: int, path: str | None = None, pattern: str | None = None):
    """A function of a text column: its first ``max_tokens`` tokens as text, for embedders and models with a limit. A cut inside a sign drops the sign's bytes."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _ids(data.value, pattern).__self__
        for s in batches:
            yield pd.Series([encoding.decode_bytes(encoding.encode_ordinary(x)[:max_tokens]).decode("utf-8", "ignore") if x is not None else None for x in s], dtype="object")

    return run


def tree_of(heads: list[int]) -> tuple[int, int]:
    """Nodes, and the greatest depth over roots (rows that head themselves or have -1)."""
    depth = [0] * len(heads)
    for i in range(len(heads)):
        path, k = [], i
        while depth[k] == 0:
            path.append(k)
            if heads[k] in (-1, k) or len(path) > len(heads):
                break
            k = heads[k]
        base = depth[k] if depth[k] else 0
        for j in reversed(path):
            base += 1
            depth[j] = base
    return len(heads), max(depth, default=0)


def tree_stats(heads: Column) -> Column:
    """nodes and depth from arrays of parent positions, as a dependency parser gives them."""
    return F.pandas_udf(_trees, "nodes int, depth int")(heads)


def _trees(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tree_of([int(x) for x in h]) if h is not None else (0, 0) for h in heads], columns=["nodes", "depth"])


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of its table is one long integer, whose cleared bits are counted at the end."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_of(gold: str, pred: str, longest: bool = True) -> tuple[float, float, float]:
    """F-measures of ROUGE-1, -2 and -L (0 unless ``longest``) over lower-cased letters and digits."""
    g, p = (re.findall(r"[a-z0-9]+", x.lower()) for x in (gold, pred))

    def f(both: int, a: int, b: int) -> float:
        return 2 * both / (a + b) if both else 0.0

    out = []
    for n in (1, 2):
        cg, cp = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (g, p))
        out.append(f(sum((cg & cp).values()), sum(cg.values()), sum(cp.values())))
    return (*out, f(lcs(g, p) if longest else 0, len(g), len(p)))


def common_places(a: list[str], b: list[str]) -> dict[int, int]:
    """One longest common subsequence: places of ``a`` and where they stand in ``b``."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.fromiter((numbers[w] for w in t), np.int32, len(t)) for t in (a, b))
    table, diagonal = np.zeros((len(a) + 1, len(b) + 1), np.int32), np.empty(len(b), np.int32)
    for i in range(1, len(a) + 1):
        np.add(table[i - 1, :-1], y == x[i - 1], out=diagonal)  # without a match no more than what stands above
        np.maximum(table[i - 1, 1:], diagonal, out=diagonal)
        np.maximum.accumulate(diagonal, out=table[i, 1:])
    out, i, j = {}, len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def rouge_lsum_of(gold: str, pred: str) -> float:
    """Over lines as sentences: places of each gold line in common with any predicted line, each word counted as often as both texts have it."""
    g, p = ([re.findall(r"[a-z0-9]+", x.lower()) for x in t.split("\n")] for t in (gold, pred))
    g, p = [x for x in g if x], [x for x in p if x]
    left_g, left_p = Counter(w for x in g for w in x), Counter(w for x in p for w in x)
    n, m, hits = sum(left_g.values()), sum(left_p.values()), 0
    for x in g:
        for i in sorted(set().union(*(common_places(x, y) for y in p))):
            if left_g[x[i]] > 0 and left_p[x[i]] > 0:
                hits, left_g[x[i]], left_p[x[i]] = hits + 1, left_g[x[i]] - 1, left_p[x[i]] - 1
    return 2 * hits / (n + m) if hits else 0.0


def novelty_of(source: str, summary: str, most: int = 3) -> list[float]:
    """For n-grams of one to ``most`` words: the share of the summary's that the source lacks, and of those that the summary repeats."""
    a, s = (re.findall(r"\w+", x.lower()) for x in (source, summary))
    out = []
    for n in range(1, most + 1):
        have, own = set(zip(*(a[i:] for i in range(n)), strict=False)), Counter(zip(*(s[i:] for i in range(n)), strict=False))
        out += [len(own.keys() - have) / len(own), sum(c > 1 for c in own.values()) / len(own)] if own else [0.0, 0.0]
    return out


def bleu_of(gold: str, pred: str, most: int = 4) -> float:
    """Sentence BLEU with one added to the counts of orders above 1."""
    g, p = gold.split(), pred.split()
    if not g or not p:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        cg, cp = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (g, p))
        hit, all_ = sum((cg & cp).values()), sum(cp.values())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit + (n > 1)) / (all_ + (n > 1))) / most
    return math.exp(logs + min(0.0, 1 - len(g) / len(p)))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and exchanges: the vertical differences of a column of the table are two long integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, n = full, 0, len(a)
    for w in b:
        same = where.get(w, 0)
        d0 = (((same & up) + up) ^ up) | same | down
        plus, minus = down | full & ~(d0 | up), up & d0
        n += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | full & ~(d0 | plus), plus & d0
    return n


def chrf_of(gold: str, pred: str, most: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-beta, mean over orders that either side has."""
    g, p, scores = "".join(gold.split()), "".join(pred.split()), []
    for n in range(1, most + 1):
        cg, cp = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (g, p))
        if not cg or not cp:
            continue
        hit = sum((cg & cp).values())
        a, b = hit / sum(cp.values()), hit / sum(cg.values())
        scores.append((1 + beta**2) * a * b / (beta**2 * a + b) if hit else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def extractive_of(source: str, summary: str) -> tuple[float, float, float]:
    """Coverage, density and compression of a summary by greedy shared fragments."""
    a, s = (re.findall(r"\w+", x.lower()) for x in (source, summary))
    where: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        where.setdefault(w, []).append(i)
    i, pieces = 0, []
    while i < len(s):
        best = 0
        for j in where.get(s[i], ()):
            k = 0
            while i + k < len(s) and j + k < len(a) and s[i + k] == a[j + k]:
                k += 1
            best = max(best, k)
        if best:
            pieces.append(best)
        i += max(best, 1)
    n = len(s) or 1
    return sum(pieces) / n, sum(x * x for x in pieces) / n, len(a) / n


_GRAMS = "rouge1 double, rouge2 double, novel_1 double, repeated_1 double"


def ngram_overlap(gold: Column, pred: Column) -> Column:
    """Only the scores that n-gram counts give, in time that follows the texts' lengths."""
    return F.pandas_udf(_gram_overlaps, _GRAMS)(gold, pred)


def _gram_overlaps(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    rows = [(*rouge_of(g or "", p or "", longest=False)[:2], *novelty_of(g or "", p or "", 1)) for g, p in zip(gold, pred, strict=True)]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _GRAMS.split(", ")])


_OVERLAP = "rouge1 double, rouge2 double, rougeL double, rougeLsum double, bleu double, chrf double, edit_distance long, edit_similarity double, coverage double, density double, compression double, novel_1 double, repeated_1 double, novel_2 double, repeated_2 double, novel_3 double, repeated_3 double"


def overlap(gold: Column, pred: Column) -> Column:
    """All n-gram and string-distance scores of a gold answer and a prediction."""
    return F.pandas_udf(_overlaps, _OVERLAP)(gold, pred)


def _overlaps(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    rows = []
    for g, p in zip(gold, pred, strict=True):
        g, p = g or "", p or ""
        a, b = p.split(), g.split()
        b = b[: len(a)]
        d = edit_distance(a, b)
        rows.append((*rouge_of(g, p), rouge_lsum_of(g, p), bleu_of(g, p), chrf_of(g, p), d, 1 - d / max(len(a), len(b), 1), *extractive_of(g, p), *novelty_of(g, p)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _OVERLAP.split(", ")])


def best_assignment(table: np.ndarray) -> float:
    """The greatest sum of a one-to-one choice of cells: the Hungarian algorithm, exact at any size."""
    if table.shape[0] > table.shape[1]:
        table = table.T
    n, m = table.shape
    u, v, row_of, back = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            r = row_of[j]
            d = -table[r - 1] - u[r] - v[1:]
            nearer = ~used[1:] & (d < least[1:])
            least[1:][nearer], back[1:][nearer] = d[nearer], j
            k = int(np.where(used, np.inf, least).argmin())
            step = least[k]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    taken = np.flatnonzero(row_of[1:])
    return float(table[row_of[1:][taken] - 1, taken].sum())


def best_alignment(gold: list[frozenset], pred: list[frozenset], f: Callable[[frozenset, frozenset], float]) -> float:
    """The greatest sum of ``f`` over one-to-one pairs. Only bags that share a word, or are both empty, can add; each group of bags that such pairs link is solved by itself."""
    many_g, many_p = Counter(gold), Counter(pred)
    where: dict[str | None, list[frozenset]] = {}
    for b in many_p:
        for w in b or (None,):
            where.setdefault(w, []).append(b)
    of_g = {a: {b: x for b in {b for w in a or (None,) for b in where.get(w, ())} if (x := f(a, b)) > 0} for a in many_g}
    of_p: dict[frozenset, list[frozenset]] = {}
    for a, row in of_g.items():
        for b in row:
            of_p.setdefault(b, []).append(a)
    total, seen = 0.0, set()
    for start in many_g:
        if start in seen or not of_g[start]:
            continue
        seen.add(start)
        left, right, open_ = [start], {}, [start]
        while open_:
            for b in of_g[open_.pop()]:
                if b not in right:
                    right[b] = len(right)
                    new = [a for a in of_p[b] if a not in seen]
                    seen.update(new)
                    left += new
                    open_ += new
        table = np.zeros((len(left), len(right)))
        for i, a in enumerate(left):
            for b, x in of_g[a].items():
                table[i, right[b]] = x
        rows, cols = np.array([many_g[a] for a in left]), np.array([many_p[b] for b in right])
        if min(table.shape) == 1:  # equal rows or columns: the greatest cells of one of them
            values, often, most = (table[0], cols, rows[0]) if len(left) == 1 else (table[:, 0], rows, cols[0])
            total += float(np.sort(np.repeat(values, often))[::-1][:most].sum())
        else:
            total += best_assignment(np.repeat(np.repeat(table, np.minimum(rows, cols.sum()), 0), np.minimum(cols, rows.sum()), 1))
    return total


def drop_of(gold: list[str], pred: list[str], places: int | None = 2) -> tuple[float, float]:
    """Exact match and best one-to-one F1 of answer bags, to two places unless ``places`` says otherwise; bags with other numbers never match."""

    def bag(x: str) -> frozenset:
        x = re.sub(r"\b(a|an|the)\b", " ", x.lower().translate(PUNCTUATION))
        return frozenset(x.split())

    g, p = [bag(x) for x in gold], [bag(x) for x in pred]
    number = lambda b: {w for w in b if w.replace(".", "", 1).isdigit()}

    def f(a: frozenset, b: frozenset) -> float:
        if number(a) and not number(a) & number(b):
            return 0.0
        both = len(a & b)
        return 2 * both / (len(a) + len(b)) if both else float(not a and not b)

    exact = float(sorted(map(sorted, g)) == sorted(map(sorted, p)))
    best = best_alignment(g, p, f) / max(len(g), len(p), 1)
    return exact, best if places is None else round(best, places)


def drop_scores(gold: Column, pred: Column, places: int | None = 2) -> Column:
    def run(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drop_of(list(g), list(p), places) for g, p in zip(gold, pred, strict=True)], columns=["em", "f1"])

    run.__annotations__ = {"gold": pd.Series, "pred": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "em double, f1 double")(gold, pred)


def singular_values(matrix: Column) -> Column:
    """Of an array of rows, largest first; none of an empty matrix."""
    return F.pandas_udf(_singular, "array<double>")(matrix)


def _singular(matrices: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.svd(np.array([list(r) for r in m], float), compute_uv=False).tolist() if m is not None and len(m) and len(m[0]) else [] for m in matrices])


def token_matching(candidate: Column, reference: Column) -> Column:
    """precision, recall and f1 of greedy matching by cosine between the token embeddings (arrays of arrays) of a candidate and a reference."""
    return F.pandas_udf(_matching, "precision double, recall double, f1 double")(candidate, reference)


def _matching(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for c, r in zip(candidate, reference, strict=True):
        if c is None or r is None or not len(c) or not len(r):
            rows.append((0.0, 0.0, 0.0))
            continue
        a, b = (np.array([list(x) for x in m], float) for m in (c, r))
        a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (a, b))
        s = a @ b.T
        p, q = float(s.max(1).mean()), float(s.max(0).mean())
        rows.append((p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])
