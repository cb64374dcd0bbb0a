"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Encoding one match of the splitting pattern: position i holds a token and the rank of the pair it forms with the
next live token. A segment tree over the positions stores rank * width + position, so its root is the
leftmost pair of least rank. A merge changes three leaves (the merged position, the one that died, the live
neighbour before) and the logarithmically many nodes above them.

The trees of many matches of similar width lie side by side in numpy arrays and take their merges in step;
matches over ``LONG`` bytes get a tree of their own in plain Python, O(n log n). Ranks are looked up in an
open-addressing table over (left id, right id).

Texts repeat most of their words; ``chunk_cache`` remembers their ids in each worker, in a bounded dict.
"""

from __future__ import annotations

import base64

import numpy as np
import regex

from .chunk_cache import REMEMBERED, ChunkCache

LONG = 64
#: Words of all kinds that a space parts; each begins with one.
PROBES = (" a b", " It's 12 000 km, isn't it? été", " x, y; (z) 3.5 -1 \"q\" a'b 'c", " 漢字 かな 😀 _a_ ##")
NONE = np.int32(2**31 - 1)


def load_ranks(data: bytes) -> list[bytes]:
    """Lines of base64 token and rank, as a list by rank."""
    pairs = [line.split() for line in data.splitlines() if line]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PairRanks:
    """rank of (left, right) -> id of the merged token; NONE where they don't merge."""

    def __init__(self, vocab: list[bytes]):
        ids = {t: i for i, t in enumerate(vocab)}
        self.ids = ids
        keys, ranks = [], []
        for i, t in enumerate(vocab):
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(i)
        self.as_dict = dict(zip(keys, ranks, strict=True))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo_k, todo_r = np.array(keys, np.int64), np.array(ranks, np.int32)
        at = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo_k[free]
            placed = free & (self.keys[at] == todo_k)
            self.ranks[at[placed]] = todo_r[placed]
            todo_k, todo_r, at = todo_k[~placed], todo_r[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class BytePairEncoder:
    """Exact byte-pair encoding by ranks. Ids are ranks."""

    def __init__(self, vocab: list[bytes], pattern: str):
        self.vocab, self.pairs = vocab, PairRanks(vocab)
        self.byte_ids = np.array([self.pairs.ids[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.chunks = ChunkCache(self._learn, self._split_whole)
        # Chunks serve only a pattern that parts texts before each space between other signs; with another one texts are split whole.
        self.parts = all(self.find(t) == [p for c in t.split(" ")[1:] for p in self.find(" " + c)] for t in PROBES)

    def _together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        n, shift = len(pieces), width.bit_length() - 1
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw].astype(np.int32)
        pos = np.arange(width)
        nxt = np.where(pos + 1 < lens[:, None], pos + 1, -1).astype(np.int64)
        prv = np.broadcast_to(pos - 1, (n, width)).astype(np.int64)
        leaf = np.full((n, width), NONE, np.int32)
        if width > 1:
            r, c = np.nonzero(nxt >= 0)
            rank = self.pairs.look_up(ids[r, c], ids[r, c + 1])
            leaf[r, c] = np.where(rank == NONE, NONE, rank * width + c)
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = leaf
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        alive = pos < lens[:, None]
        flat_tree, flat_ids, flat_nxt, flat_prv, flat_alive = tree.ravel(), ids.ravel(), nxt.ravel(), prv.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[:, 1] != NONE) if width > 1 else np.empty(0, np.int64)
        while len(rows):
            root = tree[rows, 1]
            p, rank = (root & (width - 1)).astype(np.int64), root >> shift
            base = rows * width
            right = flat_nxt[base + p]
            after = flat_nxt[base + right]
            flat_ids[base + p] = rank
            flat_alive[base + right] = False
            flat_nxt[base + p] = after
            has = after >= 0
            flat_prv[(base + after)[has]] = p[has]
            before = flat_prv[base + p]
            new_p = np.full(len(rows), NONE, np.int32)
            if has.any():
                k = self.pairs.look_up(rank[has], flat_ids[(base + after)[has]])
                new_p[has] = np.where(k == NONE, NONE, k * width + p[has])
            tree_base = rows * (2 * width) + width
            flat_tree[tree_base + p] = new_p
            flat_tree[tree_base + right] = NONE
            was = before >= 0
            if was.any():
                k = self.pairs.look_up(flat_ids[(base + before)[was]], rank[was])
                flat_tree[(tree_base + before)[was]] = np.where(k == NONE, NONE, k * width + before[was])
            top = np.concatenate([rows, rows, rows[was]]) * (2 * width)
            node = np.concatenate([p, right, before[was]]) + width
            while width > 1 and node[0] > 1:
                node >>= 1
                child = top + 2 * node
                flat_tree[top + node] = np.minimum(flat_tree[child], flat_tree[child + 1])
            rows = rows[tree[rows, 1] != NONE]
        kept = alive.sum(1)
        ends = np.cumsum(kept) * 4
        data = ids[alive].astype("<u4").tobytes()
        return [data[e - 4 * k : e] for e, k in zip(ends.tolist(), kept.tolist(), strict=True)]

    def _alone(self, piece: bytes) -> bytes:
        """One long piece, with a tree of its own."""
        n, ranks = len(piece), self.pairs.as_dict
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, big = [*range(1, n), -1], list(range(-1, n - 1)), (1 << 62)
        tree = [big] * (2 * width)

        def leaf(p: int, q: int) -> int:
            r = ranks.get(ids[p] << 20 | ids[q]) if q >= 0 else None
            return big if r is None else r * width + p

        for p in range(n):
            tree[width + p] = leaf(p, nxt[p])
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(p: int, v: int) -> None:
            k = width + p
            tree[k] = v
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while (root := tree[1]) != big:
            rank, p = divmod(root, width)
            right = nxt[p]
            ids[p], nxt[p] = rank, nxt[right]
            if nxt[p] >= 0:
                prv[nxt[p]] = p
            put(right, big)
            put(p, leaf(p, nxt[p]))
            if prv[p] >= 0:
                put(prv[p], leaf(prv[p], p))
        out, p = [], 0
        while p >= 0:
            out.append(ids[p])
            p = nxt[p]
        return np.array(out, "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece (a match of the pattern)."""
        out: list[bytes] = [b""] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.pairs.ids.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self._alone(p)
            elif p:
                by.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, at in by.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, x in zip(part, self._together([pieces[i] for i in part], width), strict=True):
                    out[i] = x
        return out

    def _know(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't remembered."""
        if len(self.pieces) > REMEMBERED // 4:
            self.pieces = {}
        new = [p for p in pieces if p not in self.pieces]
        self.pieces.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of " " + chunk; those that are one piece are remembered as chunks only."""
        split = [self.find(" " + c) for c in chunks]
        out: list[bytes] = [b""] * len(chunks)
        alone = [i for i, ps in enumerate(split) if len(ps) == 1]
        for i, ids in zip(alone, self.encode_pieces([split[i][0].encode("utf-8", "surrogatepass") for i in alone]), strict=True):
            out[i] = ids
        self._know({p for ps in split if len(ps) > 1 for p in ps})
        get = self.pieces.__getitem__
        for i, ps in enumerate(split):
            if len(ps) > 1:
                out[i] = b"".join(map(get, ps))
        return out

    def _split_whole(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        self._know({p for ps in split for p in ps})
        return [b"".join(map(self.pieces.__getitem__, ps)) for ps in split]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        return self.chunks.encode_texts(texts) if self.parts else self._split_whole(texts)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian 32-bit ids."""
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))
