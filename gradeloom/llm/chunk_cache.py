"""Encoding whole texts by remembered chunks: what stands between two spaces, with the space before it.

A byte-level pattern that takes one leading space into a match parts texts before each space, so the ids of a text are those
of its chunks in a row. The exception is white space next to such a space; a chunk that begins with white space
after its space (or is empty) is remembered as odd, and texts that hold one are encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

REMEMBERED = 400_000


class ChunkCache(dict):
    """chunk -> ids; None for odd chunks. ``learn`` gives the ids of " " + chunk for many chunks, ``whole`` those of any texts."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], most: int = REMEMBERED):
        super().__init__()
        self.learn, self.whole, self.most, self.new, self.heads = learn, whole, most, [], {}

    def __missing__(self, chunk: str) -> str:
        self.new.append(chunk)
        return chunk

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self) > self.most:
            first = list(islice(self.items(), self.most // 3))  # frequent chunks come early
            self.clear()
            self.update(first)
        if len(self.heads) > self.most // 8:
            self.heads = {}
        get, rows, self.new = self.__getitem__, [], []
        for t in texts:
            first, *rest = t.split(" ")
            n = len(self.new)
            ids = list(map(get, rest))
            rows.append((first, ids, len(self.new) > n))
        if self.new:
            new = list(set(self.new))
            plain = [c for c in new if c and not c[0].isspace()]
            self.update(dict.fromkeys(new))
            self.update(zip(plain, self.learn(plain), strict=True))
        heads = [f for f in {first for first, _, _ in rows} if f not in self.heads]
        self.heads.update(zip(heads, self.whole(heads), strict=True))
        out: list[bytes | None] = []
        for first, ids, fresh in rows:
            if fresh:
                ids = [get(x) if type(x) is str else x for x in ids]
            try:
                out.append(self.heads[first] + b"".join(ids))
            except TypeError:  # an odd chunk
                out.append(None)
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = x
        return out
