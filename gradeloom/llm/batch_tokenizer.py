"""Encoding many whole texts at once with the tokenizers library, each distinct chunk of a batch once.

A byte-level pattern that takes one leading space into a match parts texts before each space, and before a line feed between other
signs, so a text's ids are those of its chunks in a row: what stands up to the next space or line feed, with the one before it.
A batch is split and its chunks are numbered in Arrow; only distinct ones are encoded, and Arrow's take puts the ids of the texts
together. Where white space stands next to white space a match may hold several: texts with such a place are encoded whole.

Words of Latin letters, alone or before one sign of ``.,;:!?``, need no pattern: copies of the tokenizer whose pre-tokenizers only part
at spaces or line feeds encode them, for half the time. Words that came twice in a batch are remembered in the worker, at most ``REMEMBERED``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 1 << 18
AT_ONCE = 5000
_PLAIN = r"^\n?[A-Za-zÀ-ÖØ-öø-ž]+[.,;:!?]?$"
#: A chunk as the split leaves it: without its space, or with its line feed.
_ODD = r"^(?:$|\n$|\n?[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\p{Z}]|\n\n)"
_SIGNS = ".,;:!?"
#: Fixed value: the sign that byte-level vocabularies write for a space.
SPACE = "Ġ"


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))


def _spaced(texts: pa.LargeStringArray, space: str = " ") -> pa.LargeStringArray:
    return pc.binary_join_element_wise(pa.scalar(space, pa.large_string()), texts, pa.scalar("", pa.large_string()))


class BatchTokenizer:
    """Without special tokens: their strings are ordinary text."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.plain, self.lines, self.ascii = (Tokenizer.from_str(data.decode()) for _ in range(4))
        for t in (self.full, self.plain, self.lines, self.ascii):
            t.encode_special_tokens = True
        raw = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), raw])
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), raw])
        # Letters of ASCII stand for themselves among a byte-level vocabulary's signs, and SPACE for a space: nothing is left to translate.
        self.ascii.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.lengths = np.zeros(self.full.get_vocab_size(), np.int64)
        for token, i in self.full.get_vocab().items():
            self.lengths[i] = len(token)  # a sign for each byte
        for probe in (" some words, of this Kind: are? parted! so; été.", "\nsome\nwords,\nof\nthis\nKind:\nare?\nparted!\nso;\nété."):
            with_, at = (self.plain, " ") if probe[0] == " " else (self.lines, "\n")
            parts = [x for p in probe.split(at)[1:] for x in ([at + p[:-1], p[-1]] if p[-1] in _SIGNS else [at + p])]
            if self.whole(probe) != [i for p in parts for i in (self.full if p in _SIGNS else with_).encode(p, add_special_tokens=False).ids]:
                raise ValueError("the tokenizer does not part texts before spaces and signs")
        if self.ascii.encode(f"{SPACE}some {SPACE}Words {SPACE}x", add_special_tokens=False).ids != self.whole(" some Words x"):
            raise ValueError("the tokenizer's vocabulary is not of bytes")
        self.signs = _lists(np.array([self.whole(s)[0] for s in _SIGNS]), np.arange(1, len(_SIGNS) + 1))
        self.known, self.known_ids = pa.array([], pa.large_string()), _lists(np.empty(0, np.int32), np.empty(0, np.int32))

    def whole(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def _parted(self, tokenizer, texts: pa.LargeStringArray, more: int = 0) -> pa.ListArray:
        """Ids of texts that each begin with a space or line feed: many go through one call, and their ids part where the bytes of the tokens add up. ``more``: bytes of each text beyond those."""
        out = []
        for k in range(0, len(texts), AT_ONCE):
            part = pa.concat_arrays([texts[k : k + AT_ONCE]])
            ends = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            joined = part.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode()
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            done, sizes = np.cumsum(self.lengths[ids]), ends[1:] - ends[0] - more * np.arange(1, len(part) + 1)
            at = np.searchsorted(done, sizes, "right")
            if not (done[at - 1] == sizes).all():
                raise ValueError("the tokenizer does not part texts before spaces")
            out.append(_lists(ids, at))
        return pa.concat_arrays(out) if out else self.known_ids[:0]

    def _words(self, words: pa.LargeStringArray, often: np.ndarray) -> pa.ListArray:
        """Ids of distinct words of Latin letters; remembers those that came often, while there is room."""
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null()
        line = pc.starts_with(words, "\n")
        plain = pc.string_is_ascii(words)
        simple, spaced, lined = (np.flatnonzero(pc.and_(new, x).to_numpy(zero_copy_only=False)) for x in (pc.and_not(plain, line), pc.invert(pc.or_(plain, line)), line))
        missing = np.concatenate([simple, spaced, lined])
        fresh = words.take(pa.array(missing))
        n, m = len(simple), len(simple) + len(spaced)
        learned = pa.concat_arrays([self._parted(self.ascii, _spaced(fresh[:n], f" {SPACE}"), 2), self._parted(self.plain, _spaced(fresh[n:m])), self._parted(self.lines, fresh[m:])])
        where = at.fill_null(0).to_numpy().astype(np.int64)
        where[missing] = len(self.known) + np.arange(len(missing))
        found = pa.concat_arrays([self.known_ids, learned])
        keep = pa.array(np.flatnonzero(often[missing])[: REMEMBERED - len(self.known)])
        if len(keep):
            self.known, self.known_ids = pa.concat_arrays([self.known, fresh.take(keep)]), pa.concat_arrays([self.known_ids, learned.take(keep)])
        return found.take(pa.array(where))

    def _chunks(self, chunks: pa.LargeStringArray, counts: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of distinct chunks, and which are odd."""
        odd = pc.match_substring_regex(chunks, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        is_plain, is_other = np.flatnonzero(plain), np.flatnonzero(~plain & ~odd)
        some = chunks.take(pa.array(is_plain))
        coded = pc.utf8_rtrim(some, _SIGNS).dictionary_encode()
        code = coded.indices.to_numpy()
        often = np.bincount(code, counts[is_plain], len(coded.dictionary)) > 1
        sign = pc.index_in(pc.utf8_slice_codeunits(some, -1), value_set=pa.array(list(_SIGNS), pa.large_string()))
        words = self._words(coded.dictionary, often)
        has, sign = sign.is_valid().to_numpy(zero_copy_only=False), sign.fill_null(0).to_numpy()
        # A word's list, then its sign's: two entries a chunk, the second dropped where there is none.
        both = np.stack([code, len(words) + sign], 1).ravel()[np.stack([np.ones(len(code), bool), has], 1).ravel()]
        flat = pa.concat_arrays([words, self.signs]).take(pa.array(both))
        sizes = words.value_lengths().to_numpy()[code] + has
        others = chunks.take(pa.array(is_other))
        others = self._parted(self.full, pc.if_else(pc.starts_with(others, "\n"), others, _spaced(others)))
        lists = pa.concat_arrays([_lists(flat.flatten().to_numpy(), np.cumsum(sizes)), others, _lists(np.empty(0, np.int32), np.zeros(1, np.int64))])
        where = np.full(len(chunks), len(lists) - 1)  # odd ones: nothing, as they are never taken
        where[is_plain], where[is_other] = np.arange(len(is_plain)), len(is_plain) + np.arange(len(is_other))
        return lists.take(pa.array(where)), odd

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """Ids of each text; null texts are empty. With ``end_id`` every list ends with it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, sizes = split.flatten(), split.value_lengths().to_numpy()
        del split
        first = np.cumsum(sizes) - sizes
        heads = flat.take(pa.array(first)).dictionary_encode()
        coded = flat.dictionary_encode()
        del flat
        code, chunks = coded.indices.to_numpy().copy(), coded.dictionary
        del coded
        rest = np.ones(len(code), bool)
        rest[first] = False
        lists, odd = self._chunks(chunks, np.bincount(code[rest], minlength=len(chunks)))
        base, n_heads = len(chunks), len(heads.dictionary)
        del chunks
        of = np.repeat(np.arange(n, dtype=np.int32), sizes)
        odd_text = np.zeros(n, bool)
        odd_text[of[rest & odd[code]]] = True
        alone = [self.whole(t) for t in heads.dictionary.to_pylist()] + [self.whole(texts[i].as_py()) for i in np.flatnonzero(odd_text).tolist()]
        alone += [[end_id] if end_id is not None else []]
        ends = np.cumsum([len(x) for x in alone])
        lists = pa.concat_arrays([lists, _lists(np.fromiter((i for x in alone for i in x), np.int32), ends)])
        code[first] = base + heads.indices.to_numpy()
        code[first[odd_text]] = base + n_heads + np.arange(int(odd_text.sum()))
        # A text's pieces, then the end; of a text encoded whole only the first piece counts.
        parts = np.full(len(code) + n, base + len(alone) - 1, np.int32)
        place = np.arange(len(code), dtype=np.int32) + of
        parts[place] = code
        taken = np.ones(len(parts), bool)
        taken[place[odd_text[of] & rest]] = False
        del code, place, of, rest
        counts = lists.value_lengths().to_numpy()[parts] * taken
        upto = np.cumsum(counts, dtype=np.int64)[np.cumsum(sizes + 1) - 1] if n else np.empty(0, np.int64)
        del counts
        return _lists(lists.take(pa.array(parts[taken])).flatten().to_numpy(), upto)
