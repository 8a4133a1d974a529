"""Texts to token ids through a bounded table of encoded words.

A text is cut before blanks, where the pre-tokenizer cuts as well, so equal
words have equal ids wherever they stand.  Each Python worker keeps the ids of
the words it has met; when the table is full it starts anew (words are encoded
again, nothing is lost).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = (r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
#: White space behind the first character, white space other than a blank before it, or a lone blank.
_SPACED = rf"(?s)^.+[ {_WHITE}]|^[{_WHITE}]|^ $"
#: Characters of text encoded at once.
CHUNK_CHARS = 6_000_000


class WordTable:
    """Base of encoders: ``encode_new`` gives the ids of distinct words."""

    def __init__(self, added: dict[str, int], pieces: Callable, max_words: int):
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        self.pieces = pieces
        self.max_words = max_words
        self.start_table()

    def encode_new(self, words: list[str], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each; ``spaced``: see ``has_space``."""
        raise NotImplementedError

    def learn(self, keys: list) -> None:
        """Encode the words of new keys: a plain key stands for a blank and the word,
        ``("first", w)`` for a word at the start, ``("piece", w)`` for a pre-tokenizer's piece."""
        words = [k[1] if type(k) is tuple else " " + k for k in keys]
        spaced = has_space(words)
        ids, n = self.encode_new(words, spaced)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(n) - n))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
        self.size = np.concatenate((self.size, n))
        # a blank before white space: the whole run may be cut elsewhere
        odd = np.zeros(len(keys), bool)
        for i in np.flatnonzero(spaced).tolist():
            w = words[i]
            odd[i] = type(keys[i]) is not tuple and (len(w) == 1 or w[1].isspace())
        self.odd = np.concatenate((self.odd, odd))
        self.table.update(zip(keys, range(len(self.table), len(self.table) + len(keys))))

    def start_table(self) -> None:
        """A table of the added tokens and the empty word only."""
        self.table = _Codes({("added", t): k for k, t in enumerate(self.added)})
        self.table["first", ""] = len(self.added)
        self.flat = np.array(list(self.added.values()), np.int32)
        self.first = np.arange(len(self.added) + 1)
        self.size = np.array([1] * len(self.added) + [0], np.int64)
        self.odd = np.zeros(len(self.added) + 1, bool)

    def pieces_in(self, text: str) -> list:
        """Keys of the pre-tokenizer's pieces of the whole text; for unusual white space."""
        out: list = []
        for part in self.cut.split(text) if self.added else [text]:
            out += [("added", part)] if part in self.added else [("piece", p) for p in self.pieces(part)]
        return out

    def codes(self, flat: list, distinct: bool = False) -> np.ndarray:
        """Codes of the keys; new ones are learned first (``distinct``: no key stands twice)."""
        got = np.fromiter(map(self.table.__getitem__, flat), np.int64, len(flat))
        new = np.flatnonzero(got < 0)
        if len(new):
            keys = list(map(flat.__getitem__, new.tolist()))
            at = len(self.table)
            self.learn(keys if distinct else list(dict.fromkeys(keys)))
            got[new] = np.arange(at, at + len(new)) if distinct else list(map(self.table.__getitem__, keys))
        return got

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and the number of ids of each.

        Arrow cuts the texts at blanks and finds the distinct words; only those are looked up.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self.table) > self.max_words:
            self.start_table()
        cut = pc.split_pattern(texts, " ")
        starts, words = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
        coded = words.dictionary_encode()
        codes = self.codes(strings(coded.dictionary), distinct=True)[coded.indices.to_numpy()]
        firsts = [("first", w) for w in strings(words.take(pa.array(starts[:-1])))]
        codes[starts[:-1]] = self.codes(firsts)
        again = np.zeros(len(texts), bool)
        for a in self.added:
            again |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        again[np.searchsorted(starts, np.flatnonzero(self.odd[codes]), side="right") - 1] = True
        if again.any():
            rows = np.split(codes, starts[1:-1])
            for k in np.flatnonzero(again).tolist():
                rows[k] = self.codes(self.pieces_in(texts[k].as_py()))
            codes, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        ends = np.concatenate(([0], np.cumsum(self.size[codes])))
        return gather(self.flat, self.first, self.size, codes), np.diff(ends[starts])


def has_space(words: list[str]) -> np.ndarray:
    """Which words hold white space but for one blank before them."""
    return pc.match_substring_regex(pa.array(words, pa.string()), _SPACED).to_numpy(zero_copy_only=False) \
        if words else np.zeros(0, bool)


def strings(words: pa.Array) -> list[str]:
    """The same as ``to_pylist``, without an Arrow scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


class _Codes(dict):
    def __missing__(self, key) -> int:
        return -1


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices flat[first[c]:first[c] + size[c]] of all codes, one after another."""
    return flat[ranges(first[codes], size[codes])]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[k] ... first[k] + n[k] - 1 of all k, one after another."""
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    return np.arange(total) + np.repeat(first - (upto - n), n)


def encode_rows(batches: Iterator[pa.RecordBatch], encoder: WordTable, id_at: int = 0, text_at: int = 1):
    """Yields (ids column, token ids of all texts, number of each) for chunks of rows.

    A chunk is a few Arrow batches, of ``CHUNK_CHARS`` bytes of text or the
    batch that passes them, so memory is bounded by that and the longest text.
    """
    held, size = [], 0

    def flush():
        texts = pa.chunked_array([b.column(text_at) for b in held]).combine_chunks()
        return [k for b in held for k in b.column(id_at).to_pylist()], *encoder.encode_batch(texts)
    gc.disable()      # millions of short-lived strings and no cycles
    try:
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(text_at).nbytes
            if size >= CHUNK_CHARS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    finally:
        gc.enable()
