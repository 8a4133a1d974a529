"""N-gram language model scoring over Elias-Fano tries.

Counts cover the whole training fold.  Documents are cut into blocks; a block
sends its distinct n-grams of each order (64-bit keys and its own training
counts) to hash shards, which answer with the counts over all blocks
(``blocks``).  With them each block builds the part of the model that its
texts can ask for, as a trie in a memory-mapped file: per order the word ids
of each context's successors as one monotone Elias-Fano sequence, Elias-Fano
pointers to the successors, and probabilities and back-off weights quantised
to 16 bits.  A query finds a context's range through the pointers and the
word by a successor search relative to it.

Smoothing: p1(w) = (c + 0.5) / (N + 0.5 (V + 1)); with a context h,
p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu), h' without h's first word.  N-grams that the training
fold lacks are not stored; they cost the context's weight mu / (c(h) + mu).

A null text is empty: its end token only.  A null doc_id is in no fold and is
trained on.  Repeated rows count as often as they occur.  A very long text is
a block of its own; an empty table gives no rows; columns other than doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.blocks import NULL_ID, cut_blocks
from stockspark.llm.common import fold_of, pa_schema, prepare, sized_buckets, staged
from stockspark.llm.packed import SLICES, deal_counts, sum_counts, sums_of

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK_BYTES = 4 << 20
KEYS_PER_SHARD = 1_000_000
MU = 8.0
STEPS_PER_UNIT = 2000        # of the quantised log10 values
# Words of equal bytes for sums inside 64-bit words.
_FIVES, _THREES, _NIBBLES, _EACH, _TOPS = (np.uint64(b * 0x0101010101010101) for b in (0x55, 0x33, 0x0F, 0x01, 0x80))
_U1, _U2, _U4, _U8, _U255 = map(np.uint64, (1, 2, 4, 8, 255))


# ------------------------------------------------------------------ Elias-Fano
class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary with a sampled directory."""

    def __init__(self, values: np.ndarray):
        v = values.astype(np.uint64)
        self.n = len(v)
        top = int(v[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        lows = v & np.uint64((1 << self.low_bits) - 1)
        bits = (lows[:, None] >> np.arange(self.low_bits, dtype=np.uint64)).astype(np.uint8) & 1 \
            if self.low_bits else np.empty((self.n, 0), np.uint8)
        self.low = np.concatenate((np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)))
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros((top >> self.low_bits) + self.n + 2, np.uint8)
        unary[high + np.arange(self.n)] = 1
        high = np.packbits(unary, bitorder="little")
        self.high = np.concatenate((high, np.zeros(-len(high) % 8, np.uint8))).view("<u8")
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64))).astype(np.uint32)

    def arrays(self) -> list:
        return [self.low, self.high, self.ones]

    def mapped(self, arrays: list) -> None:
        self.low, self.high, self.ones = arrays

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th one or zero (from 0): its word by the directory, its place by byte sums in the word."""
        before = self.ones if bit else (np.arange(len(self.ones)) * 64 - self.ones).astype(np.uint32)
        word = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = self.high[word] if bit else ~self.high[word]
        sums = bits - (bits >> _U1 & _FIVES)
        sums = (sums & _THREES) + (sums >> _U2 & _THREES)
        sums = (sums + (sums >> _U4) & _NIBBLES) * _EACH          # ones up to and with each byte
        byte = np.bitwise_count((left * _EACH | _TOPS) - sums & _TOPS).astype(np.uint64) * _U8
        left -= (sums << _U8) >> byte & _U255
        return word * 64 + byte.astype(np.int64) + _SELECT[(bits >> byte & _U255).astype(np.int64), left.astype(np.int64)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return word >> shift & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, 1) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits) | self.lows(i)).astype(np.int64)

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Index of the first element not below each target, or -1 where it isn't the target itself."""
        if not self.n:
            return np.full(len(targets), -1)
        t = targets.astype(np.uint64)
        high = (t >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.access(np.array([self.n - 1]))[0]) >> self.low_bits
        inside = high <= last
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - (h - 1), 0)
        end = self._select(h, 0) - h
        hi = end.copy()
        want = t & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):                        # successor search among the equal high parts
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            below = self.lows(mid) < want[open_]
            a, b = np.where(below, mid + 1, a), np.where(below, b, mid)
            lo[open_], hi[open_] = a, b
            open_ = open_[a < b]
        hit = inside & (lo < end)
        hit &= self.lows(np.minimum(lo, self.n - 1)) == want
        return np.where(hit, lo, -1)


def _select_table() -> np.ndarray:
    """Place of the k-th one in a byte."""
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        at = [i for i in range(8) if b >> i & 1]
        out[b, :len(at)] = at
    return out


_SELECT = _select_table()


class Trie:
    """Levels of (context entry, word) with quantised values, in a memory-mapped file.

    ``levels``: per order (context entry, word id, log10 p, log10 back-off
    weight), sorted by context and word; order 1 has context 0.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.seqs, self.pointers, plain = [], [], []
        contexts = 1
        for ctx, word, p, w in levels:
            starts = np.searchsorted(ctx, np.arange(contexts + 1))
            filled = np.flatnonzero(np.diff(starts))
            # a range's ids begin above the last value of the range before
            step = np.zeros(contexts + 1, np.int64)
            step[filled + 1] = word[starts[filled + 1] - 1] + 1
            base = np.cumsum(step)
            self.seqs.append(EliasFano(word + base[ctx]))
            self.pointers.append((EliasFano(starts), EliasFano(base)))
            plain += [_quantised(p), _quantised(w)]
            contexts = len(word)
        parts = [a for s, (x, y) in zip(self.seqs, self.pointers) for e in (s, x, y) for a in e.arrays()] + plain
        views = self._map(parts)
        at = 0
        for s, (x, y) in zip(self.seqs, self.pointers):
            for e in (s, x, y):
                e.mapped(views[at:at + 3])
                at += 3
        self.p, self.w = views[at::2], views[at + 1::2]

    @staticmethod
    def _map(parts: list) -> list:
        """Write the arrays to a file that is gone with its last mapping, and map them."""
        with tempfile.NamedTemporaryFile(delete=False) as f:
            places = []
            for a in parts:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(np.ascontiguousarray(a).tobytes())
        try:
            whole = np.memmap(f.name, np.uint8, "r") if os.path.getsize(f.name) else np.empty(0, np.uint8)
        finally:
            os.unlink(f.name)
        return [whole[at:at + a.nbytes].view(a.dtype) for at, a in zip(places, parts)]

    def find(self, level: int, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Entry of (context entry, word) at a level, or -1; a context of -1 has none."""
        known = ctx >= 0
        out = np.full(len(ctx), -1)
        if not known.any() or not self.seqs[level].n:
            return out
        starts, base = self.pointers[level]
        c = ctx[known]
        new = np.concatenate(([True], c[1:] != c[:-1]))          # equal contexts follow each other
        each, of = c[new], np.cumsum(new) - 1
        # all values before a context's range lie below its base, so a hit can only lie behind the range
        i = self.seqs[level].find(word[known] + base.access(each)[of])
        out[known] = np.where(i < starts.access(each + 1)[of], i, -1)
        return out

    def score(self, word: np.ndarray, has_before: np.ndarray, unknown: float) -> np.ndarray:
        """log10 p of each token given those before it (``has_before``: the one before is in the same text)."""
        every = np.arange(int(word.max()) + 1 if len(word) else 0)
        entry = self.find(0, np.zeros(len(every), np.int64), every)[word]
        value = np.where(entry >= 0, -self._at(self.p[0], entry), unknown)
        usable = has_before
        for level in range(1, len(self.seqs)):
            ctx = np.where(usable, np.concatenate(([-1], entry[:-1])), -1)
            # each (context, word) is searched once, in order of contexts
            asked, at = np.unique(ctx << 32 | word, return_inverse=True)
            entry = self.find(level, asked >> 32, asked & 0xFFFFFFFF)[at]
            weight = np.where(ctx >= 0, -self._at(self.w[level - 1], ctx), 0.0)
            value = np.where(entry >= 0, -self._at(self.p[level], entry), value + weight)
            usable = usable & np.concatenate(([False], usable[:-1]))
        return value

    @staticmethod
    def _at(codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        return codes[np.maximum(i, 0)].astype(np.float64) / STEPS_PER_UNIT if len(codes) else np.zeros(len(i))


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 * STEPS_PER_UNIT), 65535).astype(np.uint16)


# ------------------------------------------------------------------ the operator
def block_grams(words: list[bytes], tokens: np.ndarray, first: np.ndarray, train: np.ndarray, order: int):
    """Per order: (gram of each token or -1, sorted 64-bit keys' order, keys, training counts) of a block."""
    from xxhash import xxh3_64_intdigest
    word_key = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    gram, key, ok, out = tokens.astype(np.int64), word_key, np.ones(len(tokens), bool), []
    for k in range(order):
        if k:
            ok = ok & ~first & np.concatenate(([False], ok[:-1]))
            before = np.concatenate(([0], gram[:-1]))
            code = np.where(ok, before * len(words) + tokens, -1)
            distinct, gram = np.unique(code, return_inverse=True)
            if len(distinct) and distinct[0] == -1:
                distinct, gram = distinct[1:], gram - 1
            mixed = key[distinct // len(words)] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            mixed ^= mixed >> np.uint64(31)
            key = (mixed + word_key[distinct % len(words)]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
            gram = np.where(ok, gram, -1)
        counts = np.bincount(gram[ok & train], minlength=len(key))
        out.append((gram, key, counts))
    return out


def _distinct_keys(key: np.ndarray, counts: np.ndarray):
    """Sorted distinct keys with summed counts, and each gram's place among them."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64), at


def score_documents(docs: DataFrame, order: int = 3, held_mod: int = 5, held_is: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "block long, ids array<long>, sizes array<int>, words binary, tokens binary, n_train bigint"
    out = pa_schema(spark, schema)

    def to_blocks(batches):
        for block, ids, texts in cut_blocks(batches, BLOCK_BYTES):
            of: dict = {}
            tokens: list = []
            sizes, n_train = [], 0
            for i, t in zip(ids, texts):
                ws = t.translate(_LOWER).split()
                ws.append(b"")                      # the end token: no word is empty
                tokens.append(np.fromiter((of.setdefault(w, len(of)) for w in ws), "<u4", len(ws)))
                sizes.append(len(ws))
                n_train += len(ws) if not _held(i, held_mod, held_is) else 0
            yield pa.RecordBatch.from_pydict({
                "block": [block], "ids": [ids], "sizes": [sizes], "words": [b"\n".join(of)],
                "tokens": [np.concatenate(tokens).tobytes()], "n_train": [n_train]}, schema=out)
    blocks = sized_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                           .mapInArrow(to_blocks, schema), "block", "token_blocks", docs, "text")
    sums = blocks.agg(F.sum("n_train").alias("t"), F.sum(F.length("tokens")).alias("b")).first()
    n_all = sums["t"] or 0
    n_shards = max(1, (sums["b"] or 0) // 4 // KEYS_PER_SHARD)

    def grams_of(ids, sizes, words, raw, upto):
        sizes = np.asarray(sizes, np.int64)
        train = np.repeat([not _held(int(i), held_mod, held_is) for i in ids], sizes)
        first = np.zeros(int(sizes.sum()), bool)
        first[np.cumsum(sizes) - sizes] = True
        tokens = np.frombuffer(raw, "<u4").astype(np.int64)
        return tokens, first, block_grams(words.split(b"\n"), tokens, first, train, upto)

    def send(k):
        def run(frames):
            for rows in frames:
                for row in rows.to_dict("records"):
                    _, key, counts = grams_of(row["ids"], row["sizes"], row["words"], row["tokens"], k + 1)[2][k]
                    keys, n, _ = _distinct_keys(key, counts)
                    yield deal_counts(row["block"], keys, n, n_shards)
        return run
    answers, n_distinct = None, 0
    for k in range(order):
        got = staged(sum_counts(blocks.select("block", "ids", "sizes", "words", "tokens").mapInPandas(send(k), SLICES)),
                     f"counts-{k + 1}")
        if k == 0:
            n_distinct = got.agg(F.sum("n_keys").alias("v")).first()["v"] or 0
        got = got.select("block", "shard", "counts", F.lit(k).alias("k"))
        answers = got if answers is None else answers.unionByName(got)
    whole = n_all + 0.5 * (n_distinct + 1)
    result = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def score(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in block_rows.to_dict("records"):
            tokens, first, grams = grams_of(row["ids"], row["sizes"], row["words"], row["tokens"], order)
            counts = []
            for k, (gram, key, n) in enumerate(grams):
                keys, _, at = _distinct_keys(key, n)
                counts.append(sums_of(keys, got[got["k"] == k], n_shards)[at])
            trie = build_trie(tokens, first, [g[0] for g in grams], counts, whole)
            value = trie.score(tokens, ~first, float(np.log10(0.5 / whole)))
            c = counts[0][tokens]
            sizes = np.asarray(row["sizes"], np.int64)
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            frames.append(pd.DataFrame({
                "doc_id": pd.array([None if i == NULL_ID else i for i in row["ids"]], "Int64"),
                "held_out": [_held(int(i), held_mod, held_is) for i in row["ids"]],
                "n_tokens": sizes, "n_known": add((c > 0).astype(np.int64)), "train_tokens": n_all,
                "base_score": add(np.log10((c + 0.5) / whole)), "score": add(value)}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=[c.split()[0] for c in result.split(", ")])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, result)


def _held(doc_id: int, mod: int, remainder: int) -> bool:
    return doc_id != NULL_ID and fold_of(doc_id, mod) == remainder


def build_trie(tokens: np.ndarray, first: np.ndarray, grams: list, counts: list, whole: float) -> Trie:
    """The trie of a block's grams that the training fold has, from their counts over the corpus."""
    n_words = len(counts[0])
    p = (counts[0] + 0.5) / whole                       # smoothed probability of each gram of the order
    kept = np.flatnonzero(counts[0] > 0)
    entry = np.full(n_words, -1)
    entry[kept] = np.arange(len(kept))
    levels = [(np.zeros(len(kept), np.int64), kept, np.log10(p[kept]), np.log10(MU / (counts[0][kept] + MU)))]
    at_token = p[tokens]
    for k in range(1, len(grams)):
        gram, c, before = grams[k], counts[k], grams[k - 1]
        where = np.full(len(c), -1)                     # a place of each gram in the block
        pos = np.flatnonzero(gram >= 0)
        where[gram[pos]] = pos
        ctx = before[where - 1]
        c_ctx = counts[k - 1][ctx]
        p = (c + MU * at_token[where]) / (c_ctx + MU)
        kept = np.flatnonzero((c > 0) & (entry[ctx] >= 0))
        by = kept[np.lexsort((tokens[where[kept]], entry[ctx[kept]]))]
        levels.append((entry[ctx[by]], tokens[where[by]], np.log10(p[by]), np.log10(MU / (c[by] + MU))))
        entry = np.full(len(c), -1)
        entry[by] = np.arange(len(by))
        at_token = at_token.copy()
        at_token[pos] = p[gram[pos]]
    return Trie(levels)
