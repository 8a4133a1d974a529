"""Byte-level BPE by a pair occurrence index.

For the distinct pieces of a partition's texts, all symbols stand in one array
with links to their neighbours.  The index maps each mergeable pair (by rank)
to the positions where it occurs.  Active ranks are taken in ascending order;
all occurrences of a rank are merged at once, and the pairs that the merge
makes or breaks update the lists concerned.  A merged symbol's own pairs have
higher ranks than the merge that made it, so one ascending pass is the same
as merging the lowest pair of every piece again and again.

Words repeat, so each Python worker keeps a bounded table of encoded words
(``word_table``); the index runs over a chunk's distinct new words.

A null text is empty: no ids, and it decodes to the empty text.  Strings of
added tokens inside a text become their id, as the tokenizers library does.
Very long pieces cost time in proportion to their length, a very long text is
a chunk of its own; repeated rows and extra columns have no effect; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockspark.llm.common import pa_schema, prepare
from stockspark.llm.word_table import WordTable, encode_rows, gather

def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


# FIXED VALUE: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairIndexBPE(WordTable):
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""
    _kept: dict = {}

    def __init__(self, path: str, max_words: int = 300_000):
        import regex
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE file")
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = model["vocab"]
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: t.encode() for t, i in added.items()})
        self.byte_ids = np.array([vocab[c] for c in byte_chars()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        super().__init__(added, regex.compile(PATTERN).findall, max_words)

    @classmethod
    def of(cls, path: str) -> "PairIndexBPE":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(sizes.sum())
        owner = np.repeat(np.arange(len(pieces)), sizes)
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.arange(1, total + 1)
        prv = np.arange(-1, total - 1)
        starts = np.cumsum(sizes) - sizes
        full = sizes > 0
        nxt[(starts + sizes - 1)[full]] = total       # `total` is the end mark on either side
        prv[starts[full]] = total
        nxt = np.append(nxt, total)
        prv = np.append(prv, total)
        sym = np.append(sym, -1)
        alive = np.ones(total + 1, bool)
        alive[total] = False
        index: dict[int, list] = {}
        active: list[int] = []

        def add(pos: np.ndarray) -> None:
            pos = pos[nxt[pos] < total]
            if not len(pos):
                return
            rank = self.ranks(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            by = np.argsort(rank, kind="stable")
            pos, rank = pos[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else [], np.split(pos, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(active, r)

        add(np.arange(total))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            pos = pos[alive[pos] & (sym[pos] == a)]
            pos = pos[sym[nxt[pos]] == b]
            if a == b and len(pos) > 1:               # a run a a a: pairs overlap, the left ones win
                chained = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.made[r]
            alive[gone] = False
            nxt[pos] = after
            inner = after < total
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            add(np.unique(np.concatenate((pos, before[before < total]))))
        left = np.flatnonzero(alive)
        return sym[left], np.bincount(owner[left], minlength=len(pieces))

    def encode_new(self, words: list[str], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = [(w,) if (w[1:] if w[0] == " " else w).isalpha() else tuple(self.pieces(w)) for w in words]
        flat = list(chain.from_iterable(cut))
        code = {p: k for k, p in enumerate(dict.fromkeys(flat))}
        ids, counts = self.merge_all([p.encode() for p in code])
        of = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, cut), np.int64, len(cut)))
        n = np.bincount(owner, weights=counts[of], minlength=len(words)).astype(np.int64)
        return gather(ids, np.cumsum(counts) - counts, counts, of), n

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: n_tokens and digests of the ids and of the decoded text; the ids themselves on request."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" \
        + (", ids array<int>, decoded string" if with_ids else "")
    out = pa_schema(spark, schema)

    def run(batches):
        bpe = PairIndexBPE.of(path)
        names = [str(i) for i in range(max(bpe.token_bytes) + 1)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for keys, flat, sizes in encode_rows(batches, bpe):
            cols: dict = {f.name: [] for f in out}
            at = 0
            for key, n in zip(keys, sizes.tolist()):
                ids = flat[at:at + n].tolist()
                at += n
                text = bpe.decode(ids)
                cols[id_col].append(key)
                cols["n_tokens"].append(n)
                cols["ids_sha256"].append(sha(",".join(map(names.__getitem__, ids)).encode()))
                cols["decoded_sha256"].append(sha(text.encode()))
                if with_ids:
                    cols["ids"].append(ids)
                    cols["decoded"].append(text)
            yield pa.RecordBatch.from_pydict(cols, schema=out)
    return docs.select(id_col, "text").mapInArrow(run, schema)
