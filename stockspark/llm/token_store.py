"""Token ids in files of static range-ANS blocks.

One frequency table, counted over the whole corpus, is shared by all blocks.
A block holds whole documents (at least ``BLOCK_TOKENS`` ids unless it is a
partition's last); its ids go round ``LANES`` interleaved coder states.  Each
block stands alone: header, documents, lane states, checkpoints (stream
position and all states every ``CHECK_STEPS`` steps, from which decoders can
start in parallel), the code words, and a crc32 over all of that.

Files are Parquet parts with one block a row, written by Spark's committer
into the shared folder, ranges of ascending doc_id by part; a manifest has the
ids before each part.  A null text is empty and has the end id only.  Null
doc_ids come first; rows with the same doc_id follow each other.  A very long
text is in one block, which it may fill alone; an empty table gives no files
with blocks and no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.bpe_index import PATTERN
from stockspark.llm.common import pa_schema, prepare, staged_path
from stockspark.llm.word_table import WordTable, encode_rows, gather

PRECISION = 20                # frequencies add up to 2^20
LOW = np.uint64(1 << 31)      # states stay in [2^31, 2^63)
LANES = 4096
CHECK_STEPS = 128
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 24
_HEAD = struct.Struct("<4sHHIIIII")   # magic, version, lanes, ids, documents, checkpoints, words, crc32


class LibraryBPE(WordTable):
    """Ids as the tokenizers library gives them, asked once for each distinct piece of the pre-tokenizer.

    The model of the library encodes a piece; what the pre-tokenizer does
    before that (cut by ``PATTERN``, bytes as characters) is done here, for
    whole words at once where a word is letters with at most some marks
    behind.  Each worker keeps the pieces it has met, up to ``max_pieces``.
    """
    _kept: dict = {}

    def __init__(self, path: str, max_words: int = 500_000, max_pieces: int = 600_000):
        import regex
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.max_pieces = max_pieces
        self.as_bytes = _byte_characters()
        super().__init__({t.content: i for i, t in self.lib.get_added_tokens_decoder().items()},
                         regex.compile(PATTERN).findall, max_words)

    @classmethod
    def of(cls, path: str) -> "LibraryBPE":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def start_table(self) -> None:
        super().start_table()
        if not hasattr(self, "known") or len(self.known) > self.max_pieces:
            self.known: dict = {}
            self.piece_ids, self.piece_size = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode_new(self, words: list[str], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, n_cut = self.piece_codes(words, spaced)
        size = self.piece_size
        counts = np.bincount(np.repeat(np.arange(len(words)), n_cut), weights=size[codes], minlength=len(words))
        return gather(self.piece_ids, np.cumsum(size) - size, size, codes), counts.astype(np.int64)

    def piece_codes(self, words: list[str], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all words, new ones encoded, and the number of each word's pieces."""
        known = self.known
        get, before = known.get, len(known)
        cut: list = []
        add = cut.append
        n_cut = np.ones(len(words), np.int64)
        for k, (w, s) in enumerate(zip(words, spaced.tolist())):
            if not s and w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
                at = get(w)                          # a word of letters is one piece
                if at is None:
                    at = known[w] = len(known)
                add(at)
                continue
            head = w.rstrip(_MARKS)
            if not s and head[1:].isalpha() and (head[0] == " " or head[0].isalpha()):
                parts = (head, w[len(head):])
            else:
                parts = self.pieces(w)
            n_cut[k] = len(parts)
            for p in parts:
                at = get(p)
                if at is None:
                    at = known[p] = len(known)
                add(at)
        fresh = list(known)[before:]
        if fresh:
            tokenize, table = self.model.tokenize, self.as_bytes
            shown = ["\u0120" + p[1:] if p[0] == " " and p[1:].isalnum() and p.isascii() else
                     p.encode().decode("latin-1").translate(table) for p in fresh]
            ids = [[t.id for t in tokenize(p)] for p in shown]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
            self.piece_ids = np.concatenate((self.piece_ids, flat))
            self.piece_size = np.concatenate((self.piece_size, size))
        return np.array(cut, np.int64), n_cut


#: Marks that the pre-tokenizer takes as one piece behind letters; no apostrophe, which may begin an ending.
_MARKS = ".,;:!?\"()[]{}…»”-–—/*#$%&|<>=+@^~_`"


def _byte_characters() -> dict:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the
    next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Tables:
    """Frequencies scaled to 2^PRECISION, their cumulated sums and the slot table."""

    def __init__(self, counts: np.ndarray):
        total, size = int(counts.sum()), 1 << PRECISION
        if (counts > 0).sum() > size:
            raise ValueError("more symbols than slots")
        freq = np.where(counts > 0, np.maximum(1, counts * (size / max(total, 1))).astype(np.int64), 0)
        while (over := int(freq.sum()) - size) != 0 and total:
            if over < 0:
                freq[int(freq.argmax())] -= over
            else:                                   # take it from the large ones, each down to 1 at most
                big = np.argsort(-freq, kind="stable")[:max(1, over)]
                cut = np.minimum(np.maximum(freq[big] // 8, 1), freq[big] - 1)
                cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
                freq[big] -= cut
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, docs: list, sizes: list, tables: Tables) -> bytes:
    """One block: ``ids`` of the documents ``docs`` (integer ids or None) with ``sizes`` ids each."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    out, checkpoints, n_words = [], [], 0
    for t in range(steps - 1, -1, -1):
        sym = ids[t * LANES:(t + 1) * LANES]
        k = len(sym)
        f, x = tables.freq[sym], state[:k]
        full = x >= f << np.uint64(63 - PRECISION)
        if full.any():
            w = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            out.append(w)
            n_words += len(w)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:k] = (q << np.uint64(PRECISION)) + (x - q * f) + tables.cum[sym]
        if t % CHECK_STEPS == 0:
            checkpoints.append((n_words, state.copy()))
    checkpoints.reverse()
    body = b"".join((
        np.array([d is not None for d in docs], np.uint8).tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(),
        np.array([n_words - n for n, _ in checkpoints], "<u4").tobytes(),
        *(s.astype("<u8").tobytes() for _, s in checkpoints), *(w.tobytes() for w in reversed(out))))
    head = (b"RANS", 1, LANES, len(ids), len(docs), len(checkpoints), n_words)
    return _HEAD.pack(*head, zlib.crc32(body)) + body


class Block:
    """A block read back; ``ids`` decodes all of it or the steps of some checkpoints."""

    def __init__(self, data: bytes):
        magic, version, self.lanes, self.n, n_docs, n_checks, n_words, crc = _HEAD.unpack_from(data)
        if magic != b"RANS" or version != 1:
            raise ValueError("not a token block")
        if zlib.crc32(memoryview(data)[_HEAD.size:]) != crc:
            raise ValueError("token block is damaged: its checksum differs")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got
        known = take("u1", n_docs)
        self.docs = [int(d) if k else None for d, k in zip(take("<i8", n_docs), known)]
        self.sizes = take("<u4", n_docs).astype(np.int64)
        self.at = take("<u4", n_checks)
        self.states = take("<u8", n_checks * self.lanes).reshape(n_checks, self.lanes)
        self.words = take("<u4", n_words)

    def ids(self, tables: Tables, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last`` (None: the end)."""
        last = len(self.at) if last is None else last
        lo, hi = first * CHECK_STEPS * self.lanes, min(self.n, last * CHECK_STEPS * self.lanes)
        out = np.empty(max(0, hi - lo), np.uint32)
        if not len(out):
            return out
        state, pos = self.states[first].astype(np.uint64), int(self.at[first])
        mask = np.uint64((1 << PRECISION) - 1)
        for a in range(lo, hi, self.lanes):
            k = min(self.lanes, self.n - a)
            x = state[:k]
            slot = x & mask
            sym = tables.slots[slot]
            out[a - lo:a - lo + k] = sym
            x = tables.freq[sym] * (x >> np.uint64(PRECISION)) + slot - tables.cum[sym]
            low = x < LOW
            n = int(low.sum())
            if n:
                x[low] = (x[low] << np.uint64(32)) | self.words[pos:pos + n]
                pos += n
            state[:k] = x
        return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids as little-endian 16- or 32-bit integers with the end id, their number and crc32.

    The last row of each task has no document: n_tokens is -1, and ``ids`` holds the task's count of each id as
    64-bit integers.
    """
    schema = "doc_id bigint, n_tokens bigint, mix bigint, ids binary"
    out = pa_schema(docs.sparkSession, schema)

    def run(batches):
        lib = LibraryBPE.of(tokenizer)
        kind = "<u2" if lib.lib.get_vocab_size() <= 1 << 16 else "<u4"
        total = np.zeros(lib.lib.get_vocab_size(), np.int64)
        for keys, flat, sizes in encode_rows(batches, lib):
            ends = np.cumsum(sizes)
            ids = np.insert(flat, ends, end_id).astype(kind)
            total += np.bincount(ids, minlength=len(total))
            cuts = (ends + np.arange(1, len(ends) + 1)).tolist()
            raw = [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "n_tokens": (sizes + 1).tolist(),
                                              "mix": list(map(zlib.crc32, raw)), "ids": raw}, schema=out)
        if total.any():
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "n_tokens": [-1], "mix": [0],
                                              "ids": [total.astype("<i8").tobytes()]}, schema=out)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0) -> dict:
    """Write the corpus; returns the paths of its blocks and manifest, and the frequency counts."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    prepare(spark)
    vocab = Tokenizer.from_file(tokenizer).get_vocab_size()
    wide = vocab > 1 << 16
    kind = "<u4" if wide else "<u2"
    stored = spark.read.parquet(staged_path(tokenized(docs, tokenizer, end_id), "ids"))
    tokens = stored.where("n_tokens >= 0")

    def count(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw, "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]},
                                         schema=pa.schema([("id", pa.int64()), ("n", pa.int64())]))
    # at most one row for each entry of the vocabulary comes to the driver
    counts = np.zeros(vocab, np.int64)
    sums = stored.where("n_tokens < 0").select("ids").mapInArrow(count, "id long, n long")
    for r in sums.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    shared = spark.sparkContext.broadcast(counts)
    n_parts = max(1, -(-int(counts.sum()) // PART_TOKENS))
    schema = "part int, block int, n_tokens bigint, data binary"
    out = pa_schema(spark, schema)

    def write(batches):
        from pyspark import TaskContext
        part, tables = TaskContext.get().partitionId(), Tables(shared.value)
        held, docs_in, sizes, n, block = [], [], [], 0, 0

        def flush():
            data = encode_block(np.concatenate(held).astype(np.int64), docs_in, sizes, tables)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "n_tokens": [n], "data": [data]},
                                              schema=out)
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), kind)
                held.append(ids)
                docs_in.append(doc)
                sizes.append(len(ids))
                n += len(ids)
                if n >= BLOCK_TOKENS:
                    yield flush()
                    held, docs_in, sizes, n, block = [], [], [], 0, block + 1
        if held:
            yield flush()
    ordered = tokens.repartitionByRange(n_parts, "doc_id", "mix").sortWithinPartitions("doc_id", "mix")
    blocks = staged_path(ordered.select("doc_id", "ids").mapInArrow(write, schema), "blocks")
    # one row a part: the manifest
    ends = spark.read.parquet(blocks).groupBy("part").agg(F.sum("n_tokens").alias("n")).sort("part").collect()
    starts, at = {}, 0
    for r in ends:
        starts[r["part"]], at = at, at + r["n"]
    return {"blocks": blocks, "starts": starts, "counts": counts, "n_tokens": at}


def read_store(spark: SparkSession, store: dict) -> DataFrame:
    """Decode all blocks: doc_id, start, n_tokens, ids_crc32, in any order.

    ``start`` needs the ids before a block within its part: a sum over the
    part's block sizes, joined back by (part, block).
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast((store["counts"], store["starts"]))
    from pyspark.sql import Window
    blocks = spark.read.parquet(store["blocks"])
    offsets = blocks.select("part", "block", (F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int"
    out = pa_schema(spark, schema)

    def run(batches):
        counts, starts = shared.value
        tables = Tables(counts)
        for b in batches:
            for part, no, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                block = Block(data)
                ids = block.ids(tables).astype("<u4")
                ends = np.cumsum(block.sizes)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), block.sizes.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": block.docs, "start": (ends - block.sizes + starts[part]).tolist(),
                    "n_tokens": block.sizes.tolist(), "ids_crc32": crc, "part": [part] * len(crc),
                    "block": [no] * len(crc)}, schema=out)
    docs = blocks.select("part", "block", "data").mapInArrow(run, schema)
    return (docs.join(offsets, ["part", "block"])
            .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
