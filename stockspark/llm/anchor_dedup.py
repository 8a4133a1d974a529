"""Repeated word passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of
``(window + 1) // 2`` words; any window of ``window`` words holds one of them
whole.  The blocks are the index, and every rolling run of that many words of
every document probes it.  A hit is extended: the windows of ``window`` words
around the anchor are compared by 96-bit digests with all others around hit
anchors, and the smallest (doc_id, position) at which a window starts is its
source.  Windows that follow one another in document and source join to a
maximal exact repeat.

The exchange works on runs of whole documents (``blocks.cut_blocks``).  A run
deals its distinct keys to hash shards as packed arrays and gets its answers
back by (shard, run), so a passage that a third of all documents hold costs
one entry a run, and no pair of documents is ever formed.  There are three:
digests of whole documents (later copies take no further part, since all
their windows start in the first), anchors (48 bits, an answer of one bit: the
key is a reference block elsewhere, or one here that is probed elsewhere),
and windows around hits (their first source).

A null text has no words.  A null doc_id orders before all others.  Rows that
share a doc_id remove nothing from each other: only smaller ids count.  A very
long text is one run of its own.  An empty table gives no rows; columns other
than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.blocks import NULL_ID, cut_blocks
from stockspark.llm.common import pa_schema, prepare, sized_buckets, staged
from stockspark.llm.packed import deal_slices, pack_bits, planes, shard_cuts, unpack_bits, unplanes

RUN_BYTES = 4 << 20
KEYS_PER_SHARD = 1_000_000
COPY, ANCHOR, WINDOW = range(3)
#: ``tokens``: places in ``words`` (joined by blanks); ``whole``: a digest of each document's word sequence.
BLOCKS = "block long, ids array<long>, sizes array<long>, words binary, tokens binary, whole binary"
#: Packed keys of one run for one shard; ``own``: reference-block bits of anchors, first (doc, position) of windows.
SENT = "shard long, block long, keys binary, own binary"
ANSWERED = "kind int, shard long, block long, bits binary, found binary"
FIRST = np.dtype([("doc", "<i8"), ("pos", "<i4")])
DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


# ------------------------------------------------------------------ words and hashes of a run
def _run_row(block: int, ids, texts) -> dict:
    """Words of a run of documents, numbered by first occurrence."""
    of: dict = {}
    sizes, tokens, whole = [], [], np.zeros(len(ids), DIGEST)
    for k, t in enumerate(texts):
        ws = t.split()
        sizes.append(len(ws))
        tokens.append(np.fromiter((of.setdefault(w, len(of)) for w in ws), "<u4", len(ws)))
        x = xxhash.xxh3_128_intdigest(b" ".join(ws))
        whole[k] = (x & 0xFFFFFFFFFFFFFFFF, x >> 64 & 0xFFFFFFFF)
    return {"block": [block], "ids": [ids], "sizes": [sizes], "words": [b" ".join(of)],
            "tokens": [np.concatenate(tokens).tobytes()], "whole": [whole.tobytes()]}


class Run:
    """Words of consecutive documents as hashes, with the places of windows and anchors."""

    def __init__(self, row: dict, window: int):
        self.window, self.anchor, self.block = window, (window + 1) // 2, row["block"]
        self.ids, self.sizes = np.asarray(row["ids"], np.int64), np.asarray(row["sizes"], np.int64)
        self.whole = np.frombuffer(row["whole"], DIGEST)
        self.words, self.tokens = row["words"].split(), np.frombuffer(row["tokens"], "<u4")
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").astype(np.uint64)
        self.h1, self.h2 = both[0::2][self.tokens], both[1::2][self.tokens]
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)      # of each word
        self.pos = np.arange(len(self.tokens)) - self.starts[self.doc]
        self.left = self.sizes[self.doc] - self.pos                     # words from here to the end

    def rolling(self, h: np.ndarray, n: int, mult: np.uint64) -> np.ndarray:
        """Hash of the ``n`` words from each place (the last n - 1 places have none)."""
        out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n if len(out) else 0):
            out = out * mult + h[k:k + len(out)]
        out ^= out >> np.uint64(32)
        out *= _M3
        out ^= out >> np.uint64(29)
        return np.concatenate((out, np.zeros(len(h) - len(out), np.uint64)))

    def fresh(self, copy: np.ndarray) -> np.ndarray:
        """Words of documents that hold a window and are no copies."""
        return np.repeat((self.sizes >= self.window) & ~copy, self.sizes)

    def anchors(self, copy: np.ndarray):
        """Distinct 48-bit keys of all rolling anchors, their places, and which are reference blocks."""
        places = np.flatnonzero(self.fresh(copy) & (self.left >= self.anchor))
        keys, at = np.unique(self.rolling(self.h1, self.anchor, _M1)[places] >> np.uint64(16), return_inverse=True)
        fixed = np.zeros(len(keys), bool)
        fixed[at[self.pos[places] % self.anchor == 0]] = True
        return keys, places, at, fixed

    def windows(self, copy: np.ndarray, live: np.ndarray, anchors):
        """Places of windows that hold a live anchor, and their digests."""
        keys, places, at, fixed = anchors
        hit = np.zeros(len(self.doc) + self.window, np.int64)
        local = live | ((np.bincount(at, minlength=len(keys)) > 1) & fixed)
        hit[places[local[at]]] = 1
        sums = np.concatenate(([0], np.cumsum(hit)))
        reach = self.window - self.anchor + 1
        near = sums[reach:reach + len(self.doc)] > sums[:len(self.doc)]
        at = np.flatnonzero(near & self.fresh(copy) & (self.left >= self.window))
        out = np.zeros(len(at), DIGEST)
        out["a"] = self.rolling(self.h1, self.window, _M2)[at]
        out["b"] = self.rolling(self.h2, self.window, _M1)[at] >> np.uint64(32)
        return at, out

    def firsts(self, docs: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), FIRST)
        out["doc"], out["pos"] = self.ids[docs], pos
        return out


def _first_of(digests: np.ndarray, firsts: np.ndarray):
    """Distinct digests in order, the smallest (doc, pos) of each, and each entry's place among them."""
    by = np.lexsort((firsts["pos"], firsts["doc"], digests["b"], digests["a"]))
    d = digests[by]
    new = np.ones(len(d), bool)
    new[1:] = (d["a"][1:] != d["a"][:-1]) | (d["b"][1:] != d["b"][:-1])
    at = np.empty(len(d), np.int64)
    at[by] = np.cumsum(new) - 1
    return d[new], firsts[by][new], at


def _deal_digests(block: int, digests, firsts, n_shards: int) -> pd.DataFrame:
    d, f, _ = _first_of(digests, firsts)
    return deal_slices(block, d["a"] >> np.uint64(32), lambda a, b: planes(d[a:b]), lambda a, b: planes(f[a:b]), n_shards)


# ------------------------------------------------------------------ shards
def _answer_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [unplanes(k, "<u8", 6) for k in rows["keys"]]
    fixed = np.concatenate([unpack_bits(o, len(k)) for o, k in zip(rows["own"], keys)])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    runs, refs = np.bincount(at), np.bincount(at, weights=fixed)
    live = (refs[at] > fixed) | (fixed & (runs[at] > 1))
    cuts = np.cumsum(list(map(len, keys)))[:-1]
    return pd.DataFrame({"kind": ANCHOR, "shard": rows["shard"], "block": rows["block"],
                         "bits": [pack_bits(x) for x in np.split(live, cuts)], "found": b""})


def _answer_digests(kind: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unplanes(k, DIGEST) for k in rows["keys"]]
        own = np.concatenate([unplanes(o, FIRST) for o in rows["own"]])
        _, first, at = _first_of(np.concatenate(keys), own)
        found = first[at]
        earlier = found["doc"] < own["doc"]
        bits, packed, lo = [], [], 0
        for k in keys:
            part = earlier[lo:lo + len(k)]
            bits.append(pack_bits(part))
            packed.append(planes(found[lo:lo + len(k)][part]))
            lo += len(k)
        return pd.DataFrame({"kind": kind, "shard": rows["shard"], "block": rows["block"], "bits": bits, "found": packed})
    return run


def _answered(got: pd.DataFrame, kind: int, high: np.ndarray, n_shards: int):
    """Bits of a run's sorted keys, and the sources of those that are set."""
    cuts = shard_cuts(high, n_shards)
    rows = got[got["kind"] == kind].sort_values("shard")
    bits = np.zeros(len(high), bool)
    for s, b in zip(rows["shard"], rows["bits"]):
        bits[cuts[s]:cuts[s + 1]] = unpack_bits(b, cuts[s + 1] - cuts[s])
    found = [unplanes(f, FIRST) for f in rows["found"] if f]
    return bits, np.concatenate(found) if found else np.zeros(0, FIRST)


def _sources(digests, firsts, got: pd.DataFrame, kind: int, n_shards: int) -> np.ndarray:
    """The smallest (doc, pos) in the corpus of each digest of a run."""
    d, f, at = _first_of(digests, firsts)
    bits, found = _answered(got, kind, d["a"] >> np.uint64(32), n_shards)
    f = f.copy()
    f[bits] = found
    return f[at]


# ------------------------------------------------------------------ the operator
def find_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, repeats (and kept_text).

    ``repeats`` are maximal exact repeats, (start, n_words, source, source_start), in words; they may overlap
    where one source ends and the next has begun before.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = pa_schema(spark, BLOCKS)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def to_runs(batches):
        for block, ids, texts in cut_blocks(batches, RUN_BYTES):
            yield pa.RecordBatch.from_pydict(_run_row(block, ids, texts), schema=out)
    runs = sized_buckets(src.mapInArrow(to_runs, BLOCKS), "block", "anchor_runs", src, "text")
    n_words = runs.agg(F.sum(F.length("tokens")).alias("n")).first()["n"] or 0
    n_shards = max(1, -(-n_words // (4 * KEYS_PER_SHARD)))

    def copies(run: Run, got) -> tuple:
        first = _sources(run.whole, run.firsts(np.arange(len(run.ids)), 0), got, COPY, n_shards)
        return first["doc"] < run.ids, first

    def hits(run: Run, got, copy):
        anchors = run.anchors(copy)
        live, _ = _answered(got, ANCHOR, anchors[0] >> np.uint64(16), n_shards)
        return run.windows(copy, live, anchors)

    def send_copies(frames):
        for rows in frames:
            for block, ids, whole in zip(rows["block"], rows["ids"], rows["whole"]):
                firsts = np.zeros(len(ids), FIRST)
                firsts["doc"] = ids
                yield _deal_digests(block, np.frombuffer(whole, DIGEST), firsts, n_shards)

    def send_anchors(rows, got):
        for r in _runs_of(rows, window):
            keys, _, _, fixed = r.anchors(copies(r, got)[0])
            return deal_slices(r.block, keys >> np.uint64(16), lambda a, b: planes(keys[a:b], 6),
                         lambda a, b: pack_bits(fixed[a:b]), n_shards)
        return pd.DataFrame(columns=[c.split()[0] for c in SENT.split(", ")])

    def send_windows(rows, got):
        for r in _runs_of(rows, window):
            at, digests = hits(r, got, copies(r, got)[0])
            return _deal_digests(r.block, digests, r.firsts(r.doc[at], r.pos[at]), n_shards)
        return pd.DataFrame(columns=[c.split()[0] for c in SENT.split(", ")])

    def cut(rows, got):
        for r in _runs_of(rows, window):
            copy, first = copies(r, got)
            at, digests = hits(r, got, copy)
            source = _sources(digests, r.firsts(r.doc[at], r.pos[at]), got, WINDOW, n_shards)
            again = source["doc"] < r.ids[r.doc[at]]
            return _cut(r, at[again], source[again], copy, first, window, with_text)
        return pd.DataFrame(columns=[c.split()[0] for c in SENT.split(", ")])

    def exchange(sent, answer, name):
        return staged(sent.groupBy("shard").applyInPandas(answer, ANSWERED), f"anchor-{name}")

    def with_answers(got, fn, schema):
        return runs.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(fn, schema)

    got = exchange(runs.select("block", "ids", "whole").mapInPandas(send_copies, SENT), _answer_digests(COPY), "copies")
    got = got.unionByName(exchange(with_answers(got, send_anchors, SENT), _answer_anchors, "anchors"))
    got = got.unionByName(exchange(with_answers(got, send_windows, SENT), _answer_digests(WINDOW), "windows"))
    result = ("doc_id long, n_words long, n_removed long, kept_sha256 string, "
              "repeats array<struct<start:long,n_words:long,source:long,source_start:long>>")
    return with_answers(got, cut, result + (", kept_text string" if with_text else ""))


def _runs_of(rows: pd.DataFrame, window: int):
    return (Run(row, window) for row in rows.to_dict("records"))


def _cut(r: Run, at, source, copy, first, window: int, with_text: bool) -> pd.DataFrame:
    """Rows of the operator for the documents of a run."""
    # windows that follow one another in document and source are one repeat
    new = np.ones(len(at), bool)
    new[1:] = ((np.diff(at) != 1) | (r.doc[at][1:] != r.doc[at][:-1]) | (source["doc"][1:] != source["doc"][:-1])
               | (source["pos"][1:] != source["pos"][:-1] + 1))
    lead = np.flatnonzero(new)
    length = np.diff(np.append(lead, len(at))) + window - 1
    covered = np.zeros(len(r.doc) + 1, np.int64)
    np.add.at(covered, at[lead], 1)
    np.add.at(covered, at[lead] + length, -1)
    gone = np.cumsum(covered[:-1]) > 0
    gone |= np.repeat(copy & (r.sizes >= window), r.sizes)
    repeats: list = [[] for _ in r.ids]
    for k, n in zip(lead, length):
        s = at[k]
        repeats[r.doc[s]].append((int(r.pos[s]), int(n), _id(source["doc"][k]), int(source["pos"][k])))
    for d in np.flatnonzero(copy & (r.sizes >= window)):
        repeats[d] = [(0, int(r.sizes[d]), _id(first["doc"][d]), 0)]
    rows = []
    for d, i in enumerate(r.ids):
        part = gone[r.starts[d]:r.ends[d]]
        n = int(part.sum())
        kept = b" ".join([r.words[t] for t in r.tokens[r.starts[d]:r.ends[d]][~part].tolist()])
        rows.append((_id(i), len(part), n, hashlib.sha256(kept).hexdigest(), repeats[d],
                     *([kept.decode("utf-8", "replace")] if with_text else [])))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *(["kept_text"] if with_text else [])]
    frame = pd.DataFrame(rows, columns=names)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _id(x):
    return None if x == NULL_ID else int(x)
