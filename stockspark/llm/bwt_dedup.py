"""Exact removal of repeated passages by merging Burrows-Wheeler transforms.

Every byte covered by a ``length``-byte string that also starts earlier
(smaller doc_id, or earlier in the same document) is removed; strings are
judged on the input.

1. Candidates, losing none: a window's anchor is its 32-byte gram of smallest
   hash (leftmost on ties), so equal windows have equal anchors.  Windows next
   to each other with one anchor form a context, the stretch they cover.
   Anchors are counted over the corpus (``blocks``); a window whose anchor
   occurs once is no repeat.
2. Equal contexts collapse by a map-side aggregate to the earliest of them:
   the others repeat it whole.
3. What is left are anchors with several different contexts.  Contexts are
   dealt by anchor to buckets; in a bucket they fill shards, each shard gets
   its Burrows-Wheeler transform, and the transforms are merged by refining
   an interleave: it holds for each slot which shard the next suffix comes
   from, and each round extends the common prefix to the left by one symbol
   (100 bytes are four of 25) through a stable sort of the shards' preceding
   symbols.  The round in which two neighbours part gives their common prefix; slots that never part are the repeated intervals, and in
   each all windows but the earliest are marked.
   An anchor with over ``max_contexts`` different contexts would not fit a
   task; its windows are compared by 128-bit digests with map-side minima.
4. Marks go back to the blocks, which cut the bytes.

A null text is empty.  A null doc_id orders before all others; rows with the
same doc_id order by their place in the input.  Texts shorter than ``length``
never change; a very long one is a block of its own.  An empty table gives no
rows.  Extra columns are read only on request; they stay with their
row in its block, so repeated rows need no key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.blocks import NULL_ID, SENT, answer, answers_of, cut_blocks, deal
from stockspark.llm.common import pa_schema, prepare, sized_buckets, staged

GRAM = 32
SYMBOL = 32
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 1 << 18
BUCKET_BYTES = 2 << 20
KEYS_PER_SHARD = 500_000


# ------------------------------------------------------------ anchors, contexts
def _hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every GRAM-byte string."""
    h, m, w = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while w < GRAM:
        h = h[:-w] * np.uint64(m) + h[w:]
        m, w = m * m & (1 << 64) - 1, w * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def contexts(data: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each context, in order, for texts put end to end."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - length + 1
    none = np.empty(0, np.int64)
    if n < 1:
        return none.astype(np.uint64), none, none
    h = _hashes(b)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, w = length - GRAM + 1, 1
    while w * 2 <= span:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    v = np.minimum(v[:n], v[span - w:span - w + n])
    inside = np.ones(n + 1, np.int32)
    ends = np.cumsum(sizes)
    inside = np.zeros(len(b) + 1, np.int32)      # windows that leave their document
    np.add.at(inside, np.maximum(ends - length + 1, ends - sizes), 1)
    np.add.at(inside, ends, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    if not len(starts):
        return none.astype(np.uint64), none, none
    at = (v[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], cut))
    return h[at[first]], starts[first], starts[np.concatenate((cut - 1, [len(starts) - 1]))]


def context_keys(data: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())),
                       np.uint64, len(lo))


# -------------------------------------------------- Burrows-Wheeler transforms
def _radix(key: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit keys in two passes of 16 bits."""
    low = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(key) or key.max() < 1 << 16:
        return low
    return low[np.argsort((key >> 16).astype(np.uint16)[low], kind="stable")]


def _rounds(length: int) -> list[int]:
    """Bytes by which each round extends the common prefix: the same for all where a divisor of ``length`` fits."""
    even = max(w for w in range(1, SYMBOL + 1) if length % w == 0)
    if even >= 8:
        return [even] * (length // even)
    return ([length % SYMBOL] if length % SYMBOL else []) + [SYMBOL] * (length // SYMBOL)


def _leading(text: np.ndarray, width: int) -> np.ndarray:
    """The up to eight bytes at each position of a cyclic text, as a big-endian number."""
    wide = np.concatenate((text, np.resize(text, width))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(width):
        out = out << np.uint64(8) | wide[k:k + len(text)]
    return out


def _dense(shards: list[np.ndarray], in_order: bool) -> list[np.ndarray]:
    """Small numbers for equal values, in the values' order or in any (hashing, not sorting)."""
    flat = np.concatenate(shards)
    rank = np.unique(flat, return_inverse=True)[1] if in_order else pd.factorize(flat)[0]
    return np.split(rank, np.cumsum([len(s) for s in shards])[:-1])


def symbols(shards: list[np.ndarray], widths: list[int], in_order: bool = True) -> dict[int, list[np.ndarray]]:
    """For each width, the rank of the string at each position of the cyclic shards among those of all shards.

    ``in_order``: ranks in the strings' order, so that suffixes come out sorted.  To find equal ones any order will
    do where all symbols have one width; with several, a round may see the beginning of a symbol only.
    """
    out, have, ranks = {}, 0, []
    in_order |= len(set(widths)) > 1
    for width in sorted(set(widths)):
        if width <= 4:
            out[width] = [_leading(s, width).astype(np.uint32) for s in shards]
            continue
        if not have:
            have = min(8, width)
            ranks = _dense([_leading(s, have) for s in shards], in_order)
        while have < width:                  # two ranks side by side, overlapping where they must
            step = min(have, width - have)
            ranks = _dense([r.astype(np.uint64) << np.uint64(32) | np.roll(r, -step).astype(np.uint64) for r in ranks],
                           in_order)
            have += step
        out[width] = [r.astype(np.uint32) for r in ranks]
    return out


def transform(ranks: dict[int, np.ndarray], length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """A shard's suffix order up to ``length`` bytes, and the symbols before its suffixes in that order."""
    n = len(next(iter(ranks.values())))
    order = np.arange(n)
    for step in _rounds(length):
        before = (order - step) % n
        order = before[_radix(ranks[step][before])]
    return order, {step: r[(order - step) % n] for step, r in ranks.items()}


def merge_transforms(shards: list[tuple[np.ndarray, dict]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shard transforms by interleave refinement.

    Returns the interleave (shard of each slot), each slot's interval (equal
    numbers: a common prefix of at least ``length`` bytes), and the common
    prefix with the slot before, rounded down to whole rounds.
    """
    sizes = [len(order) for order, _ in shards]
    total = sum(sizes)
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    interval = np.zeros(total, np.int64)
    depth, common, open_ = 0, np.full(total, length, np.int32), np.ones(total, bool)
    bwt = {step: np.concatenate([b[step] for _, b in shards]) for step in set(_rounds(length))}
    for step in _rounds(length):
        slot = np.empty(total, np.int64)
        slot[np.argsort(z, kind="stable")] = np.arange(total)    # the k-th slot of a shard is its k-th suffix
        key = bwt[step][slot]
        by = _radix(key)
        z, key, interval = z[by], key[by], interval[by]
        parted = np.ones(total, bool)
        parted[1:] = (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(parted) - 1
        common[parted & open_] = depth       # a border between slots stays where it is
        open_ &= ~parted
        depth += step
    return z, interval, common


def mark_bucket(texts: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For texts in order of place: which windows start a string that also starts earlier among them."""
    shards, owners, held, owner, size = [], [], [], [], 0
    pad = bytes(8)       # no window reaches it

    def close():
        shards.append(np.frombuffer(b"".join(held), np.uint8))
        owners.append(np.concatenate(owner))
    for k, t in enumerate(texts):
        if held and size + len(t) + 8 > shard_bytes:
            close()
            held, owner, size = [], [], 0
        held.append(t + pad)
        windows = len(t) - length + 1
        # place of each position: text and offset, or -1 where no whole window starts
        owner.append(np.concatenate((k * (1 << 32) + np.arange(windows), np.full(len(t) + 8 - windows, -1))))
        size += len(t) + 8
    if held:
        close()
    if not shards:
        return []
    by_step = symbols(shards, _rounds(length), in_order=False)
    built = [transform({s: r[k] for s, r in by_step.items()}, length) for k in range(len(shards))]
    z, interval, _ = merge_transforms(built, length)
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate([o[order] for o, (order, _) in zip(owners, built)])
    real = place >= 0
    place, interval = place[real], interval[real]
    first = np.full(int(interval.max()) + 1 if len(interval) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, interval, place)
    repeat = place[place != first[interval]]
    marks = [np.zeros(len(t) - length + 1, np.uint8) for t in texts]
    repeat.sort()
    for k, part in zip(*_runs(repeat >> 32, repeat & 0xFFFFFFFF)):
        marks[k][part] = 1
    return marks


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    if not len(keys):
        return [], []
    return keys[np.concatenate(([0], cuts))].tolist(), np.split(values, cuts)


# ------------------------------------------------------------------ the operator
def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and their counts."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def _block_of(row) -> tuple[bytes, np.ndarray, np.ndarray]:
    return row["data"], np.asarray(row["sizes"], np.int64), np.asarray(row["ids"], np.int64)


def _first_of_each(anchor: np.ndarray, key: np.ndarray, ids: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes ordered by (anchor, key, place), and which of them are the first of their (anchor, key)."""
    by = np.lexsort((lo, ids, key, anchor))
    a, k = anchor[by], key[by]
    new = np.ones(len(by), bool)
    new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
    return by, new


def remove_repeats(docs: DataFrame, length: int = 100, max_contexts: int = 20_000, with_text: bool = False,
                   carry: tuple = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes); on request the kept text and other columns.

    The kept text widens what it keeps to whole characters, so it is valid
    UTF-8; the digest is of the exact remaining bytes.  It is null for a null
    text.
    """
    spark = docs.sparkSession
    prepare(spark)
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    block_schema = "block long, ids array<long>, sizes array<int>, data binary"
    with_rest = with_text or bool(carry)
    if with_rest:
        block_schema += ", rest binary"
    block_out = pa_schema(spark, block_schema)
    carried = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    rest_out = pa_schema(spark, ", ".join(("`null text` boolean", *carried)))

    def to_blocks(batches):
        rest: list = []                          # of the rows read and in no block yet

        def noted():
            for b in batches:
                if with_rest:
                    rest.extend(zip(*(b.column(k).to_pylist() for k in range(2, b.num_columns))))
                yield b
        for block, ids, texts in cut_blocks(noted(), BLOCK_BYTES):
            row = {"block": [block], "ids": [ids], "sizes": [list(map(len, texts))], "data": [b"".join(texts)]}
            if with_rest:
                row["rest"] = [_packed(rest[:len(ids)], rest_out)]
                del rest[:len(ids)]
            yield pa.RecordBatch.from_pydict(row, schema=block_out)
    others = [F.col("text").isNull().alias("null text"), *carry] if with_rest else []
    blocks = sized_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
                           .mapInArrow(to_blocks, block_schema), "block", "blocks", docs, "text")
    by_block = blocks.groupBy("block")
    total = blocks.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
    n_shards = max(1, total // ((length - GRAM) // 2 * KEYS_PER_SHARD))

    # 1. anchors seen more than once
    def send(batches):
        for b in batches:
            for block, sizes, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                anchor, _, _ = contexts(data, np.array(sizes, np.int64), length)
                keys, _, n = _counted(anchor)
                yield deal(block, keys, np.minimum(n, 2), n_shards)
    sent = blocks.select("block", "sizes", "data").mapInArrow(send, SENT)
    answers = staged(answer(sent, cap=2).select("shard", "block", "counts"), "anchor-counts")

    # 2. the different contexts of each block under such anchors
    found_schema = "block long, anchor long, key long, id long, lo long, n int"

    def find(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in block_rows.to_dict("records"):
            data, sizes, ids = _block_of(row)
            anchor, lo, hi = contexts(data, sizes, length)
            keys, at, _ = _counted(anchor)
            many = answers_of(keys, got, n_shards)[at] > 1
            anchor, lo, hi = anchor[many], lo[many], hi[many]
            key = context_keys(data, lo, hi, length)
            owner = ids[np.searchsorted(np.cumsum(sizes), lo, side="right")]
            by, new = _first_of_each(anchor, key, owner, lo)
            one = by[new]
            parts.append(pd.DataFrame({"block": row["block"], "anchor": anchor[one].view(np.int64), "id": owner[one],
                                       "key": key[one].view(np.int64), "lo": lo[one], "n": hi[one] - lo[one] + length}))
        return pd.concat(parts)[[c.split()[0] for c in found_schema.split(", ")]]
    found = staged(by_block.cogroup(answers.groupBy("block")).applyInPandas(find, found_schema), "contexts")
    first = staged(found.groupBy("anchor", "key").agg(F.min(F.struct("id", "block", "lo", "n")).alias("f"))
                   .select("anchor", "key", "f.*"), "first-contexts")

    # 3. windows repeated between different contexts of an anchor; their bytes come from their blocks
    per_anchor = staged(first.groupBy("anchor").agg(F.count("*").alias("n_keys"), F.sum("n").alias("b"))
                        .where("n_keys > 1"), "varied-anchors")
    varied = first.join(per_anchor.select("anchor", "n_keys"), "anchor")
    text_schema = "anchor long, key long, n_keys long, id long, block long, lo long, text binary"

    def fetch(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = got[["anchor", "key", "n_keys", "id", "block", "lo"]].copy()
        data = block_rows["data"].iloc[0] if len(block_rows) else b""
        out["text"] = [data[a:a + n] for a, n in zip(got["lo"], got["n"])]
        return out
    texts = by_block.cogroup(varied.groupBy("block")).applyInPandas(fetch, text_schema)
    size = per_anchor.where(F.col("n_keys") <= max_contexts).agg(F.sum("b").alias("b")).first()["b"] or 0
    n_large = per_anchor.where(F.col("n_keys") > max_contexts).count()
    n_buckets = max(1, size // BUCKET_BYTES)
    marks_schema = "anchor long, key long, marks binary"

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "block", "lo"])
        got = mark_bucket(rows["text"].tolist(), length)
        out = pd.DataFrame({"anchor": rows["anchor"], "key": rows["key"], "marks": [np.packbits(m).tobytes() for m in got]})
        return out[[bool(m.any()) for m in got]]
    if n_large:
        texts = staged(texts, "context-texts")
    marks = (texts.where(F.col("n_keys") <= max_contexts).select("anchor", "key", "id", "block", "lo", "text")
             .withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets)))
             .groupBy("bucket").applyInPandas(mark, marks_schema))
    if n_large:
        marks = marks.unionByName(_marks_of_large(texts.where(F.col("n_keys") > max_contexts), length))

    # 4. back to the blocks: contexts that are repeats as a whole, and those with marked windows
    verdicts = first.select("anchor", "key", "id", F.col("block").alias("at"), "lo").join(marks, ["anchor", "key"], "left")
    other = (F.col("f.id") != F.col("v.id")) | (F.col("f.block") != F.col("v.at")) | (F.col("f.lo") != F.col("v.lo"))
    back = (found.alias("f").join(verdicts.alias("v"), ["anchor", "key"])
            .select("block", "anchor", "key", other.alias("whole"),
                    F.when(~other, F.col("marks")).alias("marks")).where("whole OR marks IS NOT NULL"))
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<a:bigint,b:bigint>>")
    names = [s.split()[0] for s in schema.split(", ")] + (["kept_text"] if with_text else []) + list(carry)
    schema = ", ".join((schema, *(["kept_text string"] if with_text else []), *carried))

    def cut(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        parts = [_cut_block(r, got, length, with_text) for r in block_rows.to_dict("records")]
        return pd.DataFrame([x for p in parts for x in p], columns=names, dtype=object)
    return by_block.cogroup(back.groupBy("block")).applyInPandas(cut, schema)


def _marks_of_large(contexts_: DataFrame, length: int) -> DataFrame:
    """Marks of anchors with too many contexts for a task: windows compared by digest."""
    spark = contexts_.sparkSession
    schema = "anchor long, key long, id long, block long, start long, off int, w binary"
    out = pa_schema(spark, schema)

    def windows(batches):
        from xxhash import xxh3_128_digest
        for b in batches:
            for anchor, key, i, block, lo, t in zip(*(b.column(k).to_pylist() for k in range(6))):
                n = len(t) - length + 1
                yield pa.RecordBatch.from_pydict({
                    "anchor": [anchor] * n, "key": [key] * n, "id": [i] * n, "block": [block] * n,
                    "start": list(range(lo, lo + n)), "off": list(range(n)),
                    "w": [xxh3_128_digest(t[k:k + length]) for k in range(n)]}, schema=out)
    each = contexts_.select("anchor", "key", "id", "block", "lo", "text").mapInArrow(windows, schema)
    first = each.groupBy("anchor", "w").agg(F.min(F.struct("id", "block", "start")).alias("f"))
    flagged = each.join(first, ["anchor", "w"]).withColumn(
        "m", F.struct("id", "block", "start") != F.col("f"))

    def pack(rows):      # at most `length` windows a context
        for b in rows:
            a, k, offs = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_pydict({"anchor": a, "key": k, "marks": [
                np.packbits([x["m"] for x in sorted(o, key=lambda x: x["off"])]).tobytes() for o in offs]},
                schema=pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())]))
    return (flagged.groupBy("anchor", "key").agg(F.collect_list(F.struct("off", "m")).alias("o"))
            .mapInArrow(pack, "anchor long, key long, marks binary"))


def _packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    columns = zip(*rows)
    with pa.ipc.new_stream(out, schema) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(data).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _cut_block(row: dict, got: pd.DataFrame, length: int, with_text: bool) -> list[tuple]:
    data, sizes, ids = _block_of(row)
    anchor, lo, hi = contexts(data, sizes, length)
    _, at, n = _counted(anchor)
    key_a, key_k = got["anchor"].to_numpy(np.int64).view(np.uint64), got["key"].to_numpy(np.int64).view(np.uint64)
    # repeats lie under an anchor that came back or that the block holds twice
    many = (n[at] > 1) | np.isin(anchor, key_a)
    anchor, lo, hi = anchor[many], lo[many], hi[many]
    key = context_keys(data, lo, hi, length)
    owner = ids[np.searchsorted(np.cumsum(sizes), lo, side="right")]
    by, new = _first_of_each(anchor, key, owner, lo)
    place = dict(zip(zip(key_a.tolist(), key_k.tolist()), range(len(got))))
    ones = by[new]
    answer_of = np.fromiter((place.get(x, -1) for x in zip(anchor[ones].tolist(), key[ones].tolist())), np.int64, len(ones))
    repeat = ~new                            # of an earlier context of the block
    if len(got):
        repeat[new] = (answer_of >= 0) & got["whole"].to_numpy(bool)[answer_of]
    whole = by[repeat]
    diff = np.zeros(len(data) + 1, np.int32)
    np.add.at(diff, lo[whole], 1)
    np.add.at(diff, hi[whole] + length, -1)
    marks = got["marks"].to_numpy()
    for k, m in zip(ones.tolist(), answer_of.tolist()):
        if m >= 0 and isinstance(marks[m], bytes):
            starts = lo[k] + np.flatnonzero(np.unpackbits(np.frombuffer(marks[m], np.uint8))[:hi[k] - lo[k] + 1])
            np.add.at(diff, starts, 1)
            np.add.at(diff, starts + length, -1)
    gone = np.cumsum(diff[:-1]) > 0
    rest = _unpacked(row["rest"]) if "rest" in row else [()] * len(ids)
    out, end = [], 0
    for i, n, others in zip(ids.tolist(), sizes.tolist(), rest):
        a, end = end, end + n
        g = gone[a:end]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
        spans = edge.reshape(-1, 2).tolist()
        raw = data[a:end]
        keep = raw if not spans else np.frombuffer(raw, np.uint8)[~g].tobytes()
        rec = (None if i == NULL_ID else i, n, int(g.sum()), len(spans), hashlib.sha256(keep).hexdigest(),
               [{"a": x, "b": y} for x, y in spans])
        if with_text:
            rec += (None if others[0] else _whole_characters(raw, spans),)
        out.append(rec + others[1:])
    return out


def _whole_characters(raw: bytes, spans: list) -> str:
    """The text without the spans, each narrowed to whole characters."""
    parts, at = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(raw[at:a])
        at = b
    return b"".join((*parts, raw[at:])).decode("utf-8")
