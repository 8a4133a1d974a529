"""Corpus blocks and the exchange of their keys with hash shards.

A block is a run of whole documents of one input partition, cut when it holds
``block_bytes`` of text, so its size does not depend on any key.  A block
deals its distinct keys to shards by hash, as packed arrays; a shard sums the
counts of each key over all blocks and answers every block in the order of
the keys it was sent.  A key comes at most once from a block, so a key that
every document holds costs one entry a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Stands for a null doc_id in packed arrays; orders before all ids.
NULL_ID = -(1 << 63)
SENT = "shard long, block long, keys binary, counts binary"
ANSWERED = "shard long, block long, counts binary, n_keys bigint"


def cut_blocks(batches, block_bytes: int, id_at: int = 0, text_at: int = 1):
    """Yields (block id, doc ids, texts as bytes) of the running task."""
    from pyspark import TaskContext
    part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for i, t in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
            raw = t.encode("utf-8", "replace") if t else b""
            if ids and size + len(raw) > block_bytes:
                yield part << 32 | n, ids, texts
                n, ids, texts, size = n + 1, [], [], 0
            ids.append(NULL_ID if i is None else i)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield part << 32 | n, ids, texts


def deal(block: int, keys: np.ndarray, counts: np.ndarray, n_shards: int) -> pa.RecordBatch | None:
    """Rows (shard, block, keys, counts) of a block's distinct sorted 64-bit keys."""
    shard = (keys >> np.uint64(33)).astype(np.int64) % n_shards
    by = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[by])) + 1
    firsts = by[np.concatenate(([0], cuts))] if len(by) else by
    small = counts.astype("<u4") if len(counts) and counts.max() > 255 else counts.astype("u1")
    return pa.RecordBatch.from_pydict({
        "shard": shard[firsts].tolist(), "block": [block] * len(firsts),
        "keys": [k.astype("<u8").tobytes() for k in np.split(keys[by], cuts)] if len(by) else [],
        "counts": [c.tobytes() for c in np.split(small[by], cuts)] if len(by) else []},
        schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == n else "<u4").astype(np.int64)


def answer(sent: DataFrame, cap: int | None = None) -> DataFrame:
    """Every block's keys with their sums over all blocks (at most ``cap``), by (shard, block).

    ``n_keys`` on a shard's first row: its distinct keys with a positive sum.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, "<u8") for k in rows["keys"]]
        counts = [unpack_counts(c, len(k)) for c, k in zip(rows["counts"], keys)]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        n_keys = [int((sums > 0).sum())] + [0] * (len(keys) - 1)
        total = np.split(sums[at], np.cumsum(list(map(len, keys)))[:-1])
        if cap is not None:
            total = [np.minimum(t, cap) for t in total]
        out = [(t.astype("<u4") if len(t) and t.max() > 255 else t.astype("u1")).tobytes() for t in total]
        return pd.DataFrame({"shard": rows["shard"], "block": rows["block"], "counts": out, "n_keys": n_keys})
    return sent.groupBy("shard").applyInPandas(run, ANSWERED)


def answers_of(block_keys: np.ndarray, rows: pd.DataFrame, n_shards: int) -> np.ndarray:
    """The sums of a block's sorted distinct keys, from the answers it got."""
    shard = (block_keys >> np.uint64(33)).astype(np.int64) % n_shards
    by = np.argsort(shard, kind="stable")
    sizes = np.bincount(shard, minlength=n_shards)
    out = np.zeros(len(block_keys), np.int64)
    got = rows.sort_values("shard")
    out[by] = np.concatenate([unpack_counts(c, int(sizes[s])) for s, c in zip(got["shard"], got["counts"])]) \
        if len(got) else 0
    return out
