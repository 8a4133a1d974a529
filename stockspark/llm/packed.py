"""Packed slices of sorted keys that runs of documents exchange with hash shards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Sorted keys of a run for one shard, with what it has to say of each.
SLICES = "shard long, block long, keys binary, own binary"
SUMS = "shard long, block long, counts binary, n_keys bigint"


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """Bytes of equal place together: the high bytes of sorted keys compress away."""
    raw = np.ascontiguousarray(a).view("u1").reshape(len(a), a.dtype.itemsize)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(raw: bytes, dtype, width: int | None = None) -> np.ndarray:
    dtype = np.dtype(dtype)
    width = width or dtype.itemsize
    n = len(raw) // width
    out = np.zeros((n, dtype.itemsize), "u1")
    out[:, :width] = np.frombuffer(raw, "u1").reshape(width, n).T
    return out.reshape(-1).view(dtype)


def shard_cuts(high: np.ndarray, n_shards: int) -> np.ndarray:
    """Where each shard's slice of sorted keys ends; ``high``: the keys' top 32 bits."""
    bounds = np.array([-(-(s << 32) // n_shards) for s in range(1, n_shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(high, bounds), [len(high)])).astype(np.int64)


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, "u1"), count=n).astype(bool)


def deal_slices(block: int, high: np.ndarray, keys: Callable, own: Callable, n_shards: int) -> pd.DataFrame:
    """A row for each shard that gets keys; ``keys`` and ``own`` pack a slice."""
    cuts = shard_cuts(high, n_shards)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pd.DataFrame({"shard": full, "block": block, "keys": [keys(cuts[s], cuts[s + 1]) for s in full],
                         "own": [own(cuts[s], cuts[s + 1]) for s in full]})


def deal_counts(block: int, keys: np.ndarray, counts: np.ndarray, n_shards: int) -> pd.DataFrame:
    """A run's sorted distinct 64-bit keys with their counts."""
    n = counts.astype("<u4")
    return deal_slices(block, keys >> np.uint64(32), lambda a, b: planes(keys[a:b]), lambda a, b: planes(n[a:b]), n_shards)


def sum_counts(sent: DataFrame) -> DataFrame:
    """Every run's keys with their sums over all runs, by (shard, block).

    ``n_keys`` on a shard's first row: its distinct keys with a positive sum.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unplanes(k, "<u8") for k in rows["keys"]]
        counts = np.concatenate([unplanes(o, "<u4") for o in rows["own"]])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        got = np.split(sums[at], np.cumsum(list(map(len, keys)))[:-1])
        return pd.DataFrame({"shard": rows["shard"], "block": rows["block"], "counts": [planes(x) for x in got],
                             "n_keys": [int((sums > 0).sum())] + [0] * (len(keys) - 1)})
    return sent.groupBy("shard").applyInPandas(run, SUMS)


def sums_of(keys: np.ndarray, rows: pd.DataFrame, n_shards: int) -> np.ndarray:
    """The sums of a run's sorted distinct keys, from the answers it got."""
    cuts = shard_cuts(keys >> np.uint64(32), n_shards)
    out = np.zeros(len(keys), np.int64)
    for s, raw in zip(rows["shard"], rows["counts"]):
        out[cuts[s]:cuts[s + 1]] = unplanes(raw, "<i8")
    return out
