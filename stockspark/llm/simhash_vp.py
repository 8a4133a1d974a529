"""SimHash near-duplicates found with vantage-point trees.

1. One Arrow pass turns each text into a 64-bit fingerprint: A-Z lower-cased,
   words, shingles of ``width`` words (repeats included; a shorter text is one
   shingle), XXH64 of each with seed 42; a bit is set if it is set in over
   half of the hashes.  A text without words has fingerprint zero.
2. Equal fingerprints collapse by a map-side aggregate, so copies never meet
   in a task.
3. Shards: two fingerprints within 4 bits are at Hamming distance 0 from each
   other on at least two of six bands, so each print is dealt to one shard for
   each of the 15 pairs of bands.  A shard over ``max_shard`` prints is
   partitioned by Hamming distance to a vantage point of its own into shells
   of 2r + 1 distances; prints within r of a shell's lower bound also
   query the shell below, so no pair across a boundary is lost.  This is
   repeated while shards are too large.  A dense cluster stays in one shell;
   what is still too large is dealt by hash to blocks, and each two blocks
   meet in a shard of their own.
4. In each shard a vantage-point tree finds the pairs exactly; branches are
   pruned by the triangle inequality.  A shard gives a spanning forest, not
   all pairs, so a group of n near copies makes n - 1 rows.
5. Connected components by alternating large and small stars, written to the
   shared folder each round.

Null texts count as empty; all documents without words are linked.  A null
doc_id never names a component unless all its ids are null.  Repeated rows
are copies; a very long text has one fingerprint like any other; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import map_rows, prepare, staged

LEAF = 64
QUERIES_AT_ONCE = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash as a signed long."""
    from xxhash import xxh64_digest
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        digests = [xxh64_digest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-width])]
        digests = [xxh64_digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1:])]
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(digests)
    return int(np.packbits(over).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``fp`` (signed long) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, "text"), f"`{id_col}` {kind}, fp bigint",
                    lambda c: {id_col: c[id_col], "fp": [fingerprint(t, width) for t in c["text"]]})


# ------------------------------------------------------------- inside a shard
class VPTree:
    """Vantage-point tree over distinct 64-bit prints under Hamming distance."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints.view(np.uint64)      # bitwise_count() of a negative integer counts its absolute value
        self.root = self._build(np.arange(len(prints)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        vantage, rest = members[len(members) // 2], np.delete(members, len(members) // 2)
        d = np.bitwise_count(self.prints[rest] ^ self.prints[vantage]).astype(np.int64)
        mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
        inner = d <= mu
        if inner.all():
            mu -= 1
            inner = d <= mu
            if not inner.any():            # all at one distance: nothing to split by
                return members
        return vantage, mu, self._build(rest[inner]), self._build(rest[~inner])

    def hits(self, queries: np.ndarray, radius: int):
        """Yields (query, member) index pairs within ``radius`` by node, at most LEAF a query; queries are members' indexes."""
        todo = [(self.root, queries)]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), LEAF):
                    part = node[at:at + LEAF]
                    d = np.bitwise_count(self.prints[q][:, None] ^ self.prints[part][None, :])
                    a, b = np.nonzero(d <= radius)
                    yield q[a], part[b]
                continue
            vantage, mu, inner, outer = node
            d = np.bitwise_count(self.prints[q] ^ self.prints[vantage]).astype(np.int64)
            hit = q[d <= radius]
            yield hit, np.full(len(hit), vantage)
            todo.append((inner, q[d <= mu + radius]))
            todo.append((outer, q[d >= mu + 1 - radius]))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, member) index pairs within ``radius``."""
        a, b = (np.concatenate(x) for x in zip(*self.hits(queries, radius)))
        return a[a != b], b[a != b]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, after adding the links a-b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of at most ``radius`` bits: (print, smallest print of its tree)."""
    prints = np.unique(prints)
    if len(prints) < 2:
        return prints[:0], prints[:0]
    tree, label = VPTree(prints), np.arange(len(prints))
    for at in range(0, len(prints), QUERIES_AT_ONCE):
        for a, b in tree.hits(np.arange(at, min(at + QUERIES_AT_ONCE, len(prints))), radius):
            new = label[a] != label[b]
            if new.any():
                label = join_labels(label, a[new], b[new])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _shard_pass(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held_g, held_p = np.empty(0, np.int64), np.empty(0, np.int64)

        def solve(g, p):
            us, vs = [], []
            cuts = np.flatnonzero(np.diff(g)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(g)]))
            many = ends - starts > 1
            for a, b in zip(starts[many].tolist(), ends[many].tolist()):
                u, v = forest(p[a:b], radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))],
                                                 schema=schema)
        parts: list = []
        for b in batches:
            g, p = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(g):
                continue
            parts.append((g, p))
            if g[0] == g[-1] and (len(parts) == 1 or parts[0][0][0] == g[0]):
                continue                      # still one shard
            g, p = (np.concatenate(x) for x in zip(*parts))
            last = int(np.searchsorted(g, g[-1]))
            yield from solve(g[:last], p[:last])
            parts = [(g[last:], p[last:])]
        if parts:
            held_g, held_p = (np.concatenate(x) for x in zip(*parts))
            yield from solve(held_g, held_p)
    return run


# --------------------------------------------------------------- the operator
def band_masks(radius: int) -> list[int]:
    """Masks of the band pairs; of radius + 2 bands at least two are equal in a linked pair."""
    n = radius + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    bands = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards_of(prints: DataFrame, radius: int = 4, max_shard: int = 8192, max_levels: int = 6) -> DataFrame:
    """(g, fp): any two distinct prints within ``radius`` bits share a shard g."""
    masks = [_signed(m) for m in band_masks(radius)]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("k", "m"))
    shards = keyed.select(F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("g"), "fp")
    step = 2 * radius + 1
    for _ in range(max_levels):
        large = (shards.groupBy("g").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"))
                 .where(F.col("n") > max_shard).select("g", "vantage"))
        large = staged(large, "large-shards")
        if large.isEmpty():
            break
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        low, home = F.floor(F.greatest(d - radius, F.lit(0)) / step), F.floor(d / step)
        split = (shards.join(large, "g").select("g", "fp", F.explode(F.array_distinct(F.array(low, home))).alias("s"))
                 .select(F.xxhash64("g", "s").alias("g"), "fp"))
        shards = staged(shards.join(large, "g", "left_anti").unionByName(split), "shards")
    else:
        # two blocks together are about two thirds of max_shard
        large = (shards.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > max_shard)
                 .select("g", F.ceil(F.col("n") * 3 / max_shard).alias("n_blocks")))
        large = staged(large, "dense-shards")
        if not large.isEmpty():
            block = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
            met = (shards.join(large, "g").select("g", "fp", block.alias("a"), F.explode(
                F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
                   .select(F.xxhash64("g", F.least("a", "b"), F.greatest("a", "b")).alias("g"), "fp"))
            shards = shards.join(large, "g", "left_anti").unionByName(met)
    return shards


def links(prints: DataFrame, radius: int = 4, max_shard: int = 8192, max_levels: int = 6) -> DataFrame:
    """Spanning links (u, v) of distinct prints ``fp`` within ``radius`` bits."""
    shards = shards_of(prints, radius, max_shard, max_levels)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.repartition(n, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(_shard_pass(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node that isn't its component's smallest, from links (u, v).

    Ends when a round changes nothing; rounds grow with the logarithm of the longest chain.
    """
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    edges = staged(edges.where("u <> v").select(hi.alias("u"), lo.alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest node seen
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = staged(large, "large-star")
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id",
                    max_shard: int = 8192) -> DataFrame:
    """``id_col``, ``fp``, ``root`` (smallest print of the component) and ``component_id``, per row."""
    prints = staged(fingerprints(docs, width, id_col), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct-prints")
    roots = components(links(distinct.select("fp"), radius, max_shard))
    rooted = (distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = staged(rooted.select("fp", "root").join(named, "root"), "print-components")
    return prints.join(of_print, "fp").select(id_col, "fp", "root", "component_id")


def keep_first(docs: DataFrame, columns: tuple, width: int = 4, radius: int = 4) -> DataFrame:
    """The ``columns`` of one row of each component: of smallest doc_id, null only if all ids are.

    Rows that share that id within a component are reduced to one.
    """
    spark = docs.sparkSession
    named = staged(near_duplicates(docs, width, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                   .groupBy("doc_id", "root").agg(F.min("fp").alias("fp")), "kept-ids")
    kept = named.select(F.col("doc_id").alias("kept_id"), "fp", "root")
    firsts = docs.select(*columns).join(kept.select("kept_id").distinct(),
                                        F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # ids are keys: rows with a kept id are few more than the kept rows, and only theirs are printed again
    n_rows, n_kept = firsts.select("doc_id").count(), named.count()
    if n_rows == n_kept:
        return firsts
    prepare(spark)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    again = map_rows(firsts, f"{fields}, fp bigint", lambda c: {**c, "fp": [fingerprint(t, width) for t in c["text"]]})
    once = again.dropDuplicates(["doc_id", "fp"])
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (once["fp"] == kept["fp"]), "left_semi") \
        .select(*columns)
