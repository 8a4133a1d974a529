"""Stock ledger: running balances, the conditional (refusing) fold, snapshots.

Rule (per product, in movement order): a movement whose signed quantity
would take the balance below zero is refused and leaves the balance
unchanged; every other movement is applied.  Refusals make the result
order-dependent, so this is not an aggregate and not a window function.

Plan, built so that no product -- however hot -- has to sit in one task:

1. ``chunk_movements``: a per-product row count decides the split.  If some
   product holds more rows than an even chunk, range-partition on
   (product, order key) -- sampled bounds cut the hot product into
   contiguous *chunks* (chunk id = partition id); otherwise hash-partition
   by product (each product is one chunk, no sampling scans).  Rows are
   sorted within partitions and one Arrow pass per partition computes the
   within-chunk prefix sum ``pre`` and the refusing fold from the product's
   opening.  The table is persisted (memory and disk) or, with
   ``reliable=True``, checkpointed into the shared checkpoint folder.
   With the hash split that fold is final and steps 2-4 are skipped.
2. ``chunk_summaries``: per (product, chunk) the sum ``s`` and the
   threshold ``t = max(0, -min prefix)``: starting a chunk with balance
   ``b >= t`` refuses nothing, so the chunk then ends at ``b + s``.  Map-side
   partial aggregation leaves one row per chunk to shuffle.
3. Resolution loop over the (small) chunk table: a product's first chunk is
   exact from step 1; the following chunks are speculated clean from its
   end and accepted while ``start >= t``; the first one that could refuse
   is folded again row by row from its exact start (bounded by one chunk)
   and its end becomes the next base.  Products progress in parallel; each
   round checkpoints its chunk table.
4. Rows of clean chunks get ``start + pre`` (a projection after a join of
   the row table with the one-row-per-chunk starts); other rows come from
   step 1 or step 3.

K-01 (running balance, nothing refused) is step 1, 2 and 4 with every
chunk clean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.session import ensure_checkpoint_dir

D12 = "decimal(12,2)"
#: Rows of an even chunk at most, where the caller names no number of chunks: what a task sorts in memory.
ROWS_PER_CHUNK = 500_000
ORDER = ("created_at", "ord_key", "ord_line")
KEY = "product_id"


def to_cents(c) -> F.Column:
    return (c * 100).cast("bigint")


def from_cents(c) -> F.Column:
    return (c.cast("decimal(20,0)") / F.lit(100)).cast(D12)


# ---------------------------------------------------------------- step 1
def _fold_from(x: np.ndarray, bal: int):
    """Sequential refusing fold of ``x`` from ``bal``: (after, accepted, end)."""
    pre = bal + np.cumsum(x)
    if len(x) == 0 or pre.min() >= 0:           # nothing can be refused
        return pre, np.ones(len(x), dtype=bool), int(pre[-1]) if len(x) else bal
    after = np.empty(len(x), dtype=np.int64)
    acc = np.ones(len(x), dtype=bool)
    first = int(np.argmax(pre < 0))              # rows before the first dip are applied
    after[:first] = pre[:first]
    b = int(pre[first - 1]) if first else bal
    for i, v in enumerate(x[first:].tolist(), start=first):
        nb = b + v
        if nb >= 0:
            b = nb
        else:
            acc[i] = False
        after[i] = b
    return after, acc, b


def _segment_pass(batches, order_cols=ORDER):
    """One pass over a sorted partition: per product segment the plain prefix
    ``pre`` (from 0) and the refusing fold ``_after0``/``_acc0`` started at the
    product's opening ``_open`` (exact for the product's first chunk), the
    row's place ``_pos`` in the partition, and ``_lead``: whether it has the
    order key of its segment's first row.

    Vectorised: prefix sums and the "can anything be refused" test run in
    numpy for all segments at once; only segments that dip below zero are
    walked row by row, and only from their first dip.  State of the last
    segment is carried across Arrow batches, so memory is one batch
    regardless of how many rows a product has; the other columns stay Arrow
    columns and are handed on as they came.
    """
    carry_key, carry_pre, carry_bal, seen, carry_row, carry_lead = None, 0, 0, 0, None, False
    for rb in batches:
        n = rb.num_rows
        pre, after, acc, lead = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
        if n:
            key = _column(rb, KEY)
            x = _column(rb, "_cents").astype(np.int64, copy=False)
            starts = np.empty(n, dtype=bool)
            starts[0] = True
            starts[1:] = key[1:] != key[:-1]
            first_idx = np.flatnonzero(starts)
            seg = np.cumsum(starts) - 1
            cs = np.cumsum(x)
            rel = cs - (cs - x)[first_idx][seg]                 # prefix within segment
            p0 = np.zeros(len(first_idx), dtype=np.int64)       # plain prefix carried in
            f0 = _column(rb, "_open").astype(np.int64)[first_idx]          # fold start
            if carry_key is not None and key[0] == carry_key:
                p0[0], f0[0] = carry_pre, carry_bal
            pre = rel + p0[seg]
            plain = rel + f0[seg]                               # fold if nothing refused
            seg_min = np.minimum.reduceat(plain, first_idx)
            after = plain.copy()
            acc = np.ones(n, dtype=bool)
            bounds = np.append(first_idx, n)
            for j in np.flatnonzero(seg_min < 0).tolist():      # only dipping segments
                a, b = bounds[j], bounds[j + 1]
                after[a:b], acc[a:b], _ = _fold_from(x[a:b], int(f0[j]))
            # a row leads if neither it nor any before it in its segment differs from the row before
            same = starts.copy()
            order = pa.table([rb.column(rb.schema.get_field_index(c)) for c in order_cols], names=list(order_cols))
            same[1:] |= _equal_rows(order.slice(1), order.slice(0, n - 1))
            if carry_key is not None and key[0] == carry_key:
                same[0] = carry_lead and bool(_equal_rows(order.slice(0, 1), carry_row)[0])
            differs = np.cumsum(~same)
            lead = differs == (differs - ~same)[first_idx][seg]
            carry_row, carry_lead = order.slice(n - 1), bool(lead[-1])
            carry_key, carry_pre, carry_bal = key[-1], int(pre[-1]), int(after[-1])
        found = {"pre": pre, "_after0": after, "_acc0": acc, "_pos": np.arange(seen, seen + n, dtype=np.int64),
                 "_lead": lead}
        seen += n
        yield pa.RecordBatch.from_arrays([*rb.columns, *map(pa.array, found.values())], [*rb.schema.names, *found])


def _equal_rows(a: pa.Table, b: pa.Table) -> np.ndarray:
    """Where two tables of the same columns have equal rows; null equals null."""
    equal = np.ones(a.num_rows, dtype=bool)
    for x, y in zip(a.columns, b.columns):
        both = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        equal &= both.to_numpy()
    return equal


def _column(rb: pa.RecordBatch, name: str) -> np.ndarray:
    return rb.column(rb.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _deal(movements: DataFrame, n_chunks: int, rows: int | None = None) -> tuple[bool, int, int]:
    """Whether some product holds more rows than an even chunk would, the number of chunks (``n_chunks``, or as many
    as keep an even chunk at ``rows`` rows) and the number of rows.

    Rows are counted by buckets of products first (a few numbers a task); only if a bucket is larger than a chunk
    are they counted by product.
    """
    def largest(key) -> tuple:
        per = movements.groupBy(key).agg(F.count("*").alias("_n"))
        return per.agg(F.max("_n"), F.sum("_n")).first()

    mx, total = largest(F.pmod(F.xxhash64(KEY), F.lit(64 * max(1, n_chunks))).alias("_bucket"))
    n = max(1, n_chunks, -(-(total or 0) // rows) if rows else 1)
    even = max(1, (total or 0) // n)
    return bool(mx) and mx > even and largest(F.col(KEY))[0] > even, n, total or 0


def has_hot_key(movements: DataFrame, n_chunks: int) -> bool:
    """True when some product holds more rows than an even chunk would."""
    return _deal(movements, n_chunks)[0]


def chunk_movements(movements: DataFrame, order_cols=ORDER, n_chunks: int | None = None,
                    qty_col: str = "signed_qty", opening: DataFrame | None = None,
                    reliable: bool = False, split: str = "auto") -> DataFrame:
    """Partitioned, sorted, materialised movements (see ``_chunk``)."""
    return _chunk(movements, order_cols, n_chunks, qty_col, opening, reliable, split)[0]


def _chunk(movements: DataFrame, order_cols=ORDER, n_chunks: int | None = None,
           qty_col: str = "signed_qty", opening: DataFrame | None = None,
           reliable: bool = False, split: str = "auto", once: bool = False):
    """Partitioned, sorted, materialised movements; (them, the split, the numbers of chunks and of rows, if counted).

    ``split``: "range" cuts every product into contiguous chunks at sampled
    bounds (needed when one product is larger than a chunk); "hash" keeps
    each product whole in one chunk (no sampling scans, nothing to stitch);
    "auto" picks range only if a product is larger than an even chunk.
    Adds ``chunk`` (partition id), ``pre``, the fold-from-opening columns,
    ``_pos`` (the row's place in its chunk's partition) and ``_lead``.
    ``once``: the caller reads a hash split a single time, so it isn't kept.
    """
    spark = movements.sparkSession
    n, total = n_chunks or int(spark.conf.get("spark.sql.shuffle.partitions")), None
    keys = [KEY, *order_cols]
    # a movement of no product belongs to no balance: see rejected_movements
    movements = movements.filter(F.col(KEY).isNotNull())
    if split == "auto":
        hot, n, total = _deal(movements, n, None if n_chunks else ROWS_PER_CHUNK)
        split = "range" if hot else "hash"
    # what is worked out from a row isn't sent with it
    if split == "range":     # sampled bounds: a hot product is cut into chunks
        parted = _opened(movements, opening).repartitionByRange(n, *keys)
    else:                    # no product larger than a chunk: one chunk per product, dealt out as its opening is
        parted = _opened(movements.repartition(n, KEY), opening)
    ranged = (parted.withColumn("_open", F.coalesce("_open", F.lit(0).cast("bigint")))
              .withColumn("_cents", to_cents(F.col(qty_col)))
              .sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("pre", T.LongType()), T.StructField("_after0", T.LongType()),
        T.StructField("_acc0", T.BooleanType()), T.StructField("_pos", T.LongType()),
        T.StructField("_lead", T.BooleanType())])
    order = tuple(order_cols)
    out = ranged.mapInArrow(lambda batches: _segment_pass(batches, order), schema)
    return (out if once and split == "hash" else _keep(out, reliable)), split, (n, total)


def _opened(movements: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Movements with the opening balance of their product in cents, ``_open``; null: none."""
    if opening is None:
        return movements.withColumn("_open", F.lit(None).cast("bigint"))
    return movements.join(opening.select(KEY, to_cents(F.col("balance")).alias("_open")), KEY, "left")


# ---------------------------------------------------------------- step 2
def chunk_summaries(chunked: DataFrame, order_cols=ORDER) -> DataFrame:
    return (chunked.groupBy(KEY, "chunk")
            .agg(F.sum("_cents").alias("s"),
                 F.greatest(F.lit(0).cast("bigint"), -F.min("pre")).alias("t"),
                 F.max_by("_after0", "_pos").alias("end0")))


def _openings(cs: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Per product start balance in cents (default 0)."""
    keys = cs.select(KEY).distinct()
    if opening is None:
        return keys.withColumn("base", F.lit(0).cast("bigint"))
    o = opening.select(KEY, to_cents(F.col("balance")).alias("base"))
    return (keys.join(o, KEY, "left")
            .select(KEY, F.coalesce("base", F.lit(0).cast("bigint")).alias("base")))


# ---------------------------------------------------------------- step 3
def _fold_schema(rows: DataFrame) -> T.StructType:
    fields = [f for f in rows.schema.fields if f.name != "_start"]
    return T.StructType(fields + [T.StructField("_before", T.LongType()),
                                  T.StructField("_after", T.LongType()),
                                  T.StructField("accepted", T.BooleanType())])


def _make_refold(order_cols):
    order_cols = list(order_cols)

    def refold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_cols, kind="stable")
        x = pdf["_cents"].to_numpy(dtype=np.int64)
        after, acc, _ = _fold_from(x, int(pdf["_start"].iloc[0]))
        before = np.where(acc, after - x, after)
        return pdf.drop(columns=["_start"]).assign(_before=before, _after=after, accepted=acc)

    return refold


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _keep(df: DataFrame, reliable: bool) -> DataFrame:
    """Materialise the chunk table once.

    ``reliable``: checkpoint into the shared folder (cuts lineage).  Default:
    persist memory-and-disk; a lost block is recomputed through the same
    range-shuffle dependency (fixed bounds) and a deterministic sort, so the
    chunk ids and prefix values come out identical."""
    if reliable:
        return _checkpoint(df)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def _materialize(df: DataFrame, round_no: int) -> DataFrame:
    """Per-round chunk tables (one row per chunk, small): reliable checkpoint
    every round.  Each round's plan refers to the previous round's table
    twice, so without cutting lineage the plan would double per round."""
    return _checkpoint(df)


def resolve_chunks(chunked: DataFrame, order_cols=ORDER, opening: DataFrame | None = None,
                   max_rounds: int = 100_000):
    """Exact start of every (product, chunk).

    Returns ``(plan, refolded)``: ``plan`` has one row per chunk with
    ``method`` in {fold0, clean} and its exact ``start``; ``refolded`` holds
    the rows of chunks that had to be folded again from a non-zero start.
    Each round: the first pending chunk of a product has an exact start
    (``base``); with base 0 the fold-from-zero of pass 1 is exact, with
    ``base >= t`` the chunk refuses nothing, otherwise it is refolded.
    Following chunks are speculated as clean from the first one's end and
    accepted up to the first that could refuse.
    """
    cs = chunk_summaries(chunked, order_cols).cache()
    pending = cs
    base = None if opening is None else _openings(cs, opening)
    plans, refolds = [], []
    round_no = 0
    refold = _make_refold(order_cols)
    w = Window.partitionBy(KEY).orderBy("chunk")
    wp = Window.partitionBy(KEY)
    for _ in range(max_rounds):
        rk = F.col("rk")
        # round 0: the first chunk starts at the opening, which pass 1 folded from
        first_method = (F.when(F.lit(round_no == 0), "fold0")
                        .when(F.col("base") >= F.col("t"), "clean").otherwise("refold"))
        joined = (pending.withColumn("base", F.lit(0).cast("bigint")) if base is None
                  else pending.join(base, KEY))
        x = (joined
             .withColumn("rk", F.row_number().over(w))
             .withColumn("m1", F.when(rk == 1, first_method))
             .withColumn("fe", F.max(F.when(rk == 1, F.when(F.col("m1") == "fold0", F.col("end0"))
                                            .when(F.col("m1") == "clean",
                                                  F.col("base") + F.col("s")))).over(wp))
             .withColumn("start", F.when(rk == 1, F.col("base")).otherwise(
                 F.col("fe") + F.coalesce(F.sum(F.when(rk >= 2, F.col("s")))
                                          .over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0).cast("bigint"))))
             .withColumn("bad", F.min(F.when((rk >= 2) & (F.col("start") < F.col("t")), rk))
                         .over(wp)))
        x = _materialize(x, round_no)
        bad = F.col("bad")
        done = ((rk == 1) & (F.col("m1") != "refold")) | (
            (rk >= 2) & F.col("fe").isNotNull() & (bad.isNull() | (rk < bad)))
        plans.append(x.filter(done).select(
            KEY, "chunk", F.when(rk == 1, F.col("m1")).otherwise("clean").alias("method"),
            "start"))
        is_refold = (rk == 1) & (F.col("m1") == "refold")
        nxt = (rk >= 2) & (F.col("fe").isNull() | (rk >= bad))
        n_fold, n_next = x.agg(F.count_if(is_refold), F.count_if(nxt)).first()  # one action
        to_fold = x.filter(is_refold).select(KEY, "chunk", F.col("start").alias("_start"))
        folded = None
        if n_fold:
            # Only chunks after a partition boundary can be refolded: at most one
            # per boundary, so this side is bounded by the number of partitions.
            rows = chunked.join(F.broadcast(to_fold), [KEY, "chunk"])
            folded = _materialize(rows.groupBy(KEY, "chunk")
                                  .applyInPandas(refold, _fold_schema(rows)), round_no)
            refolds.append(folded)
        pending = x.filter(nxt).select(KEY, "chunk", "s", "t", "end0")
        if not n_next:
            break
        base = x.filter(rk == bad).select(KEY, F.col("start").alias("base"))
        if folded is not None:
            ends = (folded.groupBy(KEY)
                    .agg(F.max_by("_after", F.struct(*order_cols)).alias("base")))
            base = base.unionByName(ends.join(pending.select(KEY).distinct(), KEY, "left_semi"))
        round_no += 1
    else:
        raise RuntimeError("ledger resolution did not converge")
    plan = plans[0]
    for p in plans[1:]:
        plan = plan.unionByName(p)
    if not refolds:
        return plan, None
    refolded = refolds[0]
    for p in refolds[1:]:
        refolded = refolded.unionByName(p)
    return plan, refolded


# ---------------------------------------------------------------- public ops
def _finish(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("balance_before", from_cents(F.col("_before")))
            .withColumn("balance_after", from_cents(F.col("_after")))
            .drop("_before", "_after", "_cents", "pre", "chunk", "start", "_after0", "_acc0",
                  "_open", "_pos", "_lead"))


def ledger_apply(movements: DataFrame, order_cols=ORDER, opening: DataFrame | None = None,
                 n_chunks: int | None = None, qty_col: str = "signed_qty",
                 split: str = "auto") -> DataFrame:
    """K-02: conditional running balance; refused movements keep the balance.

    Output: the movement columns + balance_before, balance_after, accepted.
    """
    return _finish(_folded(movements, order_cols, opening, n_chunks, qty_col, split)[0])


def fold_rows(movements: DataFrame, order_cols=ORDER, opening: DataFrame | None = None, qty_col: str = "signed_qty"):
    """The rows of ``ledger_apply`` in cents, to be read once, with what a stored ledger keeps: ``_cents``, ``chunk``,
    ``pre`` (the sum within the chunk up to the row), ``_before``, ``_after``, ``accepted``; ``_pos`` orders them
    within a chunk, ``_lead`` marks those with its first order key; the table to unpersist then; the numbers of chunks
    and rows."""
    folded, chunked, size = _folded(movements, order_cols, opening, None, qty_col, "auto", once=True)
    return folded.drop("start", "method", "_after0", "_acc0", "_open"), chunked, *size


def _folded(movements, order_cols, opening, n_chunks, qty_col, split, once=False):
    chunked, split, size = _chunk(movements, order_cols, n_chunks, qty_col, opening, split=split, once=once)
    if split == "hash":
        # every product lies whole in one chunk: the pass-1 fold is final
        return (chunked.withColumn("_after", F.col("_after0"))
                .withColumn("accepted", F.col("_acc0"))
                .withColumn("_before", F.when(F.col("accepted"),
                                              F.col("_after") - F.col("_cents"))
                            .otherwise(F.col("_after")))), chunked, size
    plan, refolded = resolve_chunks(chunked, order_cols, opening)
    fold0 = F.col("method") == "fold0"
    after = F.when(fold0, F.col("_after0")).otherwise(F.col("start") + F.col("pre"))
    acc = F.when(fold0, F.col("_acc0")).otherwise(F.lit(True))
    planned = (chunked.join(plan, [KEY, "chunk"])
               .withColumn("_after", after).withColumn("accepted", acc)
               .withColumn("_before", F.when(F.col("accepted"), F.col("_after") - F.col("_cents"))
                           .otherwise(F.col("_after"))))
    if refolded is None:
        return planned.drop("method", "_after0", "_acc0"), chunked, size
    cols = refolded.columns
    return planned.select(*cols).unionByName(refolded), chunked, size


def rejected_movements(movements: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The reject output of the ledger: movements without a product, and, given
    the product table (column ``id``), those of an unknown product, with ``reason``."""
    none = movements.filter(F.col(KEY).isNull()).withColumn("reason", F.lit("no product"))
    if products is None:
        return none
    known = products.select(F.col("id").alias(KEY))
    unknown = movements.filter(F.col(KEY).isNotNull()).join(known, KEY, "left_anti")
    return none.unionByName(unknown.withColumn("reason", F.lit("unknown product")))


def running_balance(movements: DataFrame, order_cols=ORDER, opening: DataFrame | None = None,
                    n_chunks: int | None = None, qty_col: str = "signed_qty",
                    split: str = "auto") -> DataFrame:
    """K-01: plain running balance (nothing refused), hot-key safe.

    Chunk offsets are prefix sums over the chunk table; rows get
    ``offset + pre``.  No window ever spans a whole product.
    """
    chunked, split, _ = _chunk(movements, order_cols, n_chunks, qty_col, opening, split=split)
    if split == "hash":
        rows = (chunked.withColumn("_after", F.col("_open") + F.col("pre"))
                .withColumn("_before", F.col("_after") - F.col("_cents")))
        return _finish(rows)
    cs = chunk_summaries(chunked, order_cols)
    w = Window.partitionBy(KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cs.join(_openings(cs, opening), KEY)
              .select(KEY, "chunk", (F.col("base") + F.coalesce(F.sum("s").over(w), F.lit(0)))
                      .alias("start")))
    rows = (chunked.join(starts, [KEY, "chunk"])
            .withColumn("_after", F.col("start") + F.col("pre"))
            .withColumn("_before", F.col("_after") - F.col("_cents")))
    return _finish(rows)


def ledger_snapshot(movements: DataFrame, order_cols=ORDER, opening: DataFrame | None = None,
                    n_chunks: int | None = None, qty_col: str = "signed_qty",
                    split: str = "auto") -> DataFrame:
    """K-03 straight from the chunk resolution: the final balance of a
    product is the end of its last chunk (fold0 end, clean start + s, or
    the refolded end), so no row-level output is assembled."""
    # only the key, the order and the quantity travel through the shuffle
    narrow = movements.select(KEY, *order_cols, qty_col)
    chunked, split, _ = _chunk(narrow, order_cols, n_chunks, qty_col, opening, split=split)
    if split == "hash":
        return (chunked.groupBy(KEY).agg(F.max_by("_after0", "_pos").alias("_e"))
                .select(KEY, from_cents(F.col("_e")).alias("current_stock")))
    plan, refolded = resolve_chunks(chunked, order_cols, opening)
    cs = chunk_summaries(chunked, order_cols).select(KEY, "chunk", "s", "end0")
    ends = (plan.join(cs, [KEY, "chunk"])
            .select(KEY, "chunk", F.when(F.col("method") == "fold0", F.col("end0"))
                    .otherwise(F.col("start") + F.col("s")).alias("_end")))
    if refolded is not None:
        ends = ends.unionByName(refolded.groupBy(KEY, "chunk").agg(
            F.max_by("_after", F.struct(*order_cols)).alias("_end")))
    return (ends.groupBy(KEY).agg(F.max_by("_end", "chunk").alias("_end"))
            .select(KEY, from_cents(F.col("_end")).alias("current_stock")))


def stock_snapshot(ledger: DataFrame, order_cols=ORDER) -> DataFrame:
    """K-03: last balance per product (map-side partial max_by)."""
    return (ledger.groupBy(KEY)
            .agg(F.max_by("balance_after", F.struct(*order_cols)).alias("current_stock")))


def reconcile(ledger: DataFrame, snapshot: DataFrame | None = None, order_cols=ORDER) -> DataFrame:
    """Q-06: ledger consistency violations.

    * ``after_mismatch``: accepted row whose after != before + signed qty,
      or refused row whose after != before;
    * ``chain_break``: before != previous row's after (same product);
    * ``negative``: a negative balance;
    * ``snapshot_mismatch``: snapshot differs from the last after.

    The chain check pairs every row with its predecessor through the global
    rank in (product, order) order: rank from the partitioned ranking, then
    an equi-join on rank - 1 (a unique key, so a product holding a third of
    the rows is still spread over all tasks).
    """
    from stockspark.operators.numbering import rank_rows
    cols = [KEY, *order_cols, "signed_qty", "balance_before", "balance_after", "accepted"]
    ranked = rank_rows(ledger.select(*cols), [KEY, *order_cols], "_seq")
    prev = ranked.select((F.col("_seq") + 1).alias("_seq"), F.col(KEY).alias("_pk"),
                         F.col("balance_after").alias("_pa"))
    l = (ranked.join(prev, "_seq", "left")
         .withColumn("_prev_after", F.when(F.col("_pk") == F.col(KEY), F.col("_pa")))
         .drop("_pk", "_pa", "_seq"))
    expected = F.when(F.col("accepted"), F.col("balance_before") + F.col("signed_qty")) \
                .otherwise(F.col("balance_before"))
    checks = F.array(
        F.when(F.col("balance_after") != expected, F.lit("after_mismatch")),
        F.when(F.col("_prev_after").isNotNull() & (F.col("balance_before") != F.col("_prev_after")),
               F.lit("chain_break")),
        F.when(F.col("balance_after") < 0, F.lit("negative")))
    rows = (l.select(KEY, *order_cols, F.explode(F.array_compact(checks)).alias("rule"))
            .select(KEY, *order_cols, "rule"))
    if snapshot is None:
        return rows
    last = stock_snapshot(ledger, order_cols).withColumnRenamed("current_stock", "_last")
    snap = (snapshot.select(KEY, "current_stock").join(last, KEY, "full_outer")
            .filter(~F.col("current_stock").eqNullSafe(F.col("_last"))
                    & ~(F.col("_last").isNull() & (F.col("current_stock") == 0)))
            .select(KEY, *[F.lit(None).cast(f.dataType).alias(f.name)
                           for f in ledger.select(*order_cols).schema.fields],
                    F.lit("snapshot_mismatch").alias("rule")))
    return rows.unionByName(snap)
