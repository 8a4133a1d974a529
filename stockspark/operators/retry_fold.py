"""Approvals of one product in time order, where a refused request may be asked again (W-04).

Every candidate approval has its request, its number ``k`` there and whether
more follow.  In time order: the first candidate of a request is tried; a
later one only if all before it were refused; a try is accepted if the
product's balance covers it.  So the state of a product is its balance and the
set of its blocked requests (refused, with candidates to come).

One pass does a whole product: sorted partitions, state carried across Arrow
batches, a set look-up a row, however long the chains of retries are.  A
product too large for one task is cut into contiguous chunks by
(product, time); the chunks behind its first are folded one after another, each
once, from the balance at the end of the chunk before and with those of its
requests marked that are blocked there.  Only the balances and the blocked
requests of such products travel between chunks, as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.operators import ledger as L
from stockspark.operators.common import materialize
from stockspark.session import collect_garbage

KEY = "product_id"
RESULT = [T.StructField("_after", T.LongType()), T.StructField("tried", T.BooleanType()),
          T.StructField("accepted", T.BooleanType())]


def _fold(asked: np.ndarray, first: np.ndarray, more: np.ndarray, request, balance: int, blocked: set):
    """(balance after, tried, accepted) of a product's candidates in order; ``first``: tried whatever came before.

    ``blocked`` is brought up to date; returns the last balance too.
    """
    if not blocked and first.all():                       # no retry in sight: all pass, or none needs a set
        left = balance - np.cumsum(asked)
        if len(left) and left.min() >= 0:
            yes = np.ones(len(asked), bool)
            return left, yes, yes.copy(), int(left[-1])
    after = np.empty(len(asked), np.int64)
    tried, accepted = np.zeros(len(asked), bool), np.zeros(len(asked), bool)
    for i, (q, f, m, r) in enumerate(zip(asked.tolist(), first.tolist(), more.tolist(), request)):
        if f or r in blocked:
            tried[i] = True
            if q <= balance:
                balance -= q
                accepted[i] = True
                blocked.discard(r)
            elif m:
                blocked.add(r)
            else:
                blocked.discard(r)
        after[i] = balance
    return after, tried, accepted, balance


def _pass(batches):
    """Sorted partitions: every product's rows from its opening; state carried across batches."""
    key, balance, blocked = None, 0, set()
    for pdf in batches:
        p = pdf[KEY].to_numpy()
        cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, np.int64)
        parts = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)]):
            if key is None or p[a] != key:
                key, balance, blocked = p[a], int(pdf["_open"].iloc[a]), set()
            s = slice(a, b)
            *cols, balance = _fold(pdf["_cents"].to_numpy(np.int64)[s], pdf["k"].to_numpy()[s] == 1,
                                   pdf["more"].to_numpy(bool)[s], pdf["request_id"].iloc[s], balance, blocked)
            parts.append(cols)
        after, tried, accepted = (np.concatenate(c) for c in zip(*parts)) if parts else ([], [], [])
        yield pdf.assign(_after=pd.Series(after, pdf.index, "int64"), tried=pd.Series(tried, pdf.index, "bool"),
                         accepted=pd.Series(accepted, pdf.index, "bool"))


def fold_candidates(cand: DataFrame, opening: DataFrame, order_cols, n_chunks: int | None = None) -> DataFrame:
    """The candidates that were tried, with ``accepted`` and ``balance_after``.

    ``cand``: product_id, request_id, k, more, qty and the order columns, a
    total order by product (read two or three times, so best a stored table); ``opening``: product_id and balance (none: 0).
    """
    order = list(order_cols)
    start = opening.select(KEY, L.to_cents(F.col("balance")).alias("_o"))
    rows = cand.where(F.col(KEY).isNotNull())
    total = rows.count()
    n = n_chunks or max(int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // L.ROWS_PER_CHUNK))
    hot = L.has_hot_key(rows, n)
    # dealt out once, by product as the openings are, unless a product is too large for a task
    parted = (rows.join(start, KEY, "left").repartitionByRange(n, KEY, *order) if hot
              else rows.repartition(n, KEY).join(start, KEY, "left"))
    parted = (parted.withColumn("_open", F.coalesce("_o", F.lit(0).cast("bigint"))).drop("_o")
              .withColumn("_cents", L.to_cents(F.col("qty")))
              .sortWithinPartitions(KEY, *order).withColumn("chunk", F.spark_partition_id()))
    folded = parted.mapInPandas(_pass, T.StructType(parted.schema.fields + RESULT))
    if hot:
        folded = _stitch(L._checkpoint(folded), order)
    tried = (folded.where("tried").withColumn("balance_after", L.from_cents(F.col("_after")))
             .drop("_open", "_cents", "_after", "tried", "chunk"))
    tried = materialize(tried, "candidates")          # folded once, however often they are read
    if total >= L.ROWS_PER_CHUNK:
        collect_garbage(cand.sparkSession)
    return tried


def _stitch(folded: DataFrame, order: list) -> DataFrame:
    """Fold the chunks behind each product's first, in order; the first pass holds for the others."""
    place = F.struct(*order)
    chunks = folded.groupBy(KEY, "chunk").agg(F.max_by("_after", place).alias("end"))
    chunks = L._checkpoint(chunks.withColumn("rk", F.row_number().over(Window.partitionBy(KEY).orderBy("chunk"))))
    n = chunks.agg(F.max("rk")).first()[0] or 1
    done = [folded.join(chunks.where("rk = 1").select(KEY, "chunk"), [KEY, "chunk"], "left_semi")]
    if n == 1:
        return folded
    several = chunks.where("rk = 2").select(KEY)
    ends = chunks.where("rk = 1").join(several, KEY, "left_semi").select(KEY, F.col("end").alias("_start"))
    blocked = L._checkpoint(_blocked(done[0].join(several, KEY, "left_semi")))
    schema = T.StructType([f for f in folded.schema.fields if f.name not in {r.name for r in RESULT}] + RESULT)

    def refold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        was = set(pdf["request_id"][pdf["_blocked"].to_numpy(bool)])
        after, tried, accepted, _ = _fold(pdf["_cents"].to_numpy(np.int64), pdf["k"].to_numpy() == 1,
                                          pdf["more"].to_numpy(bool), pdf["request_id"], int(pdf["_start"].iloc[0]), was)
        return pdf.drop(columns=["_start", "_blocked"]).assign(_after=after, tried=tried, accepted=accepted)

    for k in range(2, n + 1):
        now = chunks.where(F.col("rk") == k).select(KEY, "chunk").join(ends, KEY)
        rows = (folded.drop(*[f.name for f in RESULT]).join(now, [KEY, "chunk"])
                .join(blocked.withColumn("_blocked", F.lit(True)), [KEY, "request_id"], "left")
                .withColumn("_blocked", F.coalesce("_blocked", F.lit(False))))
        out = L._checkpoint(rows.groupBy(KEY, "chunk").applyInPandas(refold, schema))
        done.append(out)
        if k < n:
            ends = out.groupBy(KEY).agg(F.max_by("_after", place).alias("_start"))
            still = blocked.join(out.where("tried").select(KEY, "request_id"), [KEY, "request_id"], "left_anti")
            blocked = L._checkpoint(still.unionByName(_blocked(out)))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d.select(*result.columns))
    return result


def _blocked(rows: DataFrame) -> DataFrame:
    """Requests whose last try was refused and that have candidates to come."""
    last = rows.where("tried").groupBy(KEY, "request_id").agg(F.max_by(F.struct("accepted", "more"), "k").alias("_l"))
    return last.where(~F.col("_l.accepted") & F.col("_l.more")).select(KEY, "request_id")
