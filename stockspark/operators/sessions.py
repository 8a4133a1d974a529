"""User sessions in batch (T-05): a session ends after more than ``gap``
seconds without an event (a gap of exactly ``gap`` stays in the session).

Hot-user safe plan: range-partition events on (user, ts) so that a very
active user is cut into contiguous pieces, build sessions inside each
partition in one Arrow pass (state carried across batches), then merge
only the sessions touching a partition edge.  Interior sessions are final;
at most two edge sessions per partition exist, so the merge table is
bounded by twice the number of partitions.  The pass is written to the
shared folder once, so interior and edge sessions come from the same cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.operators.common import materialize

OUT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("session_start", T.TimestampNTZType()),
    T.StructField("session_end", T.TimestampNTZType()),
    T.StructField("events", T.LongType()),
    T.StructField("edge", T.BooleanType()),
])


def _make_local_sessions(gap_us: int):
    def local_sessions(batches):
        cur = None                        # [user, start, end, count]
        done = []
        first_emitted = False
        for pdf in batches:
            if pdf.empty:
                continue
            users = pdf["user_id"].to_numpy()
            ts = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            upto, count = ts, np.ones(len(ts), np.int64)
            if "upto" in pdf:                 # cells instead of events
                upto = pdf["upto"].to_numpy().astype("datetime64[us]").astype(np.int64)
                count = pdf["n"].to_numpy(np.int64)
            # boundaries inside this batch (vectorised), then stitch with ``cur``
            brk = np.empty(len(ts), dtype=bool)
            brk[0] = True
            brk[1:] = (users[1:] != users[:-1]) | (ts[1:] - upto[:-1] > gap_us)
            starts = np.flatnonzero(brk)
            ends = np.append(starts[1:], len(ts)) - 1
            sums = np.add.reduceat(count, starts).tolist()
            for a, b, n in zip(starts.tolist(), ends.tolist(), sums):
                u, s, e = int(users[a]), int(ts[a]), int(upto[b])
                if cur is not None and cur[0] == u and s - cur[2] <= gap_us:
                    cur[2], cur[3] = e, cur[3] + n
                    continue
                if cur is not None:
                    done.append((*cur, not first_emitted))
                    first_emitted = True
                cur = [u, s, e, n]
            if len(done) > 10000:
                yield _frame(done)
                done = []
        if cur is not None:
            done.append((*cur, True))     # last session of the partition is an edge
        if done:
            yield _frame(done)
    return local_sessions


def _frame(rows):
    u, s, e, n, edge = zip(*rows)
    return pd.DataFrame({
        "user_id": np.asarray(u, dtype=np.int64),
        "session_start": pd.to_datetime(np.asarray(s, dtype=np.int64), unit="us"),
        "session_end": pd.to_datetime(np.asarray(e, dtype=np.int64), unit="us"),
        "events": np.asarray(n, dtype=np.int64),
        "edge": np.asarray(edge, dtype=bool)})


def user_sessions(events: DataFrame, gap_seconds: int = 3600, user_col: str = "user_id",
                  ts_col: str = "ts", n_parts: int | None = None) -> DataFrame:
    spark = events.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = events.select(F.col(user_col).alias("user_id"), F.col(ts_col).alias("ts")).filter(F.col("ts").isNotNull())
    return _sessionize(e, gap_seconds, n)


def session_cells(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Events summed by user and cell of ``gap_seconds``: user_id, cell, first, last, n.

    Events of one cell are less than the gap apart, hence in one session, and
    cells of a user don't overlap: cells of parts of the events add up.
    """
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(gap_seconds * 1_000_000)).alias("cell")
    return events.where("ts IS NOT NULL").groupBy("user_id", cell).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def add_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("user_id", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                F.sum("n").alias("n"))


def sessions_of_cells(cells: DataFrame, gap_seconds: int = 3600, n_parts: int | None = None) -> DataFrame:
    """The sessions of added-up cells."""
    n = n_parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _sessionize(cells.select("user_id", F.col("first").alias("ts"), F.col("last").alias("upto"), "n"),
                       gap_seconds, n)


def _sessionize(rows: DataFrame, gap_seconds: int, n: int) -> DataFrame:
    e = (rows.repartitionByRange(n, "user_id", "ts").sortWithinPartitions("user_id", "ts"))
    # read twice below: written once, or a second run could sample other bounds
    part = materialize(e.mapInPandas(_make_local_sessions(gap_seconds * 1_000_000), OUT), "sessions")
    interior = part.filter(~F.col("edge")).drop("edge")
    edges = part.filter(F.col("edge")).drop("edge")
    w = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    new = (F.lag("session_end").over(w).isNull()
           | (F.col("session_start") - F.lag("session_end").over(w) > gap))
    merged = (edges.withColumn("_sid", F.sum(new.cast("int")).over(
                  w.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("user_id", "_sid")
              .agg(F.min("session_start").alias("session_start"),
                   F.max("session_end").alias("session_end"), F.sum("events").alias("events"))
              .drop("_sid"))
    return interior.unionByName(merged)
