"""Structured Streaming jobs: ledger, alerts, audit ingest, activity, sessions, unread counts.

Sources are file streams over the parquet tables (``pathGlobFilter`` picks
one table out of a shared folder).  Every query writes with a checkpoint
under the shared checkpoint folder; given a ``name``, a restarted or failed
job of that name resumes from its last committed micro-batch.

Jobs that merge into stored tables get their micro-batches through
``run_batches``: a batch's rows become visible by one marker
(``sources.commits``), under the id that the batch keeps when it comes again,
so every movement, event and count has a single effect.  None of them keeps
what it has seen in memory or rewrites what it has stored: the state of the
ledger is the stored ledger, that of the audit log the log, and days and
sessions are stored as partial results that add up when read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from stockspark.functions import exprs as X
from stockspark.operators.ledger_store import LedgerStore
from stockspark.session import ensure_checkpoint_dir
from stockspark.sources.commits import CommitLog, is_folder

D12 = "decimal(12,2)"


# ------------------------------------------------------------------ plumbing
def table_stream(spark: SparkSession, sf_dir: str, table: str,
                 max_files_per_trigger: int | None = 1000) -> DataFrame:
    """File stream over ``{sf_dir}/{table}.parquet`` (schema taken from the file).

    ``maxFilesPerTrigger`` bounds a micro-batch (``availableNow`` honours it
    and splits a backlog into several batches)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_batches(stream: DataFrame, write, name: str | None = None, mode: str = "append") -> str:
    """Give every micro-batch available now to ``write(rows, folder, batch)``; returns the job's folder.

    ``batch`` is the same when a batch comes again after a crash; a ``write``
    that commits under it to a ``CommitLog`` of the folder has a single effect.
    """
    root = ensure_checkpoint_dir(stream.sparkSession)
    tag = name or f"q{uuid.uuid4().hex[:12]}"
    folder = f"{root}/stream-out/{tag}"
    (stream.writeStream.foreachBatch(lambda df, epoch: write(df, folder, f"epoch-{epoch}"))
     .option("checkpointLocation", f"{root}/stream-ckpt/{tag}").outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())
    return folder


def appending(table: str, rows_of=None, partition_by: tuple = ()):
    """A ``write`` for ``run_batches``: ``rows_of(batch's rows, log)`` goes to a table of the folder's log."""
    def write(df: DataFrame, folder: str, batch: str) -> None:
        log = CommitLog(df.sparkSession, folder)
        if not log.known(batch):
            log.put(table, df if rows_of is None else rows_of(df, log), batch, partition_by)
            log.commit(batch)
    return write


# ------------------------------------------------------------------ T-01 ledger
def movements_from_lineitem(li: DataFrame) -> DataFrame:
    """The movement mapping of the batch views, for a lineitem stream."""
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    mtype = (F.when(rf == "R", "return").when((rf == "N") & (ls == "O"), "stock_in")
             .when(rf == "N", "stock_out").when(ls == "O", "adjustment_in")
             .otherwise("adjustment_out"))
    qty = F.col("l_quantity").cast(D12)
    return li.select(F.col("l_partkey").alias("product_id"),
                     F.col("l_shipdate").alias("created_at"),
                     F.col("l_orderkey").alias("ord_key"), F.col("l_linenumber").alias("ord_line"),
                     mtype.alias("type"), qty.alias("quantity"),
                     X.signed_quantity(mtype, qty).alias("signed_qty"))


def run_ledger(movements: DataFrame, name: str | None = None) -> LedgerStore:
    """T-01: the refusing ledger, fed by a stream in any file order.

    A micro-batch is appended to the stored ledger, which folds the products
    in it from their stored balances: what is written per batch follows the
    rows in it.  A movement older than the stored ones corrects the balances
    behind it (``LedgerStore``; ``changes`` of a batch are its new and its
    corrected rows), so the result is the batch ledger's however late a file
    comes, and a batch repeated after a crash adds nothing.
    """
    folder = run_batches(movements, lambda df, path, batch: LedgerStore(df.sparkSession, path).append(df, batch), name)
    return LedgerStore(movements.sparkSession, folder)


# ------------------------------------------------------------------ T-02 alerts
def run_alerts(movements: DataFrame, products: DataFrame, minimums: DataFrame | None = None,
               name: str | None = None) -> DataFrame:
    """T-02: alerts of the streamed ledger, each by the minimum valid at its movement.

    Every batch adds the verdicts on its new and corrected rows; the last
    verdict on a movement counts, so a correction can raise or withdraw an
    alert.  Before the first batch there is nothing to withdraw, so its
    movements without an alert leave no verdict.
    """
    from stockspark.operators.alerts import stock_alerts
    keys = ["product_id", "created_at", "ord_key", "ord_line"]

    def write(df: DataFrame, folder: str, batch: str) -> None:
        store = LedgerStore(df.sparkSession, f"{folder}/ledger")
        store.append(df, batch)
        log = CommitLog(df.sparkSession, folder)
        changed = store.changes(batch)
        if changed is not None and not log.known(batch):
            alerts = stock_alerts(changed, products, minimums, keep=("_pos",))
            verdicts = changed.select(*keys).join(alerts, keys, "left") if log.batches() else alerts.dropna(subset=keys)
            log.put("verdicts", verdicts.withColumn("seq", F.lit(log.next_seq())), batch)
            log.commit(batch)
    folder = run_batches(movements, write, name)
    verdicts = CommitLog(movements.sparkSession, folder).get("verdicts")
    rest = [c for c in verdicts.columns if c not in (*keys, "seq", "_pos", "commit")]
    # where keys repeat, the last in the ledger's order counts, with versions the first; column by column, so those that
    # the caller drops are not sent
    place = F.struct("seq", F.col("_pos") if minimums is None else -F.col("_pos"))
    last = verdicts.groupBy(*keys).agg(*[F.max_by(F.struct(c), place).alias(c) for c in rest])
    return last.select(*keys, *[F.col(f"{c}.{c}") for c in rest]).where(F.col("level").isNotNull())


# ------------------------------------------------------------------ T-03 audit
def audit_rows(events: DataFrame, users: DataFrame) -> DataFrame:
    """Raw events as normalised audit rows."""
    from stockspark.operators.dims import audit_normalise
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"),
                     F.col("role").alias("user_role"))
    rows = events.join(u, F.col("user_id") == F.col("_uid"), "left").select(
        F.col("event_id").alias("id"), "user_id", "user_name", "user_role",
        F.col("event_type").alias("action"), F.lit("Events").alias("module"),
        F.get_json_object("props", "$.k").cast("bigint").alias("record_id"),
        F.col("props").alias("details"), F.lit(None).cast("string").alias("ip_address"),
        F.concat(F.lit("client/"), F.col("props")).alias("user_agent"),
        F.col("ts").alias("created_at"))
    return audit_normalise(rows)


def run_audit(events: DataFrame, users: DataFrame, name: str | None = None, horizon: str = "2 days") -> DataFrame:
    """T-03: audit rows, one for each event id, none lost or doubled however late its file.

    An event keeps its time when it is delivered again, so its copies share a
    day.  The log is stored by day, each batch's files sorted by id.  A batch
    looks up only the days it touches and the range of its ids there: once
    for the recent events (within ``horizon`` of the latest stored one) and
    once for the late ones, so one old event does not widen the look-up of
    the others.  There is no other state.
    """
    day = F.date_format("ts", "yyyy-MM-dd")

    def fresh(df: DataFrame, log: CommitLog) -> DataFrame:
        new = df.dropDuplicates(["event_id"]).withColumn("day", F.coalesce(day, F.lit("none")))
        stored = log.get("rows")
        if stored is not None:
            since = F.expr(f"to_timestamp_ntz('{log.get('high').agg(F.max('at')).first()[0]}') - interval {horizon}")
            out = None
            for tier in (F.col("ts") >= since, (F.col("ts") < since) | F.col("ts").isNull()):
                part = new.where(F.coalesce(tier, F.lit(False)))
                lo, hi, days = part.agg(F.min("event_id"), F.max("event_id"), F.collect_set("day")).first()
                if lo is not None:
                    seen = stored.where(F.col("day").isin(days) & F.col("id").between(lo, hi)).select(
                        F.col("id").alias("event_id"))
                    part = part.join(seen, "event_id", "left_anti")
                out = part if out is None else out.unionByName(part)
            new = out
        return new

    def write(df: DataFrame, folder: str, batch: str) -> None:
        log = CommitLog(df.sparkSession, folder)
        if log.known(batch):
            return
        df = df.persist()                        # read for both tiers and their ranges
        rows = audit_rows(fresh(df, log).drop("day"), users)
        rows = rows.withColumn("day", F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("none"))).persist()
        # ranges of (day, id): a day with many events has many files, each with a range of its ids
        log.put("rows", rows.repartitionByRange("day", "id").sortWithinPartitions("day", "id"), batch, ("day",))
        log.put("high", df.agg(F.max("ts").cast("string").alias("at")), batch)
        log.commit(batch)
        rows.unpersist()
        df.unpersist()
    folder = run_batches(events, write, name)
    return CommitLog(events.sparkSession, folder).get("rows").drop("day", "commit")


# ------------------------------------------------------------------ T-04 counts
def daily_counts(events: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy(day, "event_type").agg(F.count("*").alias("events"))


def add_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "event_type").agg(F.sum("events").alias("events"))


def run_daily_activity(events: DataFrame, name: str | None = None, compact_after: int = 50) -> DataFrame:
    """T-04: events per day and type, all days, whatever order the files come in.

    A batch stores its own counts by day; counts add up, so a late event is
    one more row and no stored day is rewritten.  ``compact_after`` batches
    are summed into one.
    """
    write = appending("counts", lambda df, _: daily_counts(df))

    def compacting(df: DataFrame, folder: str, batch: str) -> None:
        write(df, folder, batch)
        CommitLog(df.sparkSession, folder).compact("counts", add_counts, compact_after)
    folder = run_batches(events, compacting, name)
    return add_counts(CommitLog(events.sparkSession, folder).get("counts"))


# ------------------------------------------------------------------ T-05 sessions
def user_sessions(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """T-05 in batch: sessions end after more than ``gap_seconds`` of inactivity (range-partitioned sessionizer of
    ``operators.sessions``: hot users are split, only edge sessions merge)."""
    from stockspark.operators.sessions import user_sessions as batch_sessions
    return batch_sessions(events, gap_seconds)


def run_sessions(events: DataFrame, gap_seconds: int = 3600, name: str | None = None,
                 compact_after: int = 50) -> DataFrame:
    """T-05: the same from a stream.

    A batch stores its events summed by user and cell of the gap's length;
    cells add up, so a late event that extends a session or bridges two is
    one more row, and nothing stored is rewritten.  Sessions are cut from the
    summed cells when they are read; ``compact_after`` batches are summed into
    one.
    """
    from stockspark.operators import sessions as SE
    write = appending("cells", lambda df, _: SE.session_cells(df, gap_seconds))

    def compacting(df: DataFrame, folder: str, batch: str) -> None:
        write(df, folder, batch)
        CommitLog(df.sparkSession, folder).compact("cells", SE.add_cells, compact_after)
    folder = run_batches(events, compacting, name)
    return SE.sessions_of_cells(SE.add_cells(CommitLog(events.sparkSession, folder).get("cells")), gap_seconds)


# ------------------------------------------------------------------ T-06 unread counts
UNREAD_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("unread", T.LongType())])
UNREAD_STATE = T.StructType([T.StructField("read_at", T.LongType()), T.StructField("unread", T.ArrayType(T.LongType()))])
_NEVER = -(1 << 63)


def _unread_state_fn(key, batches, state):
    """One user: the last read mark and the times of the notifications after it."""
    read_at, unread = state.get if state.exists else (_NEVER, [])
    times = [np.asarray(unread, np.int64)]
    for pdf in batches:
        at = pdf["at"].to_numpy("datetime64[us]").astype(np.int64)
        mark = pdf["mark"].to_numpy(bool)
        if mark.any():
            read_at = max(read_at, int(at[mark].max()))
        times.append(at[~mark])
    times = np.concatenate(times)
    times = times[times > read_at]
    state.update((int(read_at), times.tolist()))
    yield pd.DataFrame({"user_id": [key[0]], "unread": [len(times)]})


def unread_stream(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """T-06: unread notifications per user, in update mode, from two streams.

    ``notifications`` (user_id, created_at) and ``marks`` (user_id, read_at:
    all up to then are read) meet in one state per user: the last mark and the
    times behind it, so the state shrinks with every mark and the order in
    which notifications and marks come does not matter.  A notification
    without a time can't be marked as read and is never counted as new.
    """
    both = (notifications.where("user_id IS NOT NULL AND created_at IS NOT NULL")
            .select("user_id", F.col("created_at").alias("at"), F.lit(False).alias("mark"))
            .unionByName(marks.where("user_id IS NOT NULL AND read_at IS NOT NULL")
                         .select("user_id", F.col("read_at").alias("at"), F.lit(True).alias("mark"))))
    return both.groupBy("user_id").applyInPandasWithState(
        _unread_state_fn, UNREAD_OUT, UNREAD_STATE, "update", GroupStateTimeout.NoTimeout)


def run_unread(notifications: DataFrame, marks: DataFrame, name: str | None = None) -> DataFrame:
    """The counts after all that is available now; users with none unread have 0."""
    write = appending("counts", lambda df, log: df.withColumn("seq", F.lit(log.next_seq())))
    folder = run_batches(unread_stream(notifications, marks), write, name, mode="update")
    counts = CommitLog(notifications.sparkSession, folder).get("counts")
    return counts.groupBy("user_id").agg(F.max_by("unread", "seq").alias("unread"))
