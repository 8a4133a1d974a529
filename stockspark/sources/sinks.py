"""Sinks: ledger append (S-04), CSV export with manifest (S-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.sources.commits import CommitLog

#: Rows of one file of the ledger, and of one task that writes it.
ROWS_PER_FILE = 1_000_000


def by_month(movements: DataFrame, n_rows: int | None = None, *more: str) -> DataFrame:
    """Rows dealt to tasks by ranges of (month, product, time): a file holds a range of one month, a month with
    many rows has many files, and a small one shares a task with its neighbours."""
    spark = movements.sparkSession
    n = movements.count() if n_rows is None else n_rows
    parts = max(1, min(spark.sparkContext.defaultParallelism, n // 10_000), -(-n // ROWS_PER_FILE))
    keys = ["txn_month", "product_id", "created_at", *more]
    return (movements.withColumn("txn_month", F.date_format("created_at", "yyyy-MM"))
            .repartitionByRange(parts, *keys).sortWithinPartitions(*keys))


def append_ledger(movements: DataFrame, path: str, batch_id: str) -> bool:
    """S-04: append a batch of movements as Parquet partitioned by transaction month.

    Rows are sorted by product inside each file (min/max statistics prune by
    product).  Returns whether anything was added: a batch whose id is
    committed already adds nothing, and one that failed before its commit is
    written anew (see ``CommitLog``).
    """
    log = CommitLog(movements.sparkSession, path)
    if batch_id in log.batches():
        return False
    log.put("rows", by_month(movements), batch_id, ("txn_month",))
    log.commit(batch_id)
    return True


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed movements, with ``batch`` and ``txn_month``; None before the first batch."""
    return CommitLog(spark, path).get("rows")


def write_csv(report: DataFrame, path: str, manifest: DataFrame | None = None) -> None:
    """S-12: rows as header CSV written in parallel by the executors; the
    preamble (title, period, author) and trailer (record count) go to a
    one-row manifest next to it instead of being funnelled through one
    writer."""
    report.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").option("header", True).csv(
            f"{path}/manifest")
