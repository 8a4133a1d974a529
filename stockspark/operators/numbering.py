"""Sequence numbers without a single-partition global sort (W-01, W-02).

``number_rows`` gives each row its 1-based rank in a total order plus a
counter base, formatted ``PREFIX-0001``.  Plan: range-partition on the order
key (sample-based bounds split hot values), sort within partitions, take
the in-partition position from ``monotonically_increasing_id`` (partition id
in the upper bits, position in the lower 33), count rows per partition,
turn the counts into offsets over a table with one row per partition, and
add.  Only that per-partition table (size = number of partitions, a bound
known up front) is broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions import exprs as X
from stockspark.session import ensure_checkpoint_dir


def rank_rows(df: DataFrame, order_cols, out: str = "seq", base: int = 0,
              n_parts: int | None = None, reliable: bool = False, keep: Column | None = None) -> DataFrame:
    """Add ``out`` = base + global 1-based position in ``order_cols`` order.

    ``order_cols`` must be a total order (unique) for the numbers to be
    deterministic.  With ``keep`` all rows are ranked and those it holds for
    returned; the others travel with their order columns alone.
    """
    columns = df.columns
    if keep is not None:
        rest = [c for c in columns if c not in order_cols]
        df = df.select(*order_cols, F.when(keep, F.struct(F.lit(True).alias("_kept"), *rest)).alias("_row"))
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Materialise once: the count job and the numbering job must see the same
    # partition ids and positions.  A lost block is recomputed through the same
    # range-shuffle dependency and a deterministic sort (total order), so the
    # numbers are stable; ``reliable`` checkpoints into the shared folder.
    if reliable:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    else:
        ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
        ranged.count()
    pid = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid") - F.shiftleft(pid, 33)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    placed = (ranged if keep is None else ranged.where(F.col("_row").isNotNull())).join(
        F.broadcast(offsets), pid == F.col("_pid")).withColumn(out, F.lit(base) + F.col("_off") + local + 1)
    if keep is not None:
        return placed.select(*[c if c in order_cols else F.col(f"_row.{c}").alias(c) for c in columns], out)
    return placed.drop("_mid", "_pid", "_off")


def number_rows(df: DataFrame, order_cols, prefix: str, out: str = "number",
                base: int = 0, n_parts: int | None = None, keep: Column | None = None) -> DataFrame:
    """W-01: PREFIX-0001 style numbers continuing from a counter ``base``; ``keep``: see ``rank_rows``."""
    ranked = rank_rows(df, order_cols, "_seq", base, n_parts, keep=keep)
    return ranked.withColumn(out, X.formatted_number(F.lit(prefix), F.col("_seq"))).drop("_seq")


def number_by_year(df: DataFrame, ts_col: str, tie_cols, prefix: str,
                   existing: DataFrame | None = None, out: str = "number") -> DataFrame:
    """W-02: PREFIX-YYYY-0001, restarting every year and continuing after the
    latest existing number of that year (K-07: the number with the highest
    ``id`` among ``existing`` rows whose number starts with PREFIX-YYYY-).

    Per-year position = global rank in (year, ts, ties) minus the rows of
    earlier years; the year table is tiny, so no window spans a whole year.
    """
    with_year = df.withColumn("_year", F.year(ts_col))
    ranked = rank_rows(with_year, ["_year", ts_col, *tie_cols], "_g")
    per_year = with_year.groupBy("_year").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    before = per_year.select("_year", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    out_df = ranked.join(F.broadcast(before), "_year")
    if existing is not None:
        parts = F.split("number", "-")
        prev = (existing
                .filter(F.col("number").startswith(F.lit(prefix + "-")))
                .select(F.element_at(parts, -2).cast("int").alias("_year"),
                        X.number_seq("number").alias("_s"), "id")
                .groupBy("_year").agg(F.max_by("_s", "id").alias("_last")))
        out_df = out_df.join(prev, "_year", "left")
    else:
        out_df = out_df.withColumn("_last", F.lit(0))
    seq = F.coalesce(F.col("_last"), F.lit(0)) + F.col("_g") - F.col("_before")
    return (out_df.withColumn(out, F.format_string("%s-%d-%04d", F.lit(prefix),
                                                   F.col("_year"), seq))
            .drop("_year", "_g", "_before", "_last"))
