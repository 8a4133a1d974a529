"""As-of join: every row with the latest version of its key that was valid by then (T-02).

A join on the key alone would pair each movement with every version of its
product.  Here both sides are dealt out together by key and a window carries
versions forward in time.  Where a key has more rows than a task should sort,
both are sorted into ranges of (key, time) instead, so a hot key is cut into
several; the window works within (range, key), and a range that begins inside a
key takes over the last version of the ranges before it, from a table with one
row a range.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.operators import ledger as L


def asof_join(rows: DataFrame, versions: DataFrame, key: str, time: str, valid_from: str,
              n_parts: int | None = None) -> DataFrame:
    """``rows`` with the other columns of the last row of ``versions`` of the same ``key`` with valid_from <= time.

    Nulls where no version was valid yet, or where key or time is null.  Of
    versions with the same key and time any one may count.
    """
    n = n_parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, n, _ = L._deal(rows.select(F.col(key).alias(L.KEY)), n, None if n_parts else L.ROWS_PER_CHUNK)
    values = [c for c in versions.columns if c not in (key, valid_from)]
    left = rows.select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_at"),
                       F.lit(1).alias("_side"))
    right = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.lit(0).alias("_side"),
        F.struct(*values).alias("_v"))
    keys = ["_key", "_at", "_side"]
    latest = lambda *by: F.last("_v", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    if not hot:                     # dealt out once, nothing kept
        found = (left.unionByName(right, allowMissingColumns=True).repartition(n, "_key")
                 .withColumn("_v", latest("_key")).where("_side = 1"))
        # the key as it was dealt out by, so a join on it sends nothing again
        return found.select(*[F.col("_key").alias(c) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns],
                            *[F.col("_v")[c].alias(c) for c in values])
    ranged = (left.unionByName(right, allowMissingColumns=True)
              .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_part", F.spark_partition_id()))
    # read twice: a lost block comes again from the same range shuffle
    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    place = F.struct("_key", "_at")
    last = ranged.groupBy("_part").agg(
        F.max_by(F.struct("_key", "_v"), F.when(F.col("_side") == 0, place)).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("_part", before.alias("_before")).select(
        "_part", F.col("_before._key").alias("_key"), F.col("_before._v").alias("_w"))
    found = (ranged.withColumn("_v", latest("_part", "_key")).where("_side = 1")
             .join(F.broadcast(carried), ["_part", "_key"], "left"))            # one row a range
    v = F.coalesce("_v", F.when(F.col("_at").isNotNull(), F.col("_w")))
    return found.select("_row.*", *[v[c].alias(c) for c in values])
