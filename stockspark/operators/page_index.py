"""Deep pages by an order-statistic index (L-03, A-14).

A list that is paged through is stored once in its order, cut into ranges; the
index has one row a range: its rows.  Any page is then found by arithmetic on
the ranges' running sums: a page reads the ranges it lies in (mostly one, two
where it crosses an edge) and of those the rows at its positions only, page
one or page a million alike, and the match count is the index's sum.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.sources.commits import CommitLog

#: Rows of one range.
ROWS_PER_RANGE = 1_000_000


class PagedList:
    """A stored list; ``build`` writes it unless it is there already."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def build(self, rows: DataFrame, order: list[Column]) -> PagedList:
        """``order`` must be total for pages not to overlap."""
        if self.log.known("list"):
            return self
        total = rows.count()
        n = max(self.spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_RANGE))
        ranged = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumn("_id", F.monotonically_increasing_id()))
        placed = ranged.select("*", F.shiftright("_id", 33).cast("int").alias("_range"),
                               F.col("_id").bitwiseAND((1 << 33) - 1).alias("_pos")).drop("_id")
        self.log.put("rows", placed, "list", ("_range",))
        counts = self.log.get("rows", ["list"]).groupBy("_range").agg(F.count("*").alias("n")) if total else \
            self.spark.createDataFrame([], "_range int, n long")
        self.log.put("index", counts.coalesce(1), "list")
        self.log.commit("list")
        return self

    def _index(self) -> list[tuple[int, int]]:
        """(range, rows) in order: one row a range."""
        return sorted((r["_range"], r["n"]) for r in self.log.get("index").collect())

    def total(self) -> int:
        return sum(n for _, n in self._index())

    def page(self, page_no: int, per_page: int) -> DataFrame:
        """The page's rows with ``position`` (from 0) and ``total``; empty behind the last page."""
        index = self._index()
        starts = [0, *accumulate(n for _, n in index)]
        lo = max(0, (page_no - 1) * per_page)
        hi = min(lo + per_page, starts[-1])
        rows = self.log.get("rows")
        first, last = bisect_right(starts, lo) - 1, bisect_right(starts, max(lo, hi - 1)) - 1
        wanted = F.lit(False)
        start = F.lit(0)
        for k in range(first, min(last, len(index) - 1) + 1):       # the ranges that the page lies in
            here = F.col("_range") == index[k][0]
            wanted |= here & F.col("_pos").between(max(0, lo - starts[k]), hi - starts[k] - 1)
            start = F.when(here, F.lit(starts[k])).otherwise(start)
        return (rows.where(wanted).withColumn("position", (start + F.col("_pos")).cast("long"))
                .withColumn("total", F.lit(starts[-1]).cast("long")).drop("_range", "_pos", "commit"))
