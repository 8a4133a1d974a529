"""Pages over filtered lists (L-03..L-05) and page arithmetic (L-04).

``page`` sorts by a total order and takes rows (offset, offset+n]: Spark
plans ``orderBy().offset().limit()`` as a top-k (TakeOrderedAndProject)
over offset+n rows, so a shallow page never sorts the whole list.  For deep
pages ``keyset_page`` filters on the last seen sort key instead, which is a
pushed-down predicate plus a top-k of n rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.functions.exprs import lit_value


def page(df: DataFrame, order: list[Column], page_no: int, per_page: int) -> DataFrame:
    offset = max(0, (page_no - 1) * per_page)
    return df.orderBy(*order).offset(offset).limit(per_page)


def with_total(rows: DataFrame, filtered: DataFrame) -> DataFrame:
    """Attach the list's match count (A-14) as a scalar subquery."""
    return rows.withColumn("total", filtered.agg(F.count("*")).scalar())


def keyset_after(sort_cols: list[str], last: tuple, descending: bool = True) -> Column:
    """Predicate 'row comes after ``last`` in the (sort_cols) order'."""
    conds = []
    for i, c in enumerate(sort_cols):
        eq = [F.col(sort_cols[j]) == lit_value(last[j]) for j in range(i)]
        cmp = F.col(c) < lit_value(last[i]) if descending else F.col(c) > lit_value(last[i])
        conds.append(reduce(lambda a, b: a & b, eq, cmp))
    return reduce(or_, conds)


def page_info(totals: DataFrame, page_no: int, per_page: int) -> DataFrame:
    """L-04: pages = ceil(total / n); links p-2..p+2 clipped; none if <= 1 page."""
    pages = F.ceil(F.col("total") / F.lit(per_page)).cast("int")
    lo = F.greatest(F.lit(1), F.lit(page_no - 2))
    hi = F.least(pages, F.lit(page_no + 2))
    links = F.when(pages > 1, F.array_join(F.sequence(lo, F.greatest(lo, hi)).cast(
        "array<string>"), ",")).otherwise(F.lit(""))
    return totals.select(
        "list", "total", pages.alias("pages"), F.lit(page_no).alias("page"),
        links.alias("links"),
        (F.lit(page_no) > 1).alias("has_prev"), (F.lit(page_no) < pages).alias("has_next"))
