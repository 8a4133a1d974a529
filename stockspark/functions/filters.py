"""Predicates: optional-filter conjunction, date windows, search, visibility."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conjunction(conds) -> Column:
    """P-02: AND of the conditions that are set (None entries are skipped)."""
    return reduce(and_, [c for c in conds if c is not None], F.lit(True))


def date_range(c, date_from: dt.date, date_to: dt.date) -> Column:
    """P-03: DATE(c) BETWEEN from AND to.  Catalyst rewrites the date cast
    into a timestamp range and pushes it to the Parquet scan."""
    d = F.to_date(_c(c))
    return d.between(F.lit(date_from), F.lit(date_to))


def date_bound(c, date_from: dt.date | None = None, date_to: dt.date | None = None) -> Column:
    """P-04: optional half-open bounds on DATE(c)."""
    d = F.to_date(_c(c))
    return conjunction([d >= F.lit(date_from) if date_from else None,
                        d <= F.lit(date_to) if date_to else None])


def like_pattern(term: str) -> str:
    """LIKE %term% with the user's % and _ left as wildcards."""
    return f"%{term}%"


def search(cols, term: str | None, accent_insensitive: bool = False) -> Column:
    """P-08: OR of case-insensitive substring matches over ``cols``.

    ``accent_insensitive`` compares under the UNICODE_CI_AI collation
    (``contains``), matching 'cafe' against 'Café'."""
    if not term:
        return F.lit(True)
    if accent_insensitive:
        conds = [F.contains(F.collate(_c(c), "UNICODE_CI_AI"), F.lit(term)) for c in cols]
    else:
        conds = [_c(c).ilike(like_pattern(term)) for c in cols]
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conds])


def visible_to(viewer_role, viewer_id, owner_col="employee_id") -> Column:
    """P-12: employees see their own requests, every other role sees all."""
    return (_c(viewer_role) != F.lit("employee")) | (_c(owner_col) == _c(viewer_id))
