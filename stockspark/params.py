"""Frozen run parameters: every time-dependent operator takes ``as_of``."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # "now" for requests and the ledger; the audit log has its own clock
    as_of: dt.date = dt.date(2001, 8, 1)
    audit_as_of: dt.date = dt.date(2024, 1, 30)
    # report window (closed on both ends, compared on DATE(ts))
    date_from: dt.date = dt.date(1995, 1, 1)
    date_to: dt.date = dt.date(2001, 12, 31)
    audit_from: dt.date = dt.date(2024, 1, 1)
    audit_to: dt.date = dt.date(2024, 1, 31)
    department: str | None = None
    page: int = 1
    per_page: int = 25
    audit_per_page: int = 50

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
