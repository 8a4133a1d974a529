"""Native Column helpers (no Python UDFs): classes, labels, numbers, dates.

Every helper returns a Column built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  Thresholds are compared in exact
decimal(12,2) arithmetic, never in double.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockspark import constants as K

D12 = "decimal(12,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_value(v) -> Column:
    """Literal that keeps datetimes zone-free (TIMESTAMP_NTZ), matching the
    NTZ columns of the tables whatever the session time zone is."""
    import datetime as _dt
    if isinstance(v, _dt.datetime):
        return F.expr(f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'")
    return F.lit(v)


# ------------------------------------------------------------------ stock rules
def signed_quantity(mtype, qty) -> Column:
    """Out types subtract; every other type (return, unknown) adds."""
    q = _c(qty)
    return F.when(_c(mtype).isin(K.OUT_TYPES), -q).otherwise(q).cast(D12)


def available(current="current_stock", reserved="reserved_stock") -> Column:
    return (_c(current) - _c(reserved)).cast(D12)


def critical_bound(min_level="min_stock_level") -> Column:
    return _c(min_level) * F.lit(K.CRITICAL_FACTOR)


def is_low(current="current_stock", min_level="min_stock_level") -> Column:
    """Inclusive: current <= min (with min = 0 and current = 0 also low)."""
    return _c(current) <= _c(min_level)


def is_critical(current="current_stock", min_level="min_stock_level") -> Column:
    """Inclusive: current <= 0.3 * min, in decimal."""
    return _c(current) <= critical_bound(min_level)


def stock_class(current="current_stock", min_level="min_stock_level") -> Column:
    """Three tiers: Critical / Low / Good."""
    return (F.when(is_critical(current, min_level), "Critical")
            .when(is_low(current, min_level), "Low").otherwise("Good"))


def alert_class(current="current_stock", min_level="min_stock_level") -> Column:
    """Two tiers on low items (export report): CRITICAL / LOW, inclusive."""
    return F.when(is_critical(current, min_level), "CRITICAL").otherwise("LOW")


def alert_level_strict(balance, min_level) -> Column:
    """The per-movement alert uses a strict bound for CRITICAL."""
    return F.when(_c(balance) < critical_bound(min_level), "CRITICAL").otherwise("LOW")


def urgency_ratio(current="current_stock", min_level="min_stock_level") -> Column:
    """current / NULLIF(min, 0), computed in double (NULL when min = 0)."""
    m = _c(min_level).cast("double")
    return _c(current).cast("double") / F.nullif(m, F.lit(0.0))


def coverage_pct(current="current_stock", min_level="min_stock_level") -> Column:
    """Percent of the minimum on hand, capped at 100; 100 when min is 0."""
    cur = _c(current).cast("double")
    m = _c(min_level).cast("double")
    return F.when(m > 0, F.least(F.lit(100.0), cur / m * 100.0)).otherwise(F.lit(100.0))


def in_out_split(mtype="type", qty="quantity"):
    """(qty_in, qty_out) columns by movement type."""
    t, q = _c(mtype), _c(qty)
    zero = F.lit(0).cast(D12)
    return (F.when(t.isin(K.IN_TYPES), q).otherwise(zero).cast(D12),
            F.when(t.isin(K.OUT_TYPES), q).otherwise(zero).cast(D12))


# ------------------------------------------------------------------ labels
def ucfirst(c) -> Column:
    """Capitalise only the first letter (rest unchanged)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def label(c, mapping: dict, default=None) -> Column:
    """Map lookup with a default: unknown codes fall back to ``default``
    (a Column) or to the code with its first letter capitalised."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    fallback = ucfirst(c) if default is None else default
    return F.coalesce(F.element_at(m, _c(c)), fallback)


def movement_label(c="type") -> Column:
    return label(c, K.MOVEMENT_LABELS)


def status_label(c="status") -> Column:
    return label(c, K.STATUS_LABELS)


def role_label(c="role") -> Column:
    return label(c, K.ROLE_LABELS)


def priority_label(c="priority") -> Column:
    return label(c, K.PRIORITY_LABELS)


def action_severity(c="action") -> Column:
    return label(c, K.ACTION_SEVERITY, F.lit("gray"))


# ------------------------------------------------------------------ numbers / text
def product_code(k) -> Column:
    return F.format_string("P-%04d", _c(k))


def formatted_number(prefix, n) -> Column:
    """PREFIX-0001; grows past 9999 (no truncation, unlike lpad)."""
    return F.format_string("%s-%04d", _c(prefix), _c(n))


def number_seq(number) -> Column:
    """Last dash-separated part as a long (NUM-2024-0042 -> 42)."""
    return F.element_at(F.split(_c(number), "-"), -1).cast("bigint")


def initials(name) -> Column:
    """Upper-cased first letters of the first two words."""
    words = F.slice(F.split(_c(name), " "), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def first_name(name) -> Column:
    return F.element_at(F.split(_c(name), " "), 1)


def blank_to(c, default) -> Column:
    """``x ?: default``: NULL or blank -> default."""
    c = _c(c)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(default)).otherwise(c)


def thousands(c, decimals: int) -> Column:
    """Thousands-separated text with half-up rounding first."""
    return F.format_number(F.round(_c(c).cast("double") if decimals == 0 else _c(c), decimals),
                           decimals)


# ------------------------------------------------------------------ dates
def fmt_date(c) -> Column:
    """'d M Y' e.g. 05 Mar 2025; NULL -> em dash."""
    return F.coalesce(F.date_format(_c(c), "dd MMM yyyy"), F.lit("—"))


def fmt_datetime(c) -> Column:
    """'d M Y, h:i A' e.g. 05 Mar 2025, 02:07 PM; NULL -> em dash."""
    return F.coalesce(F.date_format(_c(c), "dd MMM yyyy, hh:mm a"), F.lit("—"))


def month_label(c) -> Column:
    return F.date_format(_c(c), "MMM yyyy")


def time_ago(ts, now) -> Column:
    """Relative age text with the 60 / 3600 / 86400 / 604800 s ladder."""
    diff = F.unix_timestamp(_c(now).cast("timestamp")) - F.unix_timestamp(_c(ts).cast("timestamp"))
    return (F.when(diff < 60, F.lit("just now"))
            .when(diff < 3600, F.concat(F.floor(diff / 60).cast("string"), F.lit(" mins ago")))
            .when(diff < 86400, F.concat(F.floor(diff / 3600).cast("string"), F.lit(" hours ago")))
            .when(diff < 604800, F.concat(F.floor(diff / 86400).cast("string"), F.lit(" days ago")))
            .otherwise(fmt_date(ts)))
