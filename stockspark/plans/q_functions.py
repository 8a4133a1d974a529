"""Catalog entries: scalar functions and derived columns (F-01..F-17, P-14/15/18)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.plans.catalog import CRIT, LOW, dbl, register, sql_case, sql_ucfirst, with_views

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)


@register("available_stock", with_views(f"""
select id, {dbl('current_stock')}, {dbl('reserved_stock')},
  cast(current_stock - reserved_stock as double) available from products
""", "products"))
def available_stock(v, p):
    """P-14: available = current - reserved."""
    return v.products.select("id", "current_stock", "reserved_stock",
                             X.available().alias("available"))


@register("stock_class", with_views(f"""
select id, case when {CRIT} then 'Critical' when {LOW} then 'Low' else 'Good' end stock_class
from products p
""", "products"))
def stock_class(v, p):
    """P-15: three-tier class in exact decimal (Critical <= 0.3*min < Low <= min)."""
    return v.products.select("id", X.stock_class().alias("stock_class"))


@register("stock_coverage", with_views("""
select id, case when min_stock_level > 0
  then least(100.0, cast(current_stock as double) / cast(min_stock_level as double) * 100.0)
  else 100.0 end coverage_pct
from products
""", "products"))
def stock_coverage(v, p):
    """F-13: coverage percent capped at 100; 100 when min is 0."""
    return v.products.select("id", X.coverage_pct().alias("coverage_pct"))


def _labels_sql():
    parts = []
    for kind, col, table, mapping, default in [
            ("movement", "type", "movements", K.MOVEMENT_LABELS, None),
            ("issue_status", "status", "issue_requests", K.STATUS_LABELS, None),
            ("indent_status", "status", "indents", K.STATUS_LABELS, None),
            ("role", "role", "users", K.ROLE_LABELS, None),
            ("priority", "priority", "indents", K.PRIORITY_LABELS, None),
            ("action", "action", "audit_log", K.ACTION_SEVERITY, "'gray'")]:
        d = default or sql_ucfirst("code")
        parts.append(f"select distinct '{kind}' kind, code, {sql_case('code', mapping, d)} label "
                     f"from (select {col} code from {table}) x")
    return "\nunion all ".join(parts)


@register("label_map", with_views(_labels_sql(), "movements", "issue_requests", "indents",
                                  "users", "audit_log"))
def label_map(v, p):
    """P-18/F-17: code -> label maps with capitalised or grey defaults."""
    def one(kind, df, col, fn):
        return df.select(F.lit(kind).alias("kind"), F.col(col).alias("code")).distinct() \
                 .withColumn("label", fn("code"))
    parts = [one("movement", v.movements, "type", X.movement_label),
             one("issue_status", v.issue_requests, "status", X.status_label),
             one("indent_status", v.indents, "status", X.status_label),
             one("role", v.users, "role", X.role_label),
             one("priority", v.indents, "priority", X.priority_label),
             one("action", v.audit_log, "action", X.action_severity)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("fn_string", with_views("""
select id, trim(name) name_trim, lower(name) name_lower, upper(name) name_upper,
  substr(name, 1, 50) name_cut
from users
""", "users"))
def fn_string(v, p):
    """F-01/F-02: trim, lower, upper, prefix cut to 50 characters."""
    n = F.col("name")
    return v.users.select("id", F.trim(n).alias("name_trim"), F.lower(n).alias("name_lower"),
                          F.upper(n).alias("name_upper"), F.substring(n, 1, 50).alias("name_cut"))


@register("fn_numbering", with_views("""
select p_partkey id, printf('P-%04d', p_partkey) product_code,
  cast(string_split(printf('P-%04d', p_partkey), '-')[-1] as int) seq,
  printf('%s-%04d', 'TXN', p_partkey * 7) txn_like
from part
""", ))
def fn_numbering(v, p):
    """F-03/F-04: zero-padded numbers (grow past 9999) and parsing the sequence back."""
    pb = v.product_base
    return pb.select("id", "product_code", X.number_seq("product_code").alias("seq"),
                     X.formatted_number(F.lit("TXN"), F.col("id") * 7).alias("txn_like"))


@register("fn_initials", with_views("""
select id, array_to_string(list_transform(string_split(name, ' ')[1:2],
                                          lambda w: upper(substr(w, 1, 1))), '') initials,
  string_split(name, ' ')[1] first_name
from users
""", "users"))
def fn_initials(v, p):
    """F-05: initials of the first two words and the first name."""
    return v.users.select("id", X.initials("name").alias("initials"),
                          X.first_name("name").alias("first_name"))


@register("fn_date", with_views("""
select id, cast(cast(created_at as date) as varchar) "day",
  cast(cast(cast(created_at as date) - interval 6 month as date) as varchar) minus_6_months,
  cast(cast(cast(created_at as date) + interval 7 day as date) as varchar) plus_7_days,
  cast(cast(date_trunc('month', created_at) as date) as varchar) month_start,
  strftime(created_at, '%d %b %Y') fmt_date, strftime(created_at, '%b %Y') month_label
from issue_requests
""", "issue_requests"))
def fn_date(v, p):
    """F-07..F-10: DATE(), -6 months, +7 days, month start, 'd M Y' and 'M Y' text."""
    d = F.to_date("created_at")
    return v.issue_requests.select(
        "id", d.alias("day"), F.add_months(d, -6).alias("minus_6_months"),
        F.date_add(d, 7).alias("plus_7_days"), F.trunc(d, "month").alias("month_start"),
        X.fmt_date("created_at").alias("fmt_date"), X.month_label("created_at").alias("month_label"))


@register("fn_time_ago", with_views(f"""
with d as (select id, created_at,
             cast(floor(epoch(timestamp '{NOW}')) - floor(epoch(created_at)) as bigint) diff
           from audit_log)
select id, case when diff < 60 then 'just now'
  when diff < 3600 then cast(cast(floor(diff / 60) as bigint) as varchar) || ' mins ago'
  when diff < 86400 then cast(cast(floor(diff / 3600) as bigint) as varchar) || ' hours ago'
  when diff < 604800 then cast(cast(floor(diff / 86400) as bigint) as varchar) || ' days ago'
  else strftime(created_at, '%d %b %Y') end time_ago
from d
""", "audit_log"))
def fn_time_ago(v, p):
    """F-11: relative age text against a fixed 'now'."""
    return v.audit_log.select("id", X.time_ago("created_at", X.lit_value(NOW)).alias("time_ago"))


@register("fn_math", with_views("""
select id, cast(ceil(cast(current_stock as double) / 10) as bigint) ceil_tens,
  cast(floor(cast(current_stock as double) / 10) as bigint) floor_tens,
  cast(round(unit_price, 0) as double) price_rounded,
  cast(least(current_stock, min_stock_level) as double) least_cm,
  cast(greatest(current_stock, min_stock_level) as double) greatest_cm,
  cast(current_stock as double) / nullif(cast(min_stock_level as double), 0) ratio
from products
""", "products"))
def fn_math(v, p):
    """F-12/F-14: ceil, floor, round (half up), least, greatest, NULLIF-guarded ratio."""
    cur = F.col("current_stock")
    return v.products.select(
        "id", F.ceil(cur.cast("double") / 10).cast("bigint").alias("ceil_tens"),
        F.floor(cur.cast("double") / 10).cast("bigint").alias("floor_tens"),
        F.round("unit_price", 0).alias("price_rounded"),
        F.least(cur, F.col("min_stock_level")).alias("least_cm"),
        F.greatest(cur, F.col("min_stock_level")).alias("greatest_cm"),
        X.urgency_ratio().alias("ratio"))


@register("fn_format", with_views("""
select id, format('{:,.2f}', current_stock) stock_text,
  format('{:,.0f}', round(cast(unit_price as double) * 100)) price_cents_text
from products
""", "products"))
def fn_format(v, p):
    """F-15: thousands-separated text, 2 decimals or 0 (half-up rounding first)."""
    return v.products.select("id", X.thousands("current_stock", 2).alias("stock_text"),
                             X.thousands(F.col("unit_price").cast("double") * 100, 0)
                             .alias("price_cents_text"))


@register("fn_json", with_views("""
select id, to_json({'id': id, 'name': name, 'username': username, 'department': department,
                    'role': role, 'status': status}) json
from users
""", "users"))
def fn_json(v, p):
    """F-16: row -> JSON (credential columns are not part of the view)."""
    u = v.users
    return u.select("id", F.to_json(F.struct("id", "name", "username", "department", "role",
                                             "status"), {"ignoreNullFields": "false"})
                    .alias("json"))
