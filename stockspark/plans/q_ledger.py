"""Catalog entries: the stock ledger (K-01..K-03, Q-06), alerts, notifications."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.operators import alerts as AL
from stockspark.operators import ledger as L
from stockspark.operators.ledger_store import LedgerStore
from stockspark.plans.catalog import ORACLE, dbl, register, with_views
from stockspark.session import ensure_checkpoint_dir
from stockspark.sources.sinks import append_ledger, read_ledger

MV_KEYS = "product_id, created_at, ord_key, ord_line"


@register("running_balance", with_views(f"""
select {MV_KEYS}, type, {dbl('signed_qty')},
  cast(sum(signed_qty) over w - signed_qty as double) balance_before,
  cast(sum(signed_qty) over w as double) balance_after
from movements
window w as (partition by product_id order by created_at, ord_key, ord_line
             rows between unbounded preceding and current row)
""", "movements"))
def running_balance(v, p):
    """K-01: running balance per product, nothing refused (chunked prefix sums)."""
    return L.running_balance(v.movements).select(
        "product_id", "created_at", "ord_key", "ord_line", "type", "signed_qty",
        "balance_before", "balance_after")


@register("ledger_apply", with_views(f"""
select {MV_KEYS}, type, {dbl('quantity')}, {dbl('balance_before')}, {dbl('balance_after')},
  accepted
from ledger
""", "ledger"))
def ledger_apply(v, p):
    """K-02: refusing running balance (movements that would go negative are refused)."""
    return L.ledger_apply(v.movements).select("product_id", "created_at", "ord_key", "ord_line", "type", "quantity",
                                              "balance_before", "balance_after", "accepted")


@register("ledger_store", ORACLE["ledger_apply"])
def ledger_store(v, p):
    """S-04/S-11: the ledger read back from a store that got its movements in four batches, one of them late, one
    twice."""
    store = LedgerStore(v.spark, f"{ensure_checkpoint_dir(v.spark)}/ledger-batches/{uuid.uuid4().hex}")
    m, year = v.movements, F.year("created_at")
    late = (year == 1995) & (F.col("ord_key") % 50 == 7)
    for name, part in (("to 1995", (year <= 1995) & ~late), ("1996", year == 1996), ("1996", year == 1996),
                       ("from 1997", year > 1996), ("late", late)):
        store.append(m.where(part), name)
    return store.rows().select("product_id", "created_at", "ord_key", "ord_line", "type", "quantity",
                               "balance_before", "balance_after", "accepted")


@register("ledger_files", with_views(f"select {MV_KEYS}, type, {dbl('quantity')} from movements", "movements"))
def ledger_files(v, p):
    """S-04: movements appended to monthly files in two batches, the first twice, and read back."""
    path = f"{ensure_checkpoint_dir(v.spark)}/ledger-files/{uuid.uuid4().hex}"
    m, early = v.movements, F.year("created_at") < 1995
    for name, part in (("early", early), ("early", early), ("rest", ~early)):
        append_ledger(m.where(part), path, name)
    return read_ledger(v.spark, path).select("product_id", "created_at", "ord_key", "ord_line", "type", "quantity")


@register("stock_snapshot", with_views("""
select product_id, cast(current_stock as double) current_stock from stock
""", "stock"))
def stock_snapshot(v, p):
    """K-03: last balance per product."""
    return v.store.snapshot()


@register("ledger_reconcile", with_views("""
with net as (select product_id, sum(signed_qty) net from movements group by product_id),
chk as (
  select product_id, cast(created_at as varchar) || '|' || ord_key || '|' || ord_line row_key,
    balance_before, balance_after, accepted, signed_qty,
    lag(balance_after) over (partition by product_id order by created_at, ord_key, ord_line) prev
  from ledger)
select product_id, row_key, 'after_mismatch' rule from chk
  where balance_after <> case when accepted then balance_before + signed_qty else balance_before end
union all
select product_id, row_key, 'chain_break' from chk
  where prev is not null and balance_before <> prev
union all
select product_id, row_key, 'negative' from chk where balance_after < 0
union all
select coalesce(n.product_id, s.product_id), null, 'snapshot_mismatch'
from net n full outer join stock s on n.product_id = s.product_id
where n.net is distinct from s.current_stock and not (s.current_stock is null and n.net = 0)
""", "ledger", "stock", "movements"))
def ledger_reconcile(v, p):
    """Q-06: ledger consistency; the plain net balance checked against the ledger snapshot."""
    net = v.net_stock()
    r = L.reconcile(v.ledger, snapshot=net)
    key = F.concat_ws("|", F.col("created_at").cast("string"), F.col("ord_key").cast("string"),
                      F.col("ord_line").cast("string"))
    return r.select("product_id", F.when(F.col("ord_key").isNotNull(), key).alias("row_key"),
                    "rule")


@register("opening_movements", with_views("""
select id product_id, 'TXN-OP-' || cast(id as varchar) txn_number, 'stock_in' type,
  cast(current_stock as double) quantity, cast(0 as double) balance_before,
  cast(current_stock as double) balance_after, 'OPENING' reference_number,
  'opening' reference_type, 'Opening stock' remarks
from products where current_stock > 0
""", "products"))
def opening_movements(v, p):
    """S-07: opening stock_in movement for every product holding stock."""
    from stockspark.operators.dims import opening_movements as om
    return om(v.products)


# ---------------------------------------------------------------- alerts
ALERTS_SQL = """
select l.product_id, l.created_at, l.ord_key, l.ord_line, l.balance_after, p.min_stock_level,
  case when l.balance_after < p.min_stock_level * 0.3 then 'CRITICAL' else 'LOW' end lvl,
  p.name product, p.unit
from ledger l join products p on p.id = l.product_id
where l.accepted and l.balance_after <= p.min_stock_level"""


@register("stock_alerts", with_views("""
select product_id, created_at, ord_key, ord_line, cast(balance_after as double) balance_after,
  cast(min_stock_level as double) min_stock_level, lvl "level",
  '⚠️ ' || lvl || ' Stock: ' || product title,
  product || ' has only ' || cast(balance_after as varchar) || ' ' || unit || ' (Min: '
    || cast(min_stock_level as varchar) || ')' body,
  case when lvl = 'CRITICAL' then 'danger' else 'warning' end "type",
  'inventory.php' link
from alerts
""", "ledger", "products", extra=[("alerts", ALERTS_SQL)]))
def stock_alerts(v, p):
    """R-06: one alert per accepted movement ending at or below the minimum."""
    return AL.stock_alerts(v.ledger, v.product_base)


@register("alert_fanout", with_views("""
select u.id user_id, u.name, u.role, t.alerts, t.critical_alerts, t.last_alert_at
from users u,
  (select count(*) alerts, count(*) filter (where lvl = 'CRITICAL') critical_alerts,
          max(created_at) last_alert_at from alerts) t
where u.role in ('admin', 'keeper') and u.status = 'active'
""", "ledger", "products", "users", extra=[("alerts", ALERTS_SQL)]))
def alert_fanout(v, p):
    """J-08: alert delivery per active admin/keeper (no alert x recipient rows)."""
    return AL.alert_fanout(AL.stock_alerts(v.ledger, v.product_base), v.users)


NOTIF_SQL = """
select employee_id user_id, id request_id,
  case when status in ('issued','partially_issued') then '✅ Issue Request Approved'
       else '❌ Issue Request Rejected' end title,
  case when status in ('issued','partially_issued') then 'success' else 'danger' end "type",
  'issues.php' link, issued_at created_at
from issue_requests where status <> 'pending'"""

MARKS_SQL = "select employee_id user_id, max(created_at) read_at from issue_requests group by 1"

READ_SQL = """
select n.*, coalesce(n.created_at <= m.read_at, false) is_read
from notif n left join marks m on m.user_id = n.user_id"""

_NOTIF = [("notif", NOTIF_SQL), ("marks", MARKS_SQL), ("notif_read", READ_SQL)]


@register("workflow_notifications", with_views("""
select n.user_id, n.request_id, n.title,
  case when r.status in ('issued','partially_issued')
       then 'Your request ' || r.issue_number || ' for ' || p.p_name || ' has been ' || r.status || '.'
       else 'Your request ' || r.issue_number || ' was rejected. Reason: ' end body,
  n."type", n.link, false is_read, n.created_at
from notif n
join (select *, printf('ISS-%04d', row_number() over (order by created_at, id)) issue_number
      from issue_requests) r on r.id = n.request_id
join part p on p.p_partkey = r.product_id
""", "issue_requests", extra=_NOTIF[:1]))
def workflow_notifications(v, p):
    """W-10: approved / rejected notifications to the requester."""
    return AL.workflow_notifications(v.numbered_requests, v.product_base)


@register("mark_read", with_views("""
select user_id, request_id, created_at, is_read from notif_read
""", "issue_requests", extra=_NOTIF))
def mark_read(v, p):
    """S-10: bulk mark-read with one read mark per user."""
    return AL.build_notifications(v, p).select("user_id", "request_id", "created_at", "is_read")


@register("unread_counts", with_views("""
select user_id, count(*) unread from notif_read where not is_read group by user_id
""", "issue_requests", extra=_NOTIF))
def unread_counts(v, p):
    """A-15: unread notifications per user, all users at once."""
    return AL.unread_counts(AL.build_notifications(v, p))


@register("recent_notifications", with_views(f"""
select user_id, request_id, title, created_at, pos from (
  select *, row_number() over (partition by user_id order by created_at desc, request_id desc) pos
  from notif_read) x
where pos <= {K.TOP_NOTIFICATIONS}
""", "issue_requests", extra=_NOTIF))
def recent_notifications(v, p):
    """L-02 per user: newest eight notifications of every user."""
    return AL.recent_notifications(AL.build_notifications(v, p)).select(
        "user_id", "request_id", "title", "created_at", F.col("pos").cast("bigint").alias("pos"))
