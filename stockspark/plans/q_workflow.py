"""Catalog entries: numbering, validation, decisions, allocation (W-01..W-07).

Decision batches are stand-in inputs built from the requests' recorded
outcomes: the recorded outcome becomes a decision at the recorded time, and
a second, later, opposite decision is added for every decided request (it
must lose to the first valid one).  A rejection's reason is the work-order
reference, which is NULL for some rows, so some rejections are invalid and
the later decision wins.  The jobs themselves see only rows of the
decision schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.operators import numbering as N
from stockspark.operators import workflow as W
from stockspark.plans.catalog import register, with_views

D12 = "decimal(12,2)"


def issue_decisions(v):
    r = v.issue_requests.filter(F.col("status") != "pending")
    appr = F.col("status").isin("issued", "partially_issued")
    primary = r.select(
        F.concat("id", F.lit("#1")).alias("decision_id"), F.col("id").alias("request_id"),
        F.when(appr, "approve").otherwise("reject").alias("decision"),
        F.when(F.col("status") == "partially_issued", F.col("quantity_issued")).alias("qty_issued"),
        F.when(appr, F.lit(None)).otherwise(F.col("work_order_ref")).cast("string").alias("reason"),
        F.col("issued_by").alias("decided_by"), F.col("issued_at").alias("decided_at"))
    late = r.select(
        F.concat("id", F.lit("#2")).alias("decision_id"), F.col("id").alias("request_id"),
        F.when(appr, "reject").otherwise("approve").alias("decision"),
        F.lit(None).cast(D12).alias("qty_issued"), F.lit("late review").alias("reason"),
        (F.col("employee_id") % 30).alias("decided_by"),
        (F.col("issued_at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"))
    return primary.unionByName(late)


ISSUE_DECISIONS_SQL = """
select id || '#1' decision_id, id request_id,
  case when status in ('issued','partially_issued') then 'approve' else 'reject' end decision,
  case when status = 'partially_issued' then quantity_issued end qty_issued,
  case when status in ('issued','partially_issued') then null else work_order_ref end reason,
  issued_by decided_by, issued_at decided_at
from issue_requests where status <> 'pending'
union all
select id || '#2', id,
  case when status in ('issued','partially_issued') then 'reject' else 'approve' end,
  null, 'late review', employee_id % 30, issued_at + interval 1 day
from issue_requests where status <> 'pending'"""

VALID_SQL = """
select * from dec where decision in ('approve','reject')
  and not (decision = 'reject' and (reason is null or trim(reason) = ''))"""

FIRST_SQL = """
select * exclude (rn) from (
  select *, row_number() over (partition by request_id order by decided_at, decision_id) rn
  from valid) x where rn = 1"""


def _pending_all(v):
    """Requests as they stood before the batch: every one pending."""
    return v.issue_requests.withColumn("status", F.lit("pending"))


@register("request_validation", with_views("""
select decision_id, request_id, decision,
  array_to_string(list_filter([
    case when decision not in ('approve','reject') then 'unknown decision' end,
    case when decision = 'reject' and (reason is null or trim(reason) = '')
         then 'rejection reason is mandatory' end], lambda x: x is not null), ';') reasons,
  not (decision not in ('approve','reject')
       or (decision = 'reject' and (reason is null or trim(reason) = ''))) valid
from dec
""", "issue_requests", extra=[("dec", ISSUE_DECISIONS_SQL)]))
def request_validation(v, p):
    """W-03: decision rules -> valid flag and reasons."""
    return W.validate_decisions(issue_decisions(v)).select(
        "decision_id", "request_id", "decision", "reasons", "valid")


@register("first_decision", with_views("""
select request_id, decision_id, decision, decided_at from (
  select *, row_number() over (partition by request_id order by decided_at, decision_id) rn
  from dec) x where rn = 1
""", "issue_requests", extra=[("dec", ISSUE_DECISIONS_SQL)]))
def first_decision(v, p):
    """W-05: first decision per request wins (min_by with partial aggregation)."""
    return W.first_decision(issue_decisions(v)).select(
        "request_id", "decision_id", "decision", "decided_at")


#: Sequential fold per product over every valid decision; ``done`` holds the requests already decided.
APPLY_CTES = """
with sq as (
  select v.*, q.product_id, q.quantity_requested,
    case when v.qty_issued > 0 then v.qty_issued else q.quantity_requested end qty,
    row_number() over (partition by q.product_id order by v.decided_at, v.decision_id) rn
  from valid v join issue_requests q on q.id = v.request_id),
af(product_id, rn, bal, done, outcome) as (
  select id, cast(0 as bigint), cast(current_stock - reserved_stock as decimal(18,2)),
    cast([] as varchar[]), ''
  from products
  union all
  select s.product_id, s.rn,
    cast(case when not list_contains(f.done, s.request_id) and s.decision = 'approve'
                and f.bal - s.qty >= 0 then f.bal - s.qty else f.bal end as decimal(18,2)),
    case when not list_contains(f.done, s.request_id) and (s.decision = 'reject' or f.bal - s.qty >= 0)
         then list_append(f.done, s.request_id) else f.done end,
    case when list_contains(f.done, s.request_id) then 'late' when s.decision = 'reject' then 'rejected'
         when f.bal - s.qty >= 0 then 'accepted' else 'refused' end
  from af f join sq s on s.product_id = f.product_id and s.rn = f.rn + 1),
ot as (select s.*, f.bal, f.outcome from sq s join af f on f.product_id = s.product_id and f.rn = s.rn),
a as (
  select request_id,
    case when qty < quantity_requested then 'partially_issued' else 'issued' end status,
    cast(qty as double) quantity_issued, cast(decided_by as double) issued_by, decided_at issued_at,
    cast(null as varchar) rejection_reason, cast(bal as double) available_after
  from ot where outcome = 'accepted'
  union all
  select request_id, 'rejected', null, cast(decided_by as double), decided_at, trim(reason), null
  from ot where outcome = 'rejected'
  union all
  select request_id, 'pending', null, null, null, null, cast(arg_min(bal, rn) as double)
  from ot group by request_id having count(*) = count(*) filter (where outcome = 'refused'))
"""


@register("apply_issue_decisions", with_views(
    APPLY_CTES + "select * from a", "issue_requests", "products",
    extra=[("dec", ISSUE_DECISIONS_SQL), ("valid", VALID_SQL)]))
def apply_issue_decisions(v, p):
    """W-04/W-06: approve (stock-checked, partial allowed) or reject pending requests;
    an approval refused for stock leaves the request to its next decision."""
    out = W.apply_issue_decisions(_pending_all(v), v.products, issue_decisions(v))
    return out.withColumn("issued_by", F.col("issued_by").cast("double"))


@register("allocate_requests", with_views("""
with pend as (
  select id, product_id, created_at, quantity_requested,
    sum(quantity_requested) over (partition by product_id order by created_at, id
                                  rows between unbounded preceding and 1 preceding) before
  from issue_requests where status = 'pending'),
av as (select id product_id, current_stock - reserved_stock available from products),
al as (select p.*, greatest(0, least(p.quantity_requested,
                  coalesce(av.available, 0) - coalesce(p.before, 0))) allocated
       from pend p left join av on av.product_id = p.product_id)
select id, product_id, created_at, cast(quantity_requested as double) quantity_requested,
  cast(allocated as double) allocated,
  case when allocated = quantity_requested then 'full' when allocated > 0 then 'partial'
       else 'none' end allocation
from al
""", "issue_requests", "products"))
def allocate_requests(v, p):
    """W-04b: first-come allocation of available stock to pending requests."""
    return W.allocate_requests(v.issue_requests, v.products)


def indent_decisions(v):
    i = v.indents.filter(F.col("status") != "pending")
    st = F.col("status")
    primary = i.select(
        F.concat(F.col("id").cast("string"), F.lit("#1")).alias("decision_id"),
        F.col("id").alias("request_id"),
        F.when(st == "approved", "approve").otherwise("reject").alias("decision"),
        F.lit(None).cast(D12).alias("qty_issued"),
        F.when(st == "rejected", F.lit("Budget not available"))
         .when(st == "converted", F.lit("  ")).alias("reason"),
        (F.col("employee_id") % 30).alias("decided_by"),
        (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("decided_at"))
    late = i.select(
        F.concat(F.col("id").cast("string"), F.lit("#2")).alias("decision_id"),
        F.col("id").alias("request_id"),
        F.when(st == "approved", "reject").otherwise("approve").alias("decision"),
        F.lit(None).cast(D12).alias("qty_issued"), F.lit("late review").alias("reason"),
        (F.col("employee_id") % 7).alias("decided_by"),
        (F.col("created_at") + F.expr("INTERVAL 3 DAYS")).alias("decided_at"))
    return primary.unionByName(late)


INDENT_DEC_SQL = """
select cast(id as varchar) || '#1' decision_id, id request_id,
  case when status = 'approved' then 'approve' else 'reject' end decision,
  cast(null as decimal(12,2)) qty_issued,
  case when status = 'rejected' then 'Budget not available' when status = 'converted' then '  '
  end reason,
  employee_id % 30 decided_by, created_at + interval 2 day decided_at
from indents where status <> 'pending'
union all
select cast(id as varchar) || '#2', id,
  case when status = 'approved' then 'reject' else 'approve' end, null, 'late review',
  employee_id % 7, created_at + interval 3 day
from indents where status <> 'pending'"""


@register("apply_indent_decisions", with_views("""
select request_id, case when decision = 'approve' then 'approved' else 'rejected' end status,
  cast(case when decision = 'approve' then decided_by end as double) approved_by,
  case when decision = 'approve' then decided_at end approved_at,
  case when decision <> 'approve' then trim(reason) end rejection_reason
from fst
""", "indents", extra=[("dec", INDENT_DEC_SQL), ("valid", VALID_SQL), ("fst", FIRST_SQL)]))
def apply_indent_decisions(v, p):
    """W-07: indent approve / reject batch (first valid decision wins)."""
    before = v.indents.withColumn("status", F.lit("pending"))
    out = W.apply_indent_decisions(before, indent_decisions(v))
    return out.withColumn("approved_by", F.col("approved_by").cast("double"))


@register("number_requests", with_views("""
select id, created_at, printf('IND-%04d', row_number() over (order by created_at, id)) number
from indents
""", "indents"))
def number_requests(v, p):
    """W-01: sequence numbers IND-0001.. without a single-partition global sort."""
    return N.number_rows(v.indents.select("id", "created_at"), ["created_at", "id"], "IND")


EXISTING_SQL = """
select id, printf('ISS-%d-%04d', year(created_at), id % 10000) number
from indents where status = 'converted'"""


@register("number_by_year", with_views("""
with lst as (
  select cast(split_part(number, '-', 2) as int) yr,
    arg_max(cast(split_part(number, '-', 3) as int), id) last_seq
  from ex where number like 'ISS-%' group by 1),
r as (select id, created_at, year(created_at) yr,
        row_number() over (partition by year(created_at) order by created_at, id) rn
      from issue_requests)
select r.id, r.created_at, printf('ISS-%d-%04d', r.yr, coalesce(l.last_seq, 0) + r.rn) number
from r left join lst l on l.yr = r.yr
""", "issue_requests", "indents", extra=[("ex", EXISTING_SQL)]))
def number_by_year(v, p):
    """W-02/K-07: year-scoped numbers continuing after the latest existing one."""
    existing = (v.indents.filter(F.col("status") == "converted")
                .select("id", F.format_string("ISS-%d-%04d", F.year("created_at"),
                                              F.col("id") % 10000).alias("number")))
    return N.number_by_year(v.issue_requests.select("id", "created_at"), "created_at", ["id"],
                            "ISS", existing)


@register("issue_movements", with_views(APPLY_CTES + """
select q.product_id, a.issued_at created_at, 'stock_out' type,
  a.quantity_issued quantity, a.request_id reference_number, 'issue' reference_type
from a join issue_requests q on q.id = a.request_id
where a.status in ('issued', 'partially_issued')
""", "issue_requests", "products",
    extra=[("dec", ISSUE_DECISIONS_SQL), ("valid", VALID_SQL)]))
def issue_movements(v, p):
    """W-04: the stock-out movement written for every accepted approval (ledger input)."""
    upd = W.apply_issue_decisions(_pending_all(v), v.products, issue_decisions(v))
    return W.issue_movements(upd, v.issue_requests)


@register("goods_receipts", with_views("""
select l.product_id, l.created_at, cast(l.quantity as double) quantity,
  s.s_name supplier, 'INV-' || cast(l.ord_key as varchar) invoice_number,
  cast(l.balance_after as double) balance_after
from ledger l join supplier s on s.s_suppkey = l.supplier_id
where l.type = 'stock_in'
""", "ledger"))
def goods_receipts(v, p):
    """W-09/W-08: stock-in receipts with supplier and invoice, as applied by the ledger."""
    s = v.t.supplier.select(F.col("s_suppkey").alias("supplier_id"),
                            F.col("s_name").alias("supplier"))
    return (v.ledger.filter(F.col("type") == "stock_in").join(s, "supplier_id")
            .select("product_id", "created_at", "quantity", "supplier",
                    F.concat(F.lit("INV-"), F.col("ord_key").cast("string"))
                    .alias("invoice_number"), "balance_after"))
