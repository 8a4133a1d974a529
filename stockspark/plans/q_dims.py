"""Catalog entries: scans, lookups, loads, upserts, overlays, permissions, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.operators import dims as DM
from stockspark.plans import exports as EX
from stockspark.plans.catalog import dbl, in_range, register, with_views, A_FROM, A_TO

OPENING_CUTOFF = dt.date(1996, 1, 1)
EXISTING_CUTOFF = dt.date(1995, 2, 1)


@register("scan_products", with_views(f"""
select id, product_code, name, category_id, unit, {dbl('current_stock')},
  {dbl('reserved_stock')}, {dbl('min_stock_level')}, rack_location, supplier_name,
  {dbl('unit_price')}, status
from products
""", "products"))
def scan_products(v, p):
    """S-01: full product scan with the stock level."""
    return v.products


@register("active_products", with_views("""
select id, name, unit from products where status = 'active'
""", "products"))
def active_products(v, p):
    """S-02: active products for drop-downs, by name."""
    return (v.product_base.filter(F.col("status") == "active").select("id", "name", "unit")
            .orderBy("name", "id"))


@register("active_categories", with_views("""
select id, name from categories where status = 'active'
""", "categories"))
def active_categories(v, p):
    """S-02: active categories by name."""
    return v.categories.filter(F.col("status") == "active").select("id", "name").orderBy("name")


@register("product_lookup", with_views("""
select k.product_id, p.product_code, p.name, c.name category_name,
  cast(p.current_stock as double) current_stock, cast(p.reserved_stock as double) reserved_stock
from (select distinct product_id from issue_requests where status = 'pending') k
left join products p on p.id = k.product_id
left join categories c on c.id = p.category_id
""", "issue_requests", "products", "categories"))
def product_lookup(v, p):
    """S-03: bulk keyed lookup (products of pending requests) with category."""
    keys = v.issue_requests.filter(F.col("status") == "pending").select("product_id")
    return DM.product_lookup(v.products, v.categories, keys)


def _raw_audit(v):
    e = v.t.events
    u = v.users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"),
                       F.col("role").alias("user_role"))
    return (e.join(u, e.user_id == u._uid, "left").select(
        F.col("event_id").alias("id"), "user_id", "user_name", "user_role",
        F.col("event_type").alias("action"), F.lit("Events").alias("module"),
        F.get_json_object("props", "$.k").cast("bigint").alias("record_id"),
        F.col("props").alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.concat(F.lit("client/"), F.col("props")).alias("user_agent"),
        F.col("ts").alias("created_at")))


@register("audit_normalise", with_views("""
select e.event_id id, e.user_id, coalesce(u.name, 'System') user_name,
  coalesce(u.role, 'system') user_role, upper(e.event_type) action, 'Events' module,
  cast(json_extract_string(e.props, '$.k') as bigint) record_id, e.props details,
  '0.0.0.0' ip_address,
  substr('client/' || e.props, 1, 250) user_agent, e.ts created_at
from events e left join users u on u.id = e.user_id
""", "users"))
def audit_normalise(v, p):
    """S-05: normalise raw audit events (upper action, defaults, agent cut)."""
    return DM.audit_normalise(_raw_audit(v))


def _opening_inputs(v):
    mv = v.movements
    opening = (mv.filter(F.col("created_at") < F.lit(OPENING_CUTOFF).cast("timestamp_ntz"))
               .groupBy("product_id").agg(F.sum("signed_qty").alias("opening"))
               .filter(F.col("opening") > 0)
               .join(v.product_base.select(F.col("id").alias("product_id"), "product_code"),
                     "product_id").select("product_code", "opening"))
    existing = (mv.filter(F.col("created_at") < F.lit(EXISTING_CUTOFF).cast("timestamp_ntz"))
                .select("product_id").distinct())
    return opening, existing


@register("opening_stock", with_views(f"""
with m as (select product_id, sum(signed_qty) opening from movements
           where created_at < timestamp '{OPENING_CUTOFF}' group by product_id
           having sum(signed_qty) > 0),
ex as (select distinct product_id from movements where created_at < timestamp '{EXISTING_CUTOFF}')
select p.p_partkey product_id, printf('P-%04d', p.p_partkey) product_code,
  cast(coalesce(m.opening, 0) as double) opening_stock,
  cast(coalesce(m.opening, 0) as double) current_stock
from part p left join m on m.product_id = p.p_partkey
where p.p_partkey not in (select product_id from ex)
""", "movements"))
def opening_stock(v, p):
    """S-06: opening stock rows from a code map, skipping products that have one."""
    opening, existing = _opening_inputs(v)
    return DM.opening_stock(v.product_base, opening, existing)


def _upsert_changes(v):
    pt = v.t.part
    upd = pt.filter(F.col("p_size") >= 48).select(
        F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"),
        ((F.col("p_size") + 1) * 10).cast("decimal(12,2)").alias("min_stock_level"),
        F.round(F.col("p_retailprice").cast("decimal(12,2)") * F.lit(1.1).cast("decimal(3,1)"), 2)
         .cast("decimal(12,2)").alias("unit_price"),
        F.lit(None).cast("bigint").alias("ins_key"))
    ins = v.t.supplier.select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("Kit "), F.col("s_name")).alias("name"),
        F.lit(0).cast("decimal(12,2)").alias("min_stock_level"),
        F.lit(0).cast("decimal(12,2)").alias("unit_price"), F.col("s_suppkey").alias("ins_key"))
    return upd.unionByName(ins)


@register("product_upsert", with_views("""
with upd as (select p_partkey id, upper(p_name) name, cast((p_size + 1) * 10 as decimal(12,2)) mn,
               cast(round(cast(p_retailprice as decimal(12,2)) * 1.1, 2) as decimal(12,2)) pr
             from part where p_size >= 48),
ins as (select 'Kit ' || s_name name, s_suppkey ins_key,
          row_number() over (order by 'Kit ' || s_name, s_suppkey) seq from supplier),
stats as (select max(id) mx, count(*) cnt from products)
select b.id, b.product_code, coalesce(u.name, b.name) name,
  cast(coalesce(u.mn, b.min_stock_level) as double) min_stock_level,
  cast(coalesce(u.pr, b.unit_price) as double) unit_price, b.status,
  case when u.name is not null then 'updated' else 'unchanged' end change
from products b left join upd u on u.id = b.id
union all
select stats.mx + ins.seq, printf('P-%04d', stats.cnt + ins.seq), ins.name, 0.0, 0.0, 'active',
  'inserted'
from ins, stats
""", "products"))
def product_upsert(v, p):
    """S-08: update-or-insert change-set against the product snapshot."""
    return DM.product_upsert(v.product_base, _upsert_changes(v))


@register("status_overlay", with_views("""
with ch as (select product_id id, case when type = 'return' then 'inactive' else 'active' end st,
              row_number() over (partition by product_id
                                 order by created_at desc, ord_key desc, ord_line desc) rn
            from movements),
latest as (select id, st from ch where rn = 1)
select p.p_partkey id, coalesce(l.st, case when p.p_partkey % 20 = 0 then 'inactive'
                                           else 'active' end) status,
  coalesce(l.st <> case when p.p_partkey % 20 = 0 then 'inactive' else 'active' end, false) changed
from part p left join latest l on l.id = p.p_partkey
""", "movements"))
def status_overlay(v, p):
    """S-09: latest status change per product overlaid on the snapshot."""
    changes = v.movements.select(
        F.col("product_id").alias("id"),
        F.when(F.col("type") == "return", "inactive").otherwise("active").alias("status"),
        "created_at", "ord_key", "ord_line")
    return DM.status_overlay(v.product_base, changes, ["created_at", "ord_key", "ord_line"])


@register("request_intake", with_views(f"""
select printf('ISS-%04d', row_number() over (order by created_at, id)) issue_number,
  employee_id, employee_name, department, product_id, {dbl('quantity_requested')},
  'pending' status, created_at
from issue_requests where product_id is not null and quantity_requested > 0
""", "issue_requests"))
def request_intake(v, p):
    """S-15: validated submissions numbered ISS-0001.. and set pending."""
    return DM.request_intake(v.issue_requests, ["created_at", "id"])


@register("duplicate_usernames", with_views("""
with cand as (select distinct lower(u.name) username from events e join users u on u.id = e.user_id
              where e.event_type = 'signup'
              union select lower(s_name) from supplier)
select c.username, exists (select 1 from users u where u.username = c.username) taken
from cand c
""", "users"))
def duplicate_usernames(v, p):
    """J-07: username existence check for sign-up candidates."""
    e = v.t.events.filter(F.col("event_type") == "signup")
    u = v.users.select(F.col("id").alias("_uid"), "name")
    cand = (e.join(u, e.user_id == u._uid).select(F.lower("name").alias("username"))
            .unionByName(v.t.supplier.select(F.lower("s_name").alias("username"))))
    return DM.username_check(cand, v.users)


def _perm_sql():
    rows = ", ".join(f"('{p}', '{r}')" for p, rs in K.PERMISSIONS.items() for r in rs)
    return f"select * from (values {rows}) t(permission, role)"


@register("effective_permissions", with_views("""
select u.id user_id, u.role, m.permission from users u join perms m on m.role = u.role
where u.status = 'active'
""", "users", extra=[("perms", _perm_sql())]))
def effective_permissions(v, p):
    """P-13: (user, permission) for active users from the fixed role matrix."""
    return DM.effective_permissions(v.users)


@register("visible_requests", with_views("""
select u.id viewer_id, u.role,
  cast(case when u.role = 'employee' then coalesce(o.n, 0) else t.n end as bigint) visible
from users u left join (select employee_id, count(*) n from issue_requests group by 1) o
  on o.employee_id = u.id,
  (select count(*) n from issue_requests) t
""", "users", "issue_requests"))
def visible_requests(v, p):
    """P-12: requests visible to each viewer under row-level visibility."""
    return DM.visible_request_counts(v.issue_requests, v.users)


@register("export_manifest", with_views(f"""
select * from (values
 ('daily_issues', 'Daily Issue Report', (select count(*) from issue_requests
    where {in_range('created_at')})),
 ('stock_summary', 'Stock Summary Report', (select count(*) from part where p_partkey % 20 <> 0)),
 ('low_stock', 'Low Stock Alert Report', (select count(*) from products p
    where p.status='active' and p.current_stock <= p.min_stock_level)),
 ('emp_history', 'Employee Issue History', (select count(*) from (select distinct employee_name,
    department from issue_requests where status='issued' and {in_range('issued_at')}) x)),
 ('category_stock', 'Category-wise Stock Report', (select count(*) from categories)),
 ('stock_ledger', 'Stock Movement Ledger', (select count(*) from ledger where accepted
    and {in_range('created_at')})),
 ('audit_log', 'Audit Log Export', (select count(*) from events
    where {in_range('ts', A_FROM, A_TO)}))
) t(report, title, total_records)
""", "issue_requests", "products", "categories", "ledger"))
def export_manifest(v, p):
    """S-12/S-13: one manifest row (title, record count) per registered export."""
    plans = {k: fn(v, p) for k, fn in EX.PLANS.items()}
    m = DM.export_manifest(plans, EX.TITLES, p.date_from, p.date_to)
    return m.select("report", "title", "total_records")


@register("active_product_count", with_views("""
select count(*) n from part where p_partkey % 20 <> 0
"""))
def active_product_count(v, p):
    """P-01: equality filter status='active' + count."""
    return v.product_base.filter(F.col("status") == "active").agg(F.count("*").alias("n"))
