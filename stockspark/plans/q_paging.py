"""Catalog entries: filtered lists, pages, keyset pages, page arithmetic, search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.functions import filters as FL
from stockspark.operators import paging as PG
from stockspark.operators.page_index import PagedList
from stockspark.plans.catalog import CRIT, LOW, dbl, register, with_views
from stockspark.session import ensure_checkpoint_dir

SEARCH = "red"
INV_PAGE = 2
AUDIT_SEARCH = "LOGIN"
AUDIT_MODULE = "System"
AUDIT_PAGE = 2
KEYSET_LAST = (dt.datetime(2024, 1, 15, 12, 0, 0), 5000)


def _inventory_filtered(v, term=SEARCH, category=None, stock=None):
    pr = v.products
    cond = FL.conjunction([
        F.col("status") == "active",
        FL.search(["name", "product_code", "rack_location"], term) if term else None,
        F.col("category_id") == category if category else None,
        X.is_low() if stock == "low" else None,
        X.is_critical() if stock == "critical" else None,
        ~X.is_low() if stock == "good" else None])
    return pr.filter(cond)


INV_WHERE = (f"p.status = 'active' and (p.name ilike '%{SEARCH}%' or p.product_code ilike "
             f"'%{SEARCH}%' or p.rack_location ilike '%{SEARCH}%')")


@register("inventory_page", with_views(f"""
select p.id, p.product_code, p.name, c.name category, {dbl('p.current_stock')},
  {dbl('p.min_stock_level')},
  case when {CRIT} then 'Critical' when {LOW} then 'Low' else 'Good' end stock_class,
  (select count(*) from products p where {INV_WHERE}) total
from products p left join categories c on c.id = p.category_id
where {INV_WHERE}
order by p.current_stock, p.name, p.id limit {K.ROWS_PER_PAGE} offset {(INV_PAGE - 1) * K.ROWS_PER_PAGE}
""", "products", "categories"))
def inventory_page(v, p):
    """L-03/L-05/P-02/P-08: searched active products, page 2 by stock then name."""
    f = _inventory_filtered(v)
    c = v.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    rows = PG.page(f.join(c, "category_id", "left"),
                   [F.col("current_stock"), F.col("name"), F.col("id")], INV_PAGE, K.ROWS_PER_PAGE)
    rows = rows.select("id", "product_code", "name", "category", "current_stock",
                       "min_stock_level", X.stock_class().alias("stock_class"))
    return PG.with_total(rows, f)


AUDIT_WHERE = (f"(details ilike '%{AUDIT_SEARCH}%' or user_name ilike '%{AUDIT_SEARCH}%' "
               f"or action ilike '%{AUDIT_SEARCH}%') and module = '{AUDIT_MODULE}'")


@register("audit_page", with_views(f"""
with f as (select * from audit_log where {AUDIT_WHERE}),
t as (select count(*) total from f)
select x.id, x.created_at, x.user_name, x.action, x.module, t.total,
  t.total - {(AUDIT_PAGE - 1) * K.AUDIT_ROWS_PER_PAGE}
    - (row_number() over (order by x.created_at desc, x.id desc) - 1) serial
from (select * from f order by created_at desc, id desc
      limit {K.AUDIT_ROWS_PER_PAGE} offset {(AUDIT_PAGE - 1) * K.AUDIT_ROWS_PER_PAGE}) x, t
""", "audit_log"))
def audit_page(v, p):
    """L-03/K-05: searched audit log, page 2 of 50 newest first, descending serial."""
    a = v.audit_log
    f = a.filter(FL.search(["details", "user_name", "action"], AUDIT_SEARCH)
                 & (F.col("module") == AUDIT_MODULE))
    order = [F.desc("created_at"), F.desc("id")]
    rows = PG.page(f, order, AUDIT_PAGE, K.AUDIT_ROWS_PER_PAGE)
    rows = PG.with_total(rows.select("id", "created_at", "user_name", "action", "module"), f)
    i = F.row_number().over(Window.orderBy(*order))        # over the 50 page rows only
    off = (AUDIT_PAGE - 1) * K.AUDIT_ROWS_PER_PAGE
    return rows.withColumn("serial", (F.col("total") - off - (i - 1)).cast("bigint"))


@register("audit_keyset", with_views(f"""
select id, created_at, user_name, action from audit_log
where created_at < timestamp '{KEYSET_LAST[0]}'
   or (created_at = timestamp '{KEYSET_LAST[0]}' and id < {KEYSET_LAST[1]})
order by created_at desc, id desc limit {K.AUDIT_ROWS_PER_PAGE}
""", "audit_log"))
def audit_keyset(v, p):
    """L-03 deep page by keyset: the 50 rows after a (created_at, id) position."""
    a = v.audit_log.filter(PG.keyset_after(["created_at", "id"], KEYSET_LAST))
    return (a.select("id", "created_at", "user_name", "action")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(K.AUDIT_ROWS_PER_PAGE))


DEEP_PAGE = 15


@register("audit_deep_page", with_views(f"""
select x.id, x.created_at, x.user_name, x.action, x.module, (select count(*) from audit_log) total,
  row_number() over (order by x.created_at desc, x.id desc) - 1 + {(DEEP_PAGE - 1) * K.AUDIT_ROWS_PER_PAGE} "position"
from (select * from audit_log order by created_at desc, id desc
      limit {K.AUDIT_ROWS_PER_PAGE} offset {(DEEP_PAGE - 1) * K.AUDIT_ROWS_PER_PAGE}) x
""", "audit_log"))
def audit_deep_page(v, p):
    """L-03/A-14: a deep page of the whole audit log and its match count from the stored order-statistic index."""
    root = f"{ensure_checkpoint_dir(v.spark)}/paged/audit-{v.t.digest('events')}-{v.t.digest('customer')}"
    paged = PagedList(v.spark, root).build(v.audit_log, [F.desc("created_at"), F.desc("id")])
    return paged.page(DEEP_PAGE, K.AUDIT_ROWS_PER_PAGE).select("id", "created_at", "user_name", "action", "module",
                                                              "total", "position")


PAGE_NO = 3


@register("page_info", with_views(f"""
with t as (
  select 'products' list, count(*) total, {K.ROWS_PER_PAGE} per from products
    where status = 'active'
  union all select 'audit_log', count(*), {K.AUDIT_ROWS_PER_PAGE} from audit_log
  union all select 'issue_requests', count(*), {K.ROWS_PER_PAGE} from issue_requests
  union all select 'indents', count(*), {K.ROWS_PER_PAGE} from indents
  union all select 'users', count(*), {K.ROWS_PER_PAGE} from users)
select list, total, cast(ceil(total / per) as int) pages, {PAGE_NO} page,
  case when ceil(total / per) > 1 then array_to_string(
    range(greatest(1, {PAGE_NO} - 2), greatest(greatest(1, {PAGE_NO} - 2),
          least(cast(ceil(total / per) as int), {PAGE_NO} + 2)) + 1), ',') else '' end links,
  {PAGE_NO} > 1 has_prev, {PAGE_NO} < ceil(total / per) has_next
from t
""", "products", "audit_log", "issue_requests", "indents", "users"))
def page_info(v, p):
    """L-04: page count and link window for each list at page 3."""
    def tot(name, df, per):
        return df.agg(F.count("*").alias("total")).select(
            F.lit(name).alias("list"), "total", F.lit(per).alias("per"))
    t = (tot("products", v.product_base.filter(F.col("status") == "active"), K.ROWS_PER_PAGE)
         .unionByName(tot("audit_log", v.audit_log, K.AUDIT_ROWS_PER_PAGE))
         .unionByName(tot("issue_requests", v.issue_requests, K.ROWS_PER_PAGE))
         .unionByName(tot("indents", v.indents, K.ROWS_PER_PAGE))
         .unionByName(tot("users", v.users, K.ROWS_PER_PAGE)))
    parts = [PG.page_info(t.filter(F.col("per") == n).drop("per"), PAGE_NO, n)
             for n in sorted({K.ROWS_PER_PAGE, K.AUDIT_ROWS_PER_PAGE})]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("search_products", with_views(f"""
select id, product_code, name from products
where status = 'active' and (name ilike '%{SEARCH}%' or product_code ilike '%{SEARCH}%'
                             or rack_location ilike '%{SEARCH}%')
""", "products"))
def search_products(v, p):
    """P-08: case-insensitive substring search over three columns (LIKE %x%)."""
    pb = v.product_base
    return pb.filter((F.col("status") == "active")
                     & FL.search(["name", "product_code", "rack_location"], SEARCH)).select(
        "id", "product_code", "name")


@register("search_accent_insensitive", with_views("""
select id, name from users where strip_accents(lower(name)) like '%customer#00000001%'
""", "users"))
def search_accent_insensitive(v, p):
    """P-08 accent-insensitive mode: contains under the UNICODE_CI_AI collation."""
    return v.users.filter(FL.search(["name"], "customer#00000001", accent_insensitive=True)) \
        .select("id", "name")


@register("stock_filter", with_views(f"""
select id, product_code, {dbl('current_stock')}, {dbl('min_stock_level')} from products p
where status = 'active' and {CRIT}
""", "products"))
def stock_filter(v, p):
    """P-07: column-to-column threshold filter (critical items)."""
    return _inventory_filtered(v, term=None, stock="critical").select(
        "id", "product_code", "current_stock", "min_stock_level")


@register("filter_eq", with_views("""
select id, user_id, action, module, created_at from audit_log
where module = 'Reports' and action = 'EXPORT'
""", "audit_log"))
def filter_eq(v, p):
    """P-01: equality filters (module, action)."""
    a = v.audit_log
    return a.filter(FL.conjunction([F.col("module") == "Reports", F.col("action") == "EXPORT",
                                    None])).select("id", "user_id", "action", "module",
                                                   "created_at")


RANGE = (dt.date(1998, 1, 1), dt.date(1998, 3, 31))


@register("date_range", with_views(f"""
select product_id, created_at, ord_key, ord_line, type, cast(quantity as double) quantity
from movements where cast(created_at as date) between date '{RANGE[0]}' and date '{RANGE[1]}'
""", "movements"))
def date_range(v, p):
    """P-03: closed DATE() window, pushed down to the parquet scan."""
    return v.movements.filter(FL.date_range("created_at", *RANGE)).select(
        "product_id", "created_at", "ord_key", "ord_line", "type", "quantity")


BOUND = dt.date(2024, 1, 20)


@register("date_bound", with_views(f"""
select id, created_at, action from audit_log where cast(created_at as date) >= date '{BOUND}'
""", "audit_log"))
def date_bound(v, p):
    """P-04: half-open date bound (from only)."""
    return v.audit_log.filter(FL.date_bound("created_at", date_from=BOUND)).select(
        "id", "created_at", "action")
