"""Catalog entries: data-quality rules (Q-01..Q-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.operators import alerts as AL
from stockspark.operators import quality as Q
from stockspark.operators.key_graph import Key, delete_through
from stockspark.plans.catalog import register, with_views


@register("dq_unique", with_views("""
select 'products.product_code' rule, product_code key, count(*) n from pb group by 2
  having count(*) > 1
union all select 'users.username', username, count(*) from users group by 2 having count(*) > 1
union all select 'issue_requests.id', id, count(*) from issue_requests group by 2
  having count(*) > 1
union all select 'movements.key', concat_ws('|', cast(product_id as varchar),
  cast(created_at as varchar), cast(ord_key as varchar), cast(ord_line as varchar)), count(*)
  from movements group by 2 having count(*) > 1
union all select 'movements.order_line', concat_ws('|', cast(ord_key as varchar),
  cast(ord_line as varchar)), count(*) from movements group by 2 having count(*) > 1
""", "users", "issue_requests", "movements",
    extra=[("pb", "select printf('P-%04d', p_partkey) product_code from part")]))
def dq_unique(v, p):
    """Q-01: keys and unique columns seen more than once."""
    return Q.unique_violations({
        "products.product_code": (v.product_base, ["product_code"]),
        "users.username": (v.users, ["username"]),
        "issue_requests.id": (v.issue_requests, ["id"]),
        "movements.key": (v.movements, ["product_id", "created_at", "ord_key", "ord_line"]),
        "movements.order_line": (v.movements, ["ord_key", "ord_line"]),
    })


FK_SQL = """
select rule, cast(ref as varchar) key, count(*) n from (
  select 'movements.product_id' rule, product_id ref from movements
    where product_id is not null and product_id not in (select p_partkey from part)
  union all select 'issue_requests.employee_id', employee_id from issue_requests
    where employee_id is not null and employee_id not in (select id from users)
  union all select 'issue_requests.issued_by', issued_by from issue_requests
    where issued_by is not null and issued_by not in (select id from users)
  union all select 'movements.created_by', created_by from movements
    where created_by is not null and created_by not in (select id from users)
  union all select 'audit_log.user_id', user_id from audit_log
    where user_id is not null and user_id not in (select id from users)
  union all select 'products.category_id', category_id from product_links
    where category_id is not null and category_id not in (select id from categories)
  union all select 'products.created_by', created_by from product_links
    where created_by is not null and created_by not in (select id from users)
  union all select 'indents.approved_by', approved_by from indent_links
    where approved_by is not null and approved_by not in (select id from users)
  union all select 'indents.category_id', category_id from indent_links
    where category_id is not null and category_id not in (select id from categories)
  union all select 'issue_requests.product_id', product_id from issue_requests
    where product_id is not null and product_id not in (select p_partkey from part)
  union all select 'issue_requests.stock_txn_id', stock_txn_id from request_transactions
    where stock_txn_id not in (select ord_key * 10 + ord_line from ledger where accepted)
  union all select 'notifications.user_id', employee_id from issue_requests
    where status <> 'pending' and employee_id is not null and employee_id not in (select id from users)
  union all select 'indents.employee_id', employee_id from indents
    where employee_id is not null and employee_id not in (select id from users)
) x group by rule, ref
"""


@register("dq_foreign_keys", with_views(FK_SQL, "movements", "issue_requests", "users",
                                        "audit_log", "categories", "indents", "product_links",
                                        "indent_links", "request_transactions", "ledger"))
def dq_foreign_keys(v, p):
    """Q-02: references without a parent row, for all 13 foreign keys (left_anti each)."""
    u, pb = v.users, v.product_base
    posted = v.accepted_movements.select((F.col("ord_key") * 10 + F.col("ord_line")).alias("id"))
    return Q.fk_violations({
        "movements.product_id": (v.movements, "product_id", pb, "id"),
        "issue_requests.employee_id": (v.issue_requests, "employee_id", u, "id"),
        "issue_requests.issued_by": (v.issue_requests, "issued_by", u, "id"),
        "movements.created_by": (v.movements, "created_by", u, "id"),
        "audit_log.user_id": (v.audit_log, "user_id", u, "id"),
        "products.category_id": (v.product_links, "category_id", v.categories, "id"),
        "indents.employee_id": (v.indents, "employee_id", u, "id"),
        "products.created_by": (v.product_links, "created_by", u, "id"),
        "indents.approved_by": (v.indent_links, "approved_by", u, "id"),
        "indents.category_id": (v.indent_links, "category_id", v.categories, "id"),
        "issue_requests.product_id": (v.issue_requests, "product_id", pb, "id"),
        "issue_requests.stock_txn_id": (v.request_transactions, "stock_txn_id", posted, "id"),
        "notifications.user_id": (AL.notification_rows(v.issue_requests), "user_id", u, "id"),
    })


DELETED_CATEGORIES = (1, 3, 7)


@register("delete_categories", with_views(f"""
select 'products' child, p.id, cast(case when p.category_id not in {DELETED_CATEGORIES} then p.category_id end as double)
  category_id, coalesce(p.category_id in {DELETED_CATEGORIES}, false) nulled from product_links p
union all
select 'indents', i.id, cast(case when i.category_id not in {DELETED_CATEGORIES} then i.category_id end as double),
  coalesce(i.category_id in {DELETED_CATEGORIES}, false) from indent_links i
""", "product_links", "indent_links"))
def delete_categories(v, p):
    """Q-03 SET NULL as rows: products and indents after categories are deleted."""
    gone = v.categories.filter(F.col("id").isin(*DELETED_CATEGORIES))
    rows = [Q.set_null(child, "category_id", gone).select(
        F.lit(name).alias("child"), "id", F.col("category_id").cast("double").alias("category_id"), "nulled")
        for name, child in (("products", v.product_links), ("indents", v.indent_links))]
    return rows[0].unionByName(rows[1])


@register("delete_products", with_views("""
with m as (select product_id, count(*) n from movements group by 1),
r as (select product_id, count(*) n from issue_requests group by 1)
select p.p_partkey id, coalesce(m.n, 0) stock_transactions, coalesce(r.n, 0) issue_requests,
  m.n is not null or r.n is not null blocked
from part p left join m on m.product_id = p.p_partkey left join r on r.product_id = p.p_partkey
where p.p_partkey % 20 = 0
""", "movements", "issue_requests"))
def delete_products(v, p):
    """Q-03 RESTRICT as rows: inactive products with the rows that block their delete."""
    return Q.restricted(v.product_base.filter(F.col("status") == "inactive"),
                        {"stock_transactions": (v.movements, "product_id"),
                         "issue_requests": (v.issue_requests, "product_id")})


@register("delete_users_cascade", with_views("""
select employee_id user_id, id request_id, issued_at created_at from issue_requests
where status <> 'pending' and employee_id not in (select id from users where status = 'inactive')
""", "issue_requests", "users"))
def delete_users_cascade(v, p):
    """Q-03 CASCADE as rows: the notifications left after inactive users are deleted."""
    gone = v.users.filter(F.col("status") == "inactive")
    return Q.cascade(AL.notification_rows(v.issue_requests), "user_id", gone).select(
        "user_id", "request_id", "created_at")


@register("delete_effects", with_views("""
with d as (select id from users where status = 'inactive')
select 'issue_requests.employee_id' rule, 'SET NULL' action, count(*) affected_rows
  from issue_requests where employee_id in (select id from d)
union all select 'issue_requests.issued_by', 'SET NULL', count(*) from issue_requests
  where issued_by in (select id from d)
union all select 'movements.created_by', 'SET NULL', count(*) from movements
  where created_by in (select id from d)
union all select 'indents.employee_id', 'SET NULL', count(*) from indents
  where employee_id in (select id from d)
union all select 'audit_log.user_id', 'SET NULL', count(*) from audit_log
  where user_id in (select id from d)
union all select 'notifications.user_id', 'CASCADE', count(*) from issue_requests
  where status <> 'pending' and employee_id in (select id from d)
""", "users", "issue_requests", "movements", "indents", "audit_log"))
def delete_effects(v, p):
    """Q-03: rows nulled / removed if inactive users were deleted."""
    deleted = v.users.filter(F.col("status") == "inactive").select("id")
    notif = AL.notification_rows(v.issue_requests)
    return Q.delete_effects(deleted, {
        "issue_requests.employee_id": (v.issue_requests, "employee_id", "SET NULL"),
        "issue_requests.issued_by": (v.issue_requests, "issued_by", "SET NULL"),
        "movements.created_by": (v.movements, "created_by", "SET NULL"),
        "indents.employee_id": (v.indents, "employee_id", "SET NULL"),
        "audit_log.user_id": (v.audit_log, "user_id", "SET NULL"),
        "notifications.user_id": (notif, "user_id", "CASCADE"),
    })


#: A graph of four levels over the loaded tables, with all three actions.
GRAPH = [Key("customer", "c_nationkey", "nation", "CASCADE"), Key("orders", "o_custkey", "customer", "CASCADE"),
         Key("lineitem", "l_orderkey", "orders", "CASCADE"), Key("lineitem", "l_suppkey", "supplier", "SET NULL"),
         Key("supplier", "s_nationkey", "nation", "SET NULL"), Key("lineitem", "l_partkey", "part", "RESTRICT")]


@register("delete_graph", """
with recursive l as (select l_orderkey * 8 + l_linenumber id, l_orderkey, l_suppkey, l_partkey from lineitem),
roots as (select 'nation' root_table, n_nationkey root_id from nation where n_nationkey in (3, 8)
  union all select 'customer', c_custkey from customer where c_custkey % 25 = 3
  union all select 'supplier', s_suppkey from supplier
  union all select 'part', p_partkey from part where p_partkey % 20 = 0),
del(root_table, root_id, tab, id) as (
  select root_table, root_id, root_table, root_id from roots
  union
  select d.root_table, d.root_id, e.tab, e.id
  from del d join (
    select 'nation' parent, c_nationkey up, 'customer' tab, c_custkey id from customer
    union all select 'customer', o_custkey, 'orders', o_orderkey from orders
    union all select 'orders', l_orderkey, 'lineitem', id from l) e on e.parent = d.tab and e.up = d.id),
hit as (
  select root_table, root_id, 'CASCADE' effect, tab target, count(*) n from del group by all
  union all
  select d.root_table, d.root_id, 'SET NULL', 'lineitem.l_suppkey', count(*) from del d join l on d.tab = 'supplier' and l.l_suppkey = d.id
    where not exists (from del x where x.root_table = d.root_table and x.root_id = d.root_id and x.tab = 'lineitem' and x.id = l.id)
    group by all
  union all
  select d.root_table, d.root_id, 'SET NULL', 'supplier.s_nationkey', count(*) from del d join supplier s on d.tab = 'nation' and s.s_nationkey = d.id group by all
  union all
  select d.root_table, d.root_id, 'RESTRICT', 'lineitem.l_partkey', count(*) from del d join l on d.tab = 'part' and l.l_partkey = d.id group by all),
stop as (select distinct root_table, root_id, true blocked from hit where effect = 'RESTRICT')
select root_table, root_id, coalesce(blocked, false) blocked, effect, target, n
from hit left join stop using (root_table, root_id) where blocked is null or effect = 'RESTRICT'
""")
def delete_graph(v, p):
    """Q-03: deletes through the key graph, CASCADE and SET NULL over all levels, RESTRICT blocking its root only."""
    t = v.t
    frames = {
        "nation": t.nation.withColumn("id", F.col("n_nationkey").cast("long")),
        "customer": t.customer.withColumn("id", F.col("c_custkey").cast("long")),
        "orders": t.orders.withColumn("id", F.col("o_orderkey").cast("long")),
        "supplier": t.supplier.withColumn("id", F.col("s_suppkey").cast("long")),
        "part": t.part.withColumn("id", F.col("p_partkey").cast("long")),
        "lineitem": t.lineitem.withColumn("id", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long"))}
    roots = {"nation": frames["nation"].where("id in (3, 8)"), "customer": frames["customer"].where("id % 25 = 3"),
             "supplier": frames["supplier"], "part": frames["part"].where("id % 20 = 0")}
    return delete_through(frames, GRAPH, roots)


def _in(values):
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


@register("dq_enums", with_views(f"""
select rule, value, n, coalesce(in_domain, false) in_domain from (
  select 'movements.type' rule, type value, count(*) n, type in {_in(K.MOVEMENT_TYPES)} in_domain
    from movements group by type
  union all select 'users.role', role, count(*), role in {_in(K.ROLES)} from users group by role
  union all select 'users.status', status, count(*), status in {_in(K.ACTIVE_STATUSES)}
    from users group by status
  union all select 'issue_requests.status', status, count(*), status in {_in(K.ISSUE_STATUSES)}
    from issue_requests group by status
  union all select 'indents.status', status, count(*), status in {_in(K.INDENT_STATUSES)}
    from indents group by status
  union all select 'indents.priority', priority, count(*), priority in {_in(K.PRIORITIES)}
    from indents group by priority
  union all select 'audit_log.action', action, count(*), action in {_in(K.ACTION_SEVERITY)}
    from audit_log group by action) x
""", "movements", "users", "issue_requests", "indents", "audit_log"))
def dq_enums(v, p):
    """Q-04: enum values with counts and domain membership."""
    return Q.enum_profile({
        "movements.type": (v.movements, "type", K.MOVEMENT_TYPES),
        "users.role": (v.users, "role", K.ROLES),
        "users.status": (v.users, "status", K.ACTIVE_STATUSES),
        "issue_requests.status": (v.issue_requests, "status", K.ISSUE_STATUSES),
        "indents.status": (v.indents, "status", K.INDENT_STATUSES),
        "indents.priority": (v.indents, "priority", K.PRIORITIES),
        "audit_log.action": (v.audit_log, "action", list(K.ACTION_SEVERITY)),
    })


def _cnt(cond):
    return f"count(*) filter (where {cond})"


L = K.LENGTH_LIMITS
BIG = str(K.DECIMAL_12_2_LIMIT)
COLS_SQL = f"""
with pb as (select printf('P-%04d', p_partkey) product_code, p_name name, p_brand rack_location,
              cast(p_retailprice as decimal(12,2)) unit_price from part)
select * from (
  select 'products.name_required' rule, {_cnt('name is null')} violations from pb
  union all select 'products.code_required', {_cnt('product_code is null')} from pb
  union all select 'products.code_length',
    {_cnt(f"length(product_code) > {L['products']['product_code']}")} from pb
  union all select 'products.name_length', {_cnt(f"length(name) > {L['products']['name']}")}
    from pb
  union all select 'products.location_length',
    {_cnt(f"length(rack_location) > {L['products']['rack_location']}")} from pb
  union all select 'products.price_range', {_cnt(f'abs(unit_price) >= {BIG}')} from pb
  union all select 'users.name_required', {_cnt('name is null')} from users
  union all select 'users.username_required', {_cnt('username is null')} from users
  union all select 'users.username_length',
    {_cnt(f"length(username) > {L['users']['username']}")} from users
  union all select 'users.department_length',
    {_cnt(f"length(department) > {L['users']['department']}")} from users
  union all select 'issue_requests.employee_name_required', {_cnt('employee_name is null')}
    from issue_requests
  union all select 'issue_requests.quantity_range', {_cnt(f'abs(quantity_requested) >= {BIG}')}
    from issue_requests
  union all select 'issue_requests.work_order_length',
    {_cnt(f"length(work_order_ref) > {L['issue_requests']['work_order_ref']}")}
    from issue_requests) x
"""


@register("dq_columns", with_views(COLS_SQL, "users", "issue_requests"))
def dq_columns(v, p):
    """Q-05: required / length / decimal-range violation counts per rule."""
    return Q.column_rules(Q.standard_column_rules(v))
