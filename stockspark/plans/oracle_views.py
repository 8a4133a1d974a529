"""The domain views as DuckDB CTE text, for the independent SQL oracle.

Each oracle query is ``WITH RECURSIVE <needed views> <query>``.  The view
texts follow FIXTURES.md section B; the ledger fold (``fold``) is a
recursive CTE over per-product row numbers, i.e. an independent
implementation of the refusing balance.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _v(name, deps, body):
    VIEWS[name] = (deps, body)


_v("categories", [], """
select cast(row_number() over (order by name) as bigint) id, name, 'active' status
from (select distinct p_type name from part union all select 'UNUSED' name) x""")

_v("movements", [], """
select l_partkey product_id, l_shipdate created_at, l_orderkey ord_key, l_linenumber ord_line,
  case when l_returnflag='R' then 'return'
       when l_returnflag='N' and l_linestatus='O' then 'stock_in'
       when l_returnflag='N' then 'stock_out'
       when l_linestatus='O' then 'adjustment_in' else 'adjustment_out' end as type,
  cast(l_quantity as decimal(12,2)) quantity,
  cast(case when l_returnflag<>'R' and l_linestatus='F' then -l_quantity else l_quantity end
       as decimal(12,2)) signed_qty,
  l_suppkey supplier_id, l_orderkey % 30 created_by
from lineitem""")

_v("mv_seq", ["movements"], """
select *, row_number() over (partition by product_id order by created_at, ord_key, ord_line) rn
from movements""")

_v("fold", ["mv_seq"], """
select product_id, rn,
  cast(case when signed_qty >= 0 then signed_qty else 0 end as decimal(18,2)) bal,
  signed_qty >= 0 acc
from mv_seq where rn = 1
union all
select m.product_id, m.rn,
  cast(case when f.bal + m.signed_qty >= 0 then f.bal + m.signed_qty else f.bal end as decimal(18,2)),
  f.bal + m.signed_qty >= 0
from fold f join mv_seq m on m.product_id = f.product_id and m.rn = f.rn + 1""")

_v("ledger", ["mv_seq", "fold"], """
select m.product_id, m.created_at, m.ord_key, m.ord_line, m.type, m.quantity, m.signed_qty,
  m.supplier_id, m.created_by,
  cast(case when f.acc then f.bal - m.signed_qty else f.bal end as decimal(12,2)) balance_before,
  cast(f.bal as decimal(12,2)) balance_after, f.acc accepted
from mv_seq m join fold f on f.product_id = m.product_id and f.rn = m.rn""")

_v("stock", ["fold"], """
select product_id, cast(arg_max(bal, rn) as decimal(12,2)) current_stock
from fold group by product_id""")

_v("stock_transactions", ["ledger"], """
select printf('TXN-%04d', row_number() over (order by created_at, product_id, ord_key, ord_line))
  txn_number, *,
  case when type = 'stock_out' then 'ISS-' || cast(ord_key as varchar) end reference_number,
  case when type = 'stock_in' then 'INV-' || cast(ord_key as varchar) end invoice_number,
  case when type in ('adjustment_in', 'adjustment_out') then 'Stock count' end remarks
from ledger where accepted""")

_v("products", ["categories", "stock"], """
select p.p_partkey id,
  concat('P-', case when p.p_partkey<10 then '000' when p.p_partkey<100 then '00'
                    when p.p_partkey<1000 then '0' else '' end,
         cast(p.p_partkey as varchar(20))) product_code,
  p.p_name name, c.id category_id, 'Nos' unit,
  coalesce(m.current_stock, cast(0 as decimal(12,2))) current_stock,
  cast(p.p_partkey % 7 as decimal(12,2)) reserved_stock,
  cast(p.p_size*10 as decimal(12,2)) min_stock_level,
  p.p_brand rack_location,
  case when p.p_partkey % 3 = 0 then null else p.p_brand end supplier_name,
  cast(p.p_retailprice as decimal(12,2)) unit_price,
  case when p.p_partkey % 20 = 0 then 'inactive' else 'active' end status
from part p
left join categories c on c.name = p.p_type
left join stock m on m.product_id = p.p_partkey""")

_v("users", [], """
select c_custkey id, c_name name, lower(c_name) username,
  case when c_custkey % 50 = 0 then null else c_mktsegment end department,
  case c_custkey % 20 when 0 then 'admin' when 1 then 'keeper' when 2 then 'management'
                      else 'employee' end as role,
  case when c_custkey % 25 = 3 then 'inactive' else 'active' end status
from customer""")

_v("issue_requests", ["users"], """
select concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)),
         cast(l_partkey as varchar(20)), cast(cast(l_shipdate as date) as varchar(20))) id,
  o_custkey employee_id, u.name employee_name, u.department, l_partkey product_id,
  cast(l_quantity as decimal(12,2)) quantity_requested,
  case st when 'issued' then cast(l_quantity as decimal(12,2))
          when 'partially_issued' then cast(floor(l_quantity/2) as decimal(12,2)) end quantity_issued,
  case when l_linenumber % 3 = 0 then null
       else concat('WO-', cast(l_orderkey % 500 as varchar(20))) end work_order_ref,
  st status, o_orderdate created_at,
  case when st='pending' then null
       else o_orderdate + interval '1' day * (1 + l_linenumber % 5) end issued_at,
  case when st='pending' then null else o_custkey % 30 end issued_by
from lineitem
join (select *, case o_orderstatus when 'F' then 'issued' when 'P' then 'partially_issued'
        else case when o_orderpriority='5-LOW' then 'rejected' else 'pending' end end as st
      from orders) o on l_orderkey = o_orderkey
join users u on u.id = o_custkey""")

_v("indents", [], """
select o_orderkey id, o_custkey employee_id,
  case o_orderstatus when 'F' then 'approved' when 'O' then 'pending'
    else case when o_orderpriority='5-LOW' then 'converted' else 'rejected' end end as status,
  case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'urgent'
    else 'normal' end as priority,
  o_orderdate created_at
from orders""")

_v("indent_submissions", ["indents", "users"], """
select i.*, u.name employee_name, u.department,
  case when i.id % 40 = 0 then ' ' else 'Item ' || cast(i.id % 100 as varchar) end item_name,
  cast(i.id % 25 as decimal(12,2)) quantity, 'Nos' unit, i.id % 10 category_id
from indents i left join users u on u.id = i.employee_id""")

_v("product_links", ["categories"], """
select p.p_partkey id, c.id category_id, p.p_partkey % 31 - 1 created_by
from part p left join categories c on c.name = p.p_type""")

_v("request_transactions", [], """
select l_orderkey * 10 + l_linenumber stock_txn_id
from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus in ('F', 'P')""")

_v("indent_links", ["indent_submissions"], """
select id, case when status = 'approved' then employee_id % 30 end approved_by,
  nullif(category_id, 0) category_id from indent_submissions""")

_v("numbered_indents", ["indent_submissions"], """
select printf('IND-%04d', row_number() over (order by created_at, id)) indent_number, *
from indent_submissions""")

_v("numbered_requests", ["issue_requests"], """
select printf('ISS-%04d', row_number() over (order by created_at, id)) issue_number, *
from issue_requests""")

_v("audit_log", ["users"], """
select e.event_id id, e.user_id, u.name user_name, u.role user_role,
  case e.event_type when 'click' then 'REQUEST' when 'view' then 'EXPORT'
    when 'purchase' then 'APPROVE' when 'signup' then 'LOGIN' else 'FAILED_LOGIN' end as action,
  case e.event_type when 'click' then 'Issue Request' when 'view' then 'Reports'
    when 'purchase' then 'Indent' else 'System' end as module,
  e.props details, '10.0.0.' || cast(e.event_id % 250 as varchar) ip_address, e.ts created_at
from events e left join users u on u.id = e.user_id""")


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(query: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH RECURSIVE`` the named views (and their dependencies) + query.

    ``extra`` adds query-local CTEs (name, body) after the views.
    """
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _closure(list(names))]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    q = query.lstrip()
    if q[:5].lower() == "with ":          # merge the query's own CTE list
        if not parts:
            return "WITH RECURSIVE " + q[5:]
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + q[5:]
    if not parts:
        return query
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query
