"""Catalog entries: intake of adjustments, indents and users with their rules and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.operators import intake as I
from stockspark.plans.catalog import register, with_views


@register("adjustment_intake", with_views(f"""
with raw as (
  select created_at, ord_key, ord_line,
    cast(case when ord_key % 70 = 0 then null else product_id end as double) product_id, type,
    cast(case when ord_key % 50 = 0 then 0 else quantity end as double) quantity,
    trim(case when ord_line = 3 then ' ' when ord_line = 5 then null else ' Stock count' end) reason
  from movements where type in ('adjustment_in', 'adjustment_out')),
c as (select *, coalesce(product_id <> 0 and quantity > 0 and reason not in ('', '0'), false) valid from raw)
select *, null reference_number, '{I.ADJUSTMENT_MESSAGE}' message, null reference_type from c where not valid
union all
select *, printf('ADJ-%04d', row_number() over (order by created_at, product_id, ord_key, ord_line)), null, 'adjustment'
from c where valid
""", "movements"))
def adjustment_intake(v, p):
    """W-08/W-03: adjustment submissions: mandatory reason, ADJ number, message of refused ones."""
    line = F.col("ord_line")
    raw = v.movements.filter(F.col("type").startswith("adjustment")).select(
        "created_at", "ord_key", "ord_line",
        F.when(F.col("ord_key") % 70 != 0, F.col("product_id")).alias("product_id"), "type",
        F.when(F.col("ord_key") % 50 == 0, 0).otherwise(F.col("quantity")).alias("quantity"),
        F.when(line == 3, " ").when(line != 5, " Stock count").alias("reason"))
    out = I.adjustment_intake(raw, ["created_at", "product_id", "ord_key", "ord_line"])
    return out.withColumn("product_id", F.col("product_id").cast("double"))


INDENT_CHECKED = f"""
c as (select id, employee_id, employee_name, department, trim(item_name) item_name, quantity, unit,
        nullif(category_id, 0) category_id, priority, created_at,
        coalesce(trim(item_name) not in ('', '0') and quantity > 0, false) valid from indent_submissions),
n as (select *, printf('IND-%04d', row_number() over (order by created_at, id)) indent_number from c where valid)"""


def _indents(v):
    return I.indent_intake(v.indent_submissions.drop("status"), ["created_at", "id"])


@register("indent_intake", with_views(f"""
with {INDENT_CHECKED}
select * replace (cast(quantity as double) as quantity, cast(category_id as double) as category_id),
  null message, 'pending' status from n
union all by name
select * replace (cast(quantity as double) as quantity, cast(category_id as double) as category_id),
  null indent_number, '{I.INDENT_MESSAGE}' message,
  null status from c where not valid
""", "indent_submissions"))
def indent_intake(v, p):
    """S-15/W-03: indent submissions: rules, IND number, status pending, message of refused ones."""
    return _indents(v).withColumn("category_id", F.col("category_id").cast("double"))


@register("indent_notices", with_views(f"""
with {INDENT_CHECKED}
select indent_number, '📋 New Indent ' || indent_number title,
  employee_name || ' requested ' || cast(quantity as varchar) || ' ' || unit || ' of ' || item_name body,
  'info' as type, 'indents.php' link from n
""", "indent_submissions"))
def indent_notices(v, p):
    """W-10: the notice to admins and keepers of each accepted indent."""
    return I.new_indent_notices(_indents(v))


@register("user_intake", with_views(f"""
with raw as (
  select e.event_id seq, u.name, '  ' || upper(case when e.event_id % 2 = 0 then u.name else 'new ' || u.name end) || ' '
      username, case when e.event_id % 11 = 0 then '' else 'employee' end as role, e.event_id % 16 password_length
  from events e join users u on u.id = e.user_id where e.event_type = 'signup'
  union all select -s_suppkey - 1, s_name, s_name, 'keeper', 12 from supplier),
t as (select seq, name, lower(trim(username)) username, role, password_length,
  case when name is null or name = '' or role = '' or password_length = 0 then '{I.USER_REQUIRED_MESSAGE}'
       when password_length < {I.MIN_PASSWORD} then '{I.USER_PASSWORD_MESSAGE}' end fault from raw),
r as (select *, row_number() over (partition by username, fault is null order by seq) pos from t)
select seq, name, username, role, password_length, coalesce(fault,
    case when pos > 1 or username in (select username from users)
         then 'Username ''' || username || ''' already exists.' end) message,
  fault is null and pos = 1 and username not in (select username from users) valid
from r
""", "users"))
def user_intake(v, p):
    """S-15/W-03/J-07: user submissions: required fields, password length, username neither taken nor submitted before."""
    u = v.users.select(F.col("id").alias("user_id"), "name")
    odd = F.col("event_id") % 2 != 0
    raw = (v.t.events.filter(F.col("event_type") == "signup").join(u, "user_id").select(
        F.col("event_id").alias("seq"), "name",
        F.concat(F.lit("  "), F.upper(F.when(odd, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))),
                 F.lit(" ")).alias("username"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise("employee").alias("role"),
        (F.col("event_id") % 16).alias("password_length"))
        .unionByName(v.t.supplier.select((-F.col("s_suppkey") - 1).alias("seq"), F.col("s_name").alias("name"),
                                         F.col("s_name").alias("username"), F.lit("keeper").alias("role"),
                                         F.lit(12).cast("long").alias("password_length"))))
    return I.user_intake(raw, v.users, ["seq"])
