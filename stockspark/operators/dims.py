"""Master data operators: lookups, loads, upserts, overlays, permissions.

Mutations of the application (UPDATE/INSERT on master rows) become set
operations on immutable snapshots: a change-set is joined to the snapshot
and a new snapshot is produced.
"""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.operators.common import attach_scalars
from stockspark.operators.numbering import rank_rows

D12 = "decimal(12,2)"


def _const_join(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (scalar subqueries)."""
    return attach_scalars(left, one_row)


# ------------------------------------------------------------------ S-03
def product_lookup(products: DataFrame, categories: DataFrame, keys: DataFrame) -> DataFrame:
    """Bulk form of 'product + category by id, NULL if absent'."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    p = products.join(c, "category_id", "left")
    return (keys.select("product_id").distinct()
            .join(p, F.col("product_id") == p.id, "left")
            .select("product_id", "product_code", "name", "category_name", "current_stock",
                    "reserved_stock"))


# ------------------------------------------------------------------ S-05
def audit_normalise(raw: DataFrame) -> DataFrame:
    """Upper-case action, default user/role/ip, agent cut to 250 chars."""
    return raw.select(
        "id", "user_id",
        F.coalesce("user_name", F.lit("System")).alias("user_name"),
        F.coalesce("user_role", F.lit("system")).alias("user_role"),
        F.upper("action").alias("action"), "module", "record_id", "details",
        F.coalesce("ip_address", F.lit("0.0.0.0")).alias("ip_address"),
        F.substring(F.coalesce("user_agent", F.lit("")), 1, K.AGENT_MAX_CHARS).alias("user_agent"),
        "created_at")


# ------------------------------------------------------------------ S-06
def opening_stock(products: DataFrame, opening_map: DataFrame, existing: DataFrame) -> DataFrame:
    """INSERT IGNORE ... SELECT id, CASE code ... ELSE 0: one stock row per
    product without one, opening from the code map (default 0)."""
    m = opening_map.select(F.col("product_code").alias("_code"), F.col("opening").cast(D12))
    rows = (products.select("id", "product_code")
            .join(m, F.col("product_code") == F.col("_code"), "left")
            .join(existing.select(F.col("product_id").alias("id")), "id", "left_anti"))
    opening = F.coalesce("opening", F.lit(0).cast(D12))
    return rows.select(F.col("id").alias("product_id"), "product_code",
                       opening.alias("opening_stock"), opening.alias("current_stock"))


# ------------------------------------------------------------------ S-07
def opening_movements(products: DataFrame) -> DataFrame:
    """One opening stock_in per product with stock > 0: before 0, after = stock."""
    p = products.filter(F.col("current_stock") > 0)
    return p.select(
        F.col("id").alias("product_id"),
        F.concat(F.lit("TXN-OP-"), F.col("id").cast("string")).alias("txn_number"),
        F.lit("stock_in").alias("type"), F.col("current_stock").alias("quantity"),
        F.lit(0).cast(D12).alias("balance_before"), F.col("current_stock").alias("balance_after"),
        F.lit("OPENING").alias("reference_number"), F.lit("opening").alias("reference_type"),
        F.lit("Opening stock").alias("remarks"))


# ------------------------------------------------------------------ S-08
def product_upsert(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Update rows whose ``id`` is given, insert the others.

    New ids continue after the current maximum; new codes are
    P-(count + n) as in the application ('COUNT(*)+1').  The per-insert
    position comes from the partitioned ranking (no global sort in one task).
    """
    cols = ["name", "min_stock_level", "unit_price"]
    upd = changes.filter(F.col("id").isNotNull())
    ins = changes.filter(F.col("id").isNull()).drop("id")
    cur = snapshot.select("id", "product_code", *cols, "status")
    u = upd.select("id", *[F.col(c).alias(f"_new_{c}") for c in cols])
    merged = cur.join(u, "id", "left").select(
        "id", "product_code",
        *[F.coalesce(f"_new_{c}", c).alias(c) for c in cols], "status",
        F.when(F.col("_new_name").isNotNull(), "updated").otherwise("unchanged").alias("change"))
    stats = snapshot.agg(F.max("id").alias("_max_id"), F.count("*").alias("_cnt"))
    ranked = _const_join(rank_rows(ins, ["name", "ins_key"], "_seq"), stats)
    new_rows = ranked.select(
        (F.col("_max_id") + F.col("_seq")).alias("id"),
        X.product_code(F.col("_cnt") + F.col("_seq")).alias("product_code"),
        *cols, F.lit("active").alias("status"), F.lit("inserted").alias("change"))
    return merged.unionByName(new_rows)


# ------------------------------------------------------------------ S-09
def status_overlay(snapshot: DataFrame, changes: DataFrame, order_cols) -> DataFrame:
    """Latest status change per key (max_by over the change order, partial
    aggregation map-side) left-joined onto the snapshot."""
    latest = changes.groupBy("id").agg(
        F.max_by("status", F.struct(*order_cols)).alias("_new_status"))
    j = snapshot.select("id", "status").join(latest, "id", "left")
    return j.select("id", F.coalesce("_new_status", "status").alias("status"),
                    (F.col("_new_status").isNotNull()
                     & (F.col("_new_status") != F.col("status"))).alias("changed"))


# ------------------------------------------------------------------ S-15
def request_intake(raw: DataFrame, order_cols, prefix: str = "ISS") -> DataFrame:
    """Validated submissions get a number and status pending."""
    from stockspark.operators.numbering import number_rows
    ok = raw.filter(F.col("product_id").isNotNull() & (F.col("quantity_requested") > 0))
    numbered = number_rows(ok, order_cols, prefix, out="issue_number")
    return numbered.select("issue_number", "employee_id", "employee_name", "department",
                           "product_id", "quantity_requested", F.lit("pending").alias("status"),
                           "created_at")


# ------------------------------------------------------------------ J-07
def username_check(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Existence check for requested usernames: taken = a user has it."""
    taken = users.select(F.col("username").alias("_u")).distinct()
    c = candidates.select("username").distinct()
    return (c.join(taken, c.username == taken._u, "left")
            .select("username", F.col("_u").isNotNull().alias("taken")))


# ------------------------------------------------------------------ P-13
def permission_table(spark) -> DataFrame:
    """(permission, role) pairs of the fixed matrix: 11 permissions x <= 4 roles."""
    rows = list(chain.from_iterable(((p, r) for r in roles) for p, roles in K.PERMISSIONS.items()))
    return spark.createDataFrame(rows, "permission string, role string")


def effective_permissions(users: DataFrame) -> DataFrame:
    perms = permission_table(users.sparkSession)
    return (users.filter(F.col("status") == "active")
            .join(F.broadcast(perms), "role")
            .select(F.col("id").alias("user_id"), "role", "permission"))


# ------------------------------------------------------------------ P-12
def visible_request_counts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests each viewer may see: employees their own, others all.

    Set form without (viewer, request) pairs: employee viewers join the
    per-owner counts; every other viewer gets the total (scalar subquery)."""
    own = requests.groupBy(F.col("employee_id").alias("id")).agg(F.count("*").alias("_own"))
    total = requests.agg(F.count("*").alias("_all"))
    v = _const_join(users.select("id", "role").join(own, "id", "left"), total)
    n = F.when(F.col("role") == "employee", F.coalesce("_own", F.lit(0))).otherwise(F.col("_all"))
    return v.select(F.col("id").alias("viewer_id"), "role", n.cast("bigint").alias("visible"))


# ------------------------------------------------------------------ S-12 / S-13
def export_manifest(reports: dict, title_of: dict, date_from: dt.date, date_to: dt.date,
                    generated_by: str = "System") -> DataFrame:
    """One manifest row per export (title, period, author, total records):
    the preamble/trailer of the CSV as data.  Counts are aggregates of each
    report plan; the union is small (one row per report)."""
    parts = []
    for name, df in reports.items():
        parts.append(df.agg(F.count("*").alias("total_records")).select(
            F.lit(name).alias("report"), F.lit(title_of[name]).alias("title"),
            F.lit(str(date_from)).alias("period_from"), F.lit(str(date_to)).alias("period_to"),
            F.lit(generated_by).alias("generated_by"), "total_records"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
