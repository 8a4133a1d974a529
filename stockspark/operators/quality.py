"""Declared integrity rules as data-quality jobs (Q-01..Q-05).

Each rule is a filter/anti-join producing violation rows tagged with the
rule name; rule outputs are unioned.  Key checks are ``groupBy`` counts
(map-side partial aggregation), FK checks are ``left_anti`` joins on the
key (Spark sizes the build side; no forced broadcast of growing tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark import constants as K


def _tag(df: DataFrame, rule: str, key_cols) -> DataFrame:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return df.select(F.lit(rule).alias("rule"), key.alias("key"))


def unique_violations(checks: dict) -> DataFrame:
    """Q-01: for each (rule -> (frame, key columns)) the keys seen more than once."""
    parts = []
    for rule, (df, cols) in checks.items():
        dup = df.groupBy(*cols).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        parts.append(dup.select(F.lit(rule).alias("rule"), key.alias("key"), "n"))
    return _union(parts)


def fk_violations(checks: dict) -> DataFrame:
    """Q-02: rows whose (non-null) reference has no parent row.

    All keys of a child are read in one scan and counted by (rule, reference),
    so a hot reference reaches the join as one row; all rules with the same
    parent share one anti-join, which needs no distinct parents."""
    children: dict = {}
    for rule, (child, col, parent, pcol) in checks.items():
        children.setdefault((id(child), id(parent), pcol), (child, parent, []))[2].append((rule, col))
    by_parent: dict = {}
    for (_, key, pcol), (child, parent, rules) in children.items():
        refs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(col).cast("long").alias("_ref"))
                         for rule, col in rules])
        counted = (child.select(F.inline(refs)).filter(F.col("_ref").isNotNull())
                   .groupBy("rule", "_ref").agg(F.count("*").alias("n")))
        by_parent.setdefault((key, pcol), (parent, []))[1].append(counted)
    parts = []
    for (_, pcol), (parent, counted) in by_parent.items():
        orphans = _union(counted).join(parent.select(F.col(pcol).cast("long").alias("_ref")), "_ref", "left_anti")
        parts.append(orphans.select("rule", F.col("_ref").cast("string").alias("key"), "n"))
    return _union(parts)


def delete_effects(deleted: DataFrame, effects: dict) -> DataFrame:
    """Q-03: what deleting the keys in ``deleted`` (column ``id``) does under
    each declared rule: SET NULL (rows whose reference is nulled), CASCADE
    (rows removed), RESTRICT (rows that block the delete).  One count per
    (table.column, action)."""
    parts = []
    d = deleted.select(F.col("id").alias("_ref")).distinct()
    for rule, (child, col, action) in effects.items():
        hit = child.select(F.col(col).alias("_ref")).join(d, "_ref", "left_semi")
        parts.append(hit.agg(F.count("*").alias("affected_rows")).select(
            F.lit(rule).alias("rule"), F.lit(action).alias("action"), "affected_rows"))
    return _union(parts)


def set_null(child: DataFrame, col: str, deleted: DataFrame) -> DataFrame:
    """Q-03 SET NULL: the child's rows with references to deleted ids nulled, and which (``nulled``)."""
    gone = deleted.select(F.col("id").alias("_ref"))
    j = child.join(gone, F.col(col) == F.col("_ref"), "left")
    nulled = F.col("_ref").isNotNull()
    return j.withColumn("nulled", nulled).withColumn(col, F.when(~nulled, F.col(col))).drop("_ref")


def cascade(child: DataFrame, col: str, deleted: DataFrame) -> DataFrame:
    """Q-03 CASCADE: the child's rows that stay (references to nothing stay)."""
    gone = deleted.select(F.col("id").alias("_ref"))
    return child.join(gone, F.col(col) == F.col("_ref"), "left_anti")


def restricted(deleted: DataFrame, children: dict) -> DataFrame:
    """Q-03 RESTRICT: per id to delete the rows of each child (name -> (frame, column)) and whether they
    block it.  References are counted before the join."""
    out = deleted.select("id")
    for name, (child, col) in children.items():
        n = child.groupBy(F.col(col).alias("_ref")).agg(F.count("*").alias(name))
        out = out.join(n, F.col("id") == F.col("_ref"), "left").drop("_ref")
    counts = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in children]
    return out.select("id", *counts, F.coalesce(*children).isNotNull().alias("blocked"))


def enum_profile(checks: dict) -> DataFrame:
    """Q-04: every distinct value of an enum column with its count and
    whether it belongs to the declared domain."""
    parts = []
    for rule, (df, col, domain) in checks.items():
        g = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
        parts.append(g.select(F.lit(rule).alias("rule"), "value", "n",
                              F.coalesce(F.col("value").isin(domain), F.lit(False))
                              .alias("in_domain")))
    return _union(parts)


def column_rules(checks: dict) -> DataFrame:
    """Q-05: violation counts for required / length / decimal-range rules.
    Every rule reports a row (0 when clean); one aggregate pass per table."""
    parts = []
    for table, (df, rules) in checks.items():
        agg = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules])
        stack = ", ".join(f"'{table}.{name}', `{name}`" for name, _ in rules)
        parts.append(agg.selectExpr(f"stack({len(rules)}, {stack}) as (rule, violations)"))
    return _union(parts)


def standard_column_rules(views) -> dict:
    lim = K.LENGTH_LIMITS
    big = F.lit(K.DECIMAL_12_2_LIMIT)

    def too_long(c, n):
        return F.coalesce(F.length(c) > n, F.lit(False))

    p = views.product_base
    u = views.users
    ir = views.issue_requests
    return {
        "products": (p, [
            ("name_required", F.col("name").isNull()),
            ("code_required", F.col("product_code").isNull()),
            ("code_length", too_long("product_code", lim["products"]["product_code"])),
            ("name_length", too_long("name", lim["products"]["name"])),
            ("location_length", too_long("rack_location", lim["products"]["rack_location"])),
            ("price_range", F.coalesce(F.abs("unit_price") >= big, F.lit(False)))]),
        "users": (u, [
            ("name_required", F.col("name").isNull()),
            ("username_required", F.col("username").isNull()),
            ("username_length", too_long("username", lim["users"]["username"])),
            ("department_length", too_long("department", lim["users"]["department"]))]),
        "issue_requests": (ir, [
            ("employee_name_required", F.col("employee_name").isNull()),
            ("quantity_range", F.coalesce(F.abs("quantity_requested") >= big, F.lit(False))),
            ("work_order_length",
             too_long("work_order_ref", lim["issue_requests"]["work_order_ref"]))]),
    }


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
