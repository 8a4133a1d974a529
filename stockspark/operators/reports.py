"""Reports: KPIs, group-bys, trends, top-k and the exportable reports.

Every function takes the domain :class:`Views` and frozen :class:`Params`
and returns a lazy DataFrame.  Aggregations are plain ``groupBy().agg()``
so Spark does map-side partial aggregation before the shuffle; dimension
joins go through Spark's size-checked broadcast (AQE) rather than hints on
tables that grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.functions import filters as FL
from stockspark.params import Params

D12 = "decimal(12,2)"


def one_row(*frames: DataFrame) -> DataFrame:
    """Glue single-row aggregates side by side without a cartesian join:
    union them (missing columns null) and take the non-null value per column."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def _zero(c) -> F.Column:
    return F.coalesce(c, F.lit(0).cast(D12))


# ------------------------------------------------------------------ A-01/A-02
def dashboard_kpis(v, p: Params) -> DataFrame:
    """One pass per table with count_if; seven numbers in one row."""
    moved = v.accepted_between(p.as_of, p.as_of)
    pr = v.products.filter(F.col("status") == "active")
    prod = pr.agg(F.count("*").alias("total_products"),
                  F.count_if(X.is_low()).alias("low_stock"),
                  F.count_if(X.is_critical()).alias("critical_stock"))
    ind = v.indents.agg(F.count_if(F.col("status") == "pending").alias("pending_indents"))
    today = F.lit(p.as_of)
    iss = v.issue_requests.agg(
        F.count_if(F.col("status") == "pending").alias("pending_issues"),
        F.count_if((F.col("status") == "issued") & (F.to_date("issued_at") == today))
         .alias("issued_today"))
    st = moved.agg(_zero(F.sum(F.when(
        (F.col("type") == "stock_in") & (F.to_date("created_at") == today),
        F.col("quantity")))).alias("stock_in_today"))
    return one_row(prod, ind, iss, st)


# ------------------------------------------------------------------ A-03
def period_summary(v, p: Params) -> DataFrame:
    """Six scalar subqueries merged into three conditional aggregates."""
    rng = lambda c: FL.date_range(c, p.date_from, p.date_to)
    ir = v.issue_requests.agg(
        F.count_if((F.col("status") == "issued") & rng("issued_at")).alias("total_issued"),
        F.count_if((F.col("status") == "rejected") & rng("created_at")).alias("rejected_issues"))
    st = v.accepted_between(p.date_from, p.date_to).agg(
        _zero(F.sum(F.when(F.col("type") == "stock_in", F.col("quantity")))).alias("total_stock_in"),
        _zero(F.sum(F.when(F.col("type") == "stock_out", F.col("quantity"))))
         .alias("total_stock_out"))
    ind = v.indents.filter(rng("created_at")).agg(
        F.count("*").alias("total_indents"),
        F.count_if(F.col("status") == "approved").alias("approved_indents"))
    return one_row(ir, st, ind)


def _issued_in_range(v, p: Params) -> DataFrame:
    return v.issue_requests.filter((F.col("status") == "issued")
                                   & FL.date_range("issued_at", p.date_from, p.date_to))


# ------------------------------------------------------------------ A-04
def daily_issues(v, p: Params) -> DataFrame:
    """A-04: issued requests and quantity per issue day in the window."""
    return (_issued_in_range(v, p).groupBy(F.to_date("issued_at").alias("day"))
            .agg(F.count("*").alias("cnt"), F.sum("quantity_issued").alias("qty"))
            .orderBy("day"))


# ------------------------------------------------------------------ A-05
def monthly_trend(v, p: Params) -> DataFrame:
    """Issued requests per month over the six months before ``as_of``."""
    since = F.add_months(F.lit(p.as_of), -6)
    ir = v.issue_requests.filter((F.col("status") == "issued")
                                 & (F.col("issued_at") >= since.cast("timestamp_ntz")))
    return (ir.groupBy(F.date_trunc("month", "issued_at").alias("month_start"))
            .agg(F.count("*").alias("count"))
            .withColumn("month", X.month_label("month_start"))
            .orderBy("month_start"))


# ------------------------------------------------------------------ A-06 / K-04
def top_products(v, p: Params, k: int = K.TOP_PRODUCTS) -> DataFrame:
    """A-06/K-04: ten most issued products in the window, ranked after the limit."""
    agg = (_issued_in_range(v, p).groupBy("product_id")
           .agg(F.sum("quantity_issued").alias("total_qty")))
    top = (agg.join(v.product_base.select(F.col("id").alias("product_id"), "name", "unit"),
                    "product_id")
           .orderBy(F.desc("total_qty"), "product_id").limit(k))
    # rank after the limit: the window sees k rows only
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("total_qty"), "product_id")).cast("bigint"))


# ------------------------------------------------------------------ A-07
def dept_consumption(v, p: Params) -> DataFrame:
    """A-07: issued requests and quantity per department (NULL is its own group)."""
    return (_issued_in_range(v, p).groupBy("department")
            .agg(F.count("*").alias("requests"), F.sum("quantity_issued").alias("total_qty"))
            .orderBy(F.desc("total_qty"), "department"))


def _active_with_category(v, how="inner") -> DataFrame:
    pr = v.products.filter(F.col("status") == "active")
    c = v.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return pr.join(c, "category_id", how)


# ------------------------------------------------------------------ A-08
def category_overview(v, p: Params) -> DataFrame:
    """A-08: items, stock and low items per category (categories without products absent)."""
    return (_active_with_category(v).groupBy("category_id", "category")
            .agg(F.count("*").alias("items"), F.sum("current_stock").alias("total_stock"),
                 F.count_if(X.is_low()).alias("low_items"))
            .orderBy("category"))


# ------------------------------------------------------------------ A-09
def category_totals(v, p: Params) -> DataFrame:
    """A-09: stock per category, largest first."""
    return (_active_with_category(v).groupBy("category")
            .agg(F.sum("current_stock").alias("total"))
            .orderBy(F.desc("total"), "category"))


# ------------------------------------------------------------------ K-06
def category_share(v, p: Params) -> DataFrame:
    """Bar width = round(100 * total / max total), 0 if the max is 0.  The
    un-partitioned window runs over the per-category aggregate only."""
    t = category_totals(v, p)
    mx = F.max("total").over(Window.partitionBy())
    pct = F.when(mx > 0, F.round(F.col("total").cast("double") * 100.0 / mx.cast("double"))) \
           .otherwise(F.lit(0.0))
    return t.withColumn("pct", pct.cast("bigint"))


# ------------------------------------------------------------------ A-10 / J-04
def category_stock_report(v, p: Params) -> DataFrame:
    """Every category, active products only (filter before the outer join),
    zero-filled: MySQL gives 0 for the CASE sums of an empty category."""
    pr = v.products.filter(F.col("status") == "active").select(
        F.col("id").alias("pid"), "category_id", "current_stock", "min_stock_level")
    c = v.categories
    j = c.join(pr, c.id == pr.category_id, "left")
    has = F.col("pid").isNotNull()
    return (j.groupBy(c.id, c.name)
            .agg(F.count("pid").alias("total_products"),
                 _zero(F.sum("current_stock")).alias("total_stock"),
                 F.sum(F.when(has & X.is_low(), 1).otherwise(0)).cast("bigint").alias("low_items"),
                 F.sum(F.when(has & X.is_critical(), 1).otherwise(0)).cast("bigint")
                  .alias("critical_items"))
            .select(F.col("name").alias("category"), "total_products", "total_stock",
                    "low_items", "critical_items")
            .orderBy("category"))


# ------------------------------------------------------------------ A-11 / A-12
def _employee_history(v, p: Params, department=None) -> DataFrame:
    ir = _issued_in_range(v, p)
    if department:
        ir = ir.filter(F.col("department") == department)
    return ir.groupBy("employee_name", "department").agg(
        F.count("*").alias("total_requests"), F.sum("quantity_issued").alias("total_qty"),
        F.max("issued_at").alias("last_issued_at"))


def employee_history_top(v, p: Params, k: int = K.TOP_EMPLOYEES) -> DataFrame:
    """A-11: fifteen employees with most issued requests (count, qty, last issue time)."""
    return (_employee_history(v, p)
            .orderBy(F.desc("total_requests"), "employee_name", F.asc_nulls_first("department"))
            .limit(k))


def employee_history(v, p: Params) -> DataFrame:
    """A-12: employee issue history export (last issue date, optional department)."""
    return (_employee_history(v, p, p.department)
            .withColumn("last_request_date", F.to_date("last_issued_at"))
            .drop("last_issued_at")
            .orderBy(F.desc("total_requests"), "employee_name"))


# ------------------------------------------------------------------ A-13
def status_counts(v, p: Params) -> DataFrame:
    """Per status + total ('all') in one rollup instead of five queries."""
    ir = v.issue_requests
    r = ir.rollup("status").agg(F.count("*").alias("cnt"), F.grouping_id().alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("status"))
                    .alias("status"), "cnt")


def indent_status_counts(v, p: Params) -> DataFrame:
    """A-13: indent count per status plus an all row (one rollup)."""
    r = v.indents.rollup("status").agg(F.count("*").alias("cnt"), F.grouping_id().alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("status"))
                    .alias("status"), "cnt")


# ------------------------------------------------------------------ A-17
def last_login(v, p: Params) -> DataFrame:
    """A-17: last LOGIN per user, Never when absent."""
    logins = (v.audit_log.filter(F.col("action") == "LOGIN").groupBy("user_id")
              .agg(F.max("created_at").alias("last_login")))
    u = v.users.select("id", "name")
    return (u.join(logins, u.id == logins.user_id, "left")
            .select("id", "name", "last_login",
                    F.when(F.col("last_login").isNull(), F.lit("Never"))
                     .otherwise(X.fmt_datetime("last_login")).alias("last_login_text")))


# ------------------------------------------------------------------ R-01
def daily_issue_report(v, p: Params) -> DataFrame:
    """Export 'daily issues': dated by created_at, every status, optional dept."""
    ir = v.requests_between(p.date_from, p.date_to)
    if p.department:
        ir = ir.filter(F.col("department") == p.department)
    pr = v.product_base.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    u = v.users.select(F.col("id").alias("_uid"), F.col("name").alias("_issuer"))
    j = ir.join(pr, "product_id").join(u, F.col("issued_by") == F.col("_uid"), "left")
    return j.select(
        "issue_number", "created_at", "employee_name", "department", "product",
        "quantity_requested", _zero(F.col("quantity_issued")).alias("quantity_issued"),
        F.coalesce("work_order_ref", F.lit("")).alias("work_order"),
        F.coalesce("_issuer", F.lit("")).alias("issued_by"), "status"
    ).orderBy(F.desc("created_at"), X.number_seq("issue_number"))


# ------------------------------------------------------------------ R-02
def stock_summary(v, p: Params) -> DataFrame:
    """R-02: active products with category, available stock and class."""
    j = _active_with_category(v, "left")
    return j.select(
        "product_code", "name", "category", "unit", "current_stock", "reserved_stock",
        X.available().alias("available"), "min_stock_level",
        F.coalesce("rack_location", F.lit("")).alias("location"),
        F.coalesce("supplier_name", F.lit("")).alias("supplier"),
        X.stock_class().alias("stock_status")).orderBy("name", "product_code")


# ------------------------------------------------------------------ R-03 / L-01
def _low(v) -> DataFrame:
    return _active_with_category(v, "left").filter(X.is_low())


def low_stock_report(v, p: Params) -> DataFrame:
    """R-03: low-stock alert report, most urgent first (NULL ratio first)."""
    return _low(v).select(
        "product_code", "name", "category", "unit", "current_stock", "min_stock_level",
        X.available().alias("available"),
        F.coalesce("supplier_name", F.lit("")).alias("supplier"),
        F.coalesce("rack_location", F.lit("")).alias("location"),
        X.alert_class().alias("alert_level"),
        X.urgency_ratio().alias("ratio")
    ).orderBy(F.asc_nulls_first("ratio"), "product_code")


def low_stock_top(v, p: Params, k: int = K.TOP_LOW_STOCK) -> DataFrame:
    """Top-k most urgent: planned as TakeOrderedAndProject (no full sort)."""
    return (_low(v).select("id", "product_code", "name", "category", "current_stock",
                           "min_stock_level", X.urgency_ratio().alias("ratio"),
                           X.coverage_pct().alias("coverage_pct"))
            .orderBy(F.asc_nulls_first("ratio"), "id").limit(k))


# ------------------------------------------------------------------ R-04
def stock_ledger(v, p: Params) -> DataFrame:
    """R-04/J-05: numbered movement ledger with in/out split, balances, references and author."""
    st = v.transactions_between(p.date_from, p.date_to)
    pr = v.product_base.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    u = v.users.select(F.col("id").alias("_uid"), F.col("name").alias("_by"))
    qin, qout = X.in_out_split()
    j = st.join(pr, "product_id").join(u, F.col("created_by") == F.col("_uid"), "left")
    return j.select(
        "txn_number", "created_at", "product", X.movement_label("type").alias("type_label"),
        qin.alias("qty_in"), qout.alias("qty_out"), "balance_before", "balance_after",
        F.coalesce("reference_number", F.lit("")).alias("reference"),
        F.coalesce("invoice_number", F.lit("")).alias("invoice"),
        F.coalesce("remarks", F.lit("")).alias("remarks"),
        F.coalesce("_by", F.lit("System")).alias("done_by")
    ).orderBy(F.desc("created_at"), X.number_seq("txn_number").desc())


# ------------------------------------------------------------------ R-05
def audit_export(v, p: Params) -> DataFrame:
    """R-05: audit rows in the window, newest first."""
    a = v.audit_log.filter(FL.date_range("created_at", p.audit_from, p.audit_to))
    return a.orderBy(F.desc("created_at"), F.desc("id")).select(
        "created_at", "user_name", "user_role", "action", "module", "details", "ip_address")


# ------------------------------------------------------------------ R-07
def issue_review(v, p: Params) -> DataFrame:
    """Review facts for every pending request."""
    ir = v.issue_requests.filter(F.col("status") == "pending")
    pr = v.products.select(F.col("id").alias("product_id"), F.col("name").alias("product"),
                           "current_stock", "reserved_stock", "min_stock_level")
    j = ir.join(pr, "product_id")
    avail = X.available()
    req = F.col("quantity_requested")
    return j.select(
        "id", "product_id", "product", "quantity_requested", "current_stock",
        avail.alias("available"),
        (avail >= req).alias("can_issue"),
        ((req > avail) & (avail >= 0)).alias("shortage"),
        X.coverage_pct().alias("coverage_pct"),
        F.least(avail, req).alias("suggested_qty"))


# ------------------------------------------------------------------ J-01
def pending_issues(v, p: Params, k: int | None = None) -> DataFrame:
    """J-01: pending requests joined to their product, newest first."""
    ir = v.issue_requests.filter(F.col("status") == "pending")
    pr = v.product_base.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                           "unit")
    out = ir.join(pr, "product_id").select(
        "id", "employee_name", "product_id", "product_name", "unit", "quantity_requested",
        "created_at").orderBy(F.desc("created_at"), "id")
    return out.limit(k) if k else out


# ------------------------------------------------------------------ J-03
def audit_enriched(v, p: Params) -> DataFrame:
    """Audit rows left-joined to users; severity label per action."""
    u = v.users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"),
                       F.col("role").alias("user_role"), F.col("department"))
    j = v.audit_log.drop("user_name", "user_role").join(
        u, F.col("user_id") == F.col("_uid"), "left")
    return j.select("id", "user_id", X.blank_to("user_name", "System").alias("user_name"),
                    X.role_label(F.coalesce("user_role", F.lit("system"))).alias("role_label"),
                    "department", "action", X.action_severity("action").alias("severity"),
                    "module", "created_at")


# ------------------------------------------------------------------ J-05 (in R-04)
# ------------------------------------------------------------------ J-06
def issue_slips(v, p: Params) -> DataFrame:
    """Issue slip for every request in full issue (status ``issued``): 5-table
    star with the users dimension in two roles (issuer, employee)."""
    ir = v.issue_requests.filter(F.col("status") == "issued")
    pr = v.product_base.select(F.col("id").alias("product_id"), F.col("name").alias("product"),
                               "product_code", "unit", "rack_location", "category_id")
    c = v.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    issuer = v.users.select(F.col("id").alias("_iid"), F.col("name").alias("issued_by_name"))
    emp = v.users.select(F.col("id").alias("_eid"), F.col("username").alias("employee_username"),
                         F.col("role").alias("employee_role"))
    j = (ir.join(pr, "product_id").join(c, "category_id", "left")
         .join(issuer, F.col("issued_by") == F.col("_iid"), "left")
         .join(emp, F.col("employee_id") == F.col("_eid"), "left"))
    return j.select("id", "product_code", "product", "category", "unit", "rack_location",
                    "quantity_requested",
                    "quantity_issued", "employee_name", "employee_username", "employee_role",
                    "department", "issued_by_name", "issued_at", "status")


# ------------------------------------------------------------------ J-09
def indent_review(v, p: Params) -> DataFrame:
    """J-09: indents with requester, approver and labels (two left joins)."""
    i = v.indents
    emp = v.users.select(F.col("id").alias("_eid"), F.col("name").alias("employee_name"),
                         "department")
    appr = v.users.select(F.col("id").alias("_aid"), F.col("name").alias("approver_name"))
    j = (i.withColumn("approved_by", F.when(F.col("status") == "approved",
                                            F.col("employee_id") % 30))
         .join(emp, F.col("employee_id") == F.col("_eid"), "left")
         .join(appr, F.col("approved_by") == F.col("_aid"), "left"))
    return j.select("id", "employee_name", "department", "status",
                    X.status_label("status").alias("status_label"), "priority",
                    X.priority_label("priority").alias("priority_label"), "approver_name",
                    "created_at")


# ------------------------------------------------------------------ L-02
def recent_activity(v, p: Params, k: int = K.TOP_ACTIVITY) -> DataFrame:
    """L-02: eight newest audit rows."""
    return (v.audit_log.select("id", "user_name", "action", "module", "created_at")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(k))


# ------------------------------------------------------------------ P-05
def issued_today(v, p: Params) -> DataFrame:
    """P-05: requests issued on the as-of date."""
    return (v.issue_requests.filter((F.col("status") == "issued")
                                    & (F.to_date("issued_at") == F.lit(p.as_of)))
            .select("id", "employee_name", "product_id", "quantity_issued", "issued_at"))


# ------------------------------------------------------------------ D-01 / D-02
def facet_values(v, p: Params) -> DataFrame:
    """Distinct departments, modules and actions as (facet, value)."""
    d = v.users.filter(F.col("department").isNotNull()).select(
        F.lit("department").alias("facet"), F.col("department").alias("value"))
    m = v.audit_log.select(F.lit("module").alias("facet"), F.col("module").alias("value"))
    a = v.audit_log.select(F.lit("action").alias("facet"), F.col("action").alias("value"))
    return d.unionByName(m).unionByName(a).distinct().orderBy("facet", "value")


def audit_users(v, p: Params) -> DataFrame:
    """D-02: distinct (user id, user name) pairs in the audit log."""
    return (v.audit_log.filter(F.col("user_name").isNotNull())
            .dropDuplicates(["user_id", "user_name"]).select("user_id", "user_name")
            .orderBy("user_name", "user_id"))
