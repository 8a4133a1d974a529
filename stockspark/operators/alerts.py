"""Low-stock alerts and notifications.

The application inserts one notification per admin/keeper for every alert.
Materialising that fan-out is alerts x recipients rows; here an alert is
stored once and per-recipient figures are attached to the recipients as
scalar subqueries over the alert table, so no job emits all
(alert, recipient) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.params import Params


def recipients(users: DataFrame) -> DataFrame:
    """Active admins and keepers (the alert audience)."""
    return users.filter(F.col("role").isin("admin", "keeper") & (F.col("status") == "active"))


def stock_alerts(ledger: DataFrame, products: DataFrame, minimums: DataFrame | None = None,
                 keep: tuple = ()) -> DataFrame:
    """R-06: one alert per accepted movement that leaves the balance at or
    below the minimum.  Level uses the strict bound (balance < 0.3 * min).

    ``minimums`` (product_id, valid_from, min_stock_level) gives the level
    that was valid at the movement (T-02); before a product's first version,
    and without the table, the product's own level counts.  ``keep``: more
    columns of the ledger to hand on."""
    pr = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"),
                         "unit", "min_stock_level")
    acc = ledger.filter(F.col("accepted"))
    if minimums is not None:
        from stockspark.operators.asof import asof_join
        versions = minimums.select("product_id", "valid_from", F.col("min_stock_level").alias("_min"))
        needed = acc.select("product_id", "created_at", "ord_key", "ord_line", "balance_after", *keep)
        acc = asof_join(needed, versions, "product_id", "created_at", "valid_from")
    acc = acc.join(pr, "product_id")
    if minimums is not None:
        acc = acc.withColumn("min_stock_level", F.coalesce("_min", "min_stock_level"))
    hit = acc.filter(F.col("balance_after") <= F.col("min_stock_level"))
    level = X.alert_level_strict("balance_after", "min_stock_level")
    return hit.select(
        "product_id", "created_at", "ord_key", "ord_line", "balance_after", "min_stock_level",
        level.alias("level"),
        F.concat(F.lit("⚠️ "), level, F.lit(" Stock: "), F.col("product")).alias("title"),
        F.format_string("%s has only %s %s (Min: %s)", F.col("product"),
                        F.col("balance_after").cast("string"), F.col("unit"),
                        F.col("min_stock_level").cast("string")).alias("body"),
        F.when(level == "CRITICAL", "danger").otherwise("warning").alias("type"),
        F.lit("inventory.php").alias("link"), *keep)


def alert_fanout(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """J-08 delivery per recipient: every active admin/keeper receives every
    alert, so per-recipient counts are the alert totals, attached to each
    recipient as scalar subqueries of one aggregate (no alert x recipient rows)."""
    from stockspark.operators.common import attach_scalars
    totals = alerts.agg(F.count("*").alias("alerts"),
                        F.count_if(F.col("level") == "CRITICAL").alias("critical_alerts"),
                        F.max("created_at").alias("last_alert_at"))
    r = recipients(users).select(F.col("id").alias("user_id"), "name", "role")
    return attach_scalars(r, totals)


def notification_rows(requests: DataFrame, *extra: str) -> DataFrame:
    """One notification per decided request (with the columns ``extra``): to
    the requester, created at the decision time.  Requests without a
    requester get none."""
    dec = requests.filter((F.col("status") != "pending") & F.col("employee_id").isNotNull())
    approved = F.col("status").isin("issued", "partially_issued")
    return dec.select(
        F.col("employee_id").alias("user_id"),
        F.col("id").alias("request_id"),
        F.when(approved, F.lit("✅ Issue Request Approved"))
         .otherwise(F.lit("❌ Issue Request Rejected")).alias("title"),
        F.when(approved, "success").otherwise("danger").alias("type"),
        F.lit("issues.php").alias("link"),
        F.lit(False).alias("is_read"),
        F.col("issued_at").alias("created_at"), *extra)


def workflow_notifications(requests: DataFrame, products: DataFrame) -> DataFrame:
    """W-10: ``notification_rows`` with their texts: number, product and
    status of an approved request, number and reason of a rejected one
    (``requests`` carries ``issue_number``; blank where there is no
    ``rejection_reason``)."""
    reason = F.col("rejection_reason") if "rejection_reason" in requests.columns else F.lit(None).cast("string")
    pr = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    text = F.when(F.col("status").isin("issued", "partially_issued"),
                  F.format_string("Your request %s for %s has been %s.", "issue_number", "product", "status")) \
            .otherwise(F.format_string("Your request %s was rejected. Reason: %s", F.col("issue_number"),
                                       F.coalesce(reason, F.lit(""))))
    return notification_rows(requests.join(pr, "product_id").withColumn("body", text), "body")


def read_markers(requests: DataFrame) -> DataFrame:
    """Stand-in read marks: a user has read everything up to the last time
    they raised a request."""
    return requests.groupBy(F.col("employee_id").alias("user_id")).agg(
        F.max("created_at").alias("read_at"))


def mark_read(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """S-10 set form: is_read for every notification created at or before the
    user's read mark (a left join on the user, one mark per user)."""
    j = notifications.join(marks, "user_id", "left")
    return (j.withColumn("is_read", F.col("is_read")
                         | F.coalesce(F.col("created_at") <= F.col("read_at"), F.lit(False)))
            .drop("read_at"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    """A-15 for all users at once."""
    return (notifications.filter(~F.col("is_read")).groupBy("user_id")
            .agg(F.count("*").alias("unread")))


def recent_notifications(notifications: DataFrame, k: int = K.TOP_NOTIFICATIONS) -> DataFrame:
    """L-02 per user: newest k by row_number within the user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("request_id"))
    return (notifications.withColumn("pos", F.row_number().over(w))
            .filter(F.col("pos") <= k))


def build_notifications(v, p: Params) -> DataFrame:
    return mark_read(notification_rows(v.issue_requests), read_markers(v.issue_requests))
