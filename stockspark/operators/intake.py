"""Submissions of adjustments, indents and users: rules, numbers, messages (W-03, W-08, S-15).

A submission keeps its row: ``valid`` and ``message`` say what became of it,
and only valid ones get a number.  A text is blank if it is null, white
space, or ``0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.operators.numbering import number_rows

# FIXED VALUES: messages and the shortest password
ADJUSTMENT_MESSAGE = "All fields including reason are mandatory for adjustments."
INDENT_MESSAGE = "Item name and quantity are required."
USER_REQUIRED_MESSAGE = "Name, username, password and role are required."
USER_PASSWORD_MESSAGE = "Password must be at least 8 characters."
MIN_PASSWORD = 8


def trimmed(c) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\0\x0b"))


def blank(c) -> Column:
    return F.coalesce(trimmed(c).isin("", "0"), F.lit(True))


def _no_quantity(c) -> Column:
    return ~F.coalesce(F.col(c) > 0, F.lit(False))


def _numbered(checked: DataFrame, order_cols, counter: str, out: str) -> DataFrame:
    """Numbers of the counter for the valid rows in ``order_cols`` order; null for the others."""
    ok = number_rows(checked.filter("valid"), order_cols, K.COUNTER_PREFIXES[counter], out=out)
    return ok.unionByName(checked.filter(~F.col("valid")).withColumn(out, F.lit(None).cast("string")))


def _checked(raw: DataFrame, bad: Column, message: str) -> DataFrame:
    return raw.withColumn("valid", ~bad).withColumn("message", F.when(bad, F.lit(message)))


def adjustment_intake(raw: DataFrame, order_cols) -> DataFrame:
    """Adjustments need a product, a positive quantity and a reason; the number is their reference."""
    bad = F.coalesce(F.col("product_id") == 0, F.lit(True)) | _no_quantity("quantity") | blank("reason")
    checked = _checked(raw.withColumn("reason", trimmed("reason")), bad, ADJUSTMENT_MESSAGE)
    return (_numbered(checked, order_cols, "adjustment", "reference_number")
            .withColumn("reference_type", F.when(F.col("valid"), F.lit("adjustment"))))


def indent_intake(raw: DataFrame, order_cols) -> DataFrame:
    """Indents need an item name and a positive quantity; valid ones are pending, category 0 is none."""
    bad = blank("item_name") | _no_quantity("quantity")
    checked = _checked(raw.withColumn("item_name", trimmed("item_name"))
                       .withColumn("category_id", F.when(F.col("category_id") != 0, F.col("category_id"))),
                       bad, INDENT_MESSAGE)
    return (_numbered(checked, order_cols, "indent", "indent_number")
            .withColumn("status", F.when(F.col("valid"), F.lit("pending"))))


def new_indent_notices(indents: DataFrame) -> DataFrame:
    """The notice that admins and keepers get of each accepted indent (one row an indent, not a recipient)."""
    return indents.filter("valid").select(
        "indent_number", F.concat(F.lit("📋 New Indent "), "indent_number").alias("title"),
        F.concat_ws(" ", "employee_name", F.lit("requested"), F.col("quantity").cast("string"), "unit",
                    F.lit("of"), "item_name").alias("body"),
        F.lit("info").alias("type"), F.lit("indents.php").alias("link"))


def user_intake(raw: DataFrame, users: DataFrame, order_cols) -> DataFrame:
    """New users need name, username, password and role, 8 characters of password, and a username that
    neither a user nor an earlier accepted submission has.

    ``raw`` carries the password's length only.  The earliest submission of a
    username is a map-side minimum.
    """
    r = (raw.withColumn("username", F.lower(trimmed("username"))).withColumn("name", trimmed("name"))
         .withColumn("_at", F.struct(*order_cols)))
    length = F.coalesce("password_length", F.lit(0))
    missing = blank("name") | blank("username") | blank("role") | (length == 0)
    r = r.withColumn("_fault", F.when(missing, F.lit(USER_REQUIRED_MESSAGE))
                     .when(length < MIN_PASSWORD, F.lit(USER_PASSWORD_MESSAGE)))
    first = (r.filter(F.col("_fault").isNull()).groupBy(F.col("username").alias("_name"))
             .agg(F.min("_at").alias("_first")))
    taken = users.groupBy(F.col("username").alias("_taken")).agg(F.count("*").alias("_n")).drop("_n")
    first = first.join(taken, F.col("_name") == F.col("_taken"), "left")
    j = r.join(first, F.col("username") == F.col("_name"), "left")
    again = F.col("_taken").isNotNull() | (F.col("_at") > F.col("_first"))
    message = F.coalesce("_fault", F.when(again, F.format_string("Username '%s' already exists.", "username")))
    return (j.withColumn("message", message).withColumn("valid", F.col("message").isNull())
            .drop("_at", "_fault", "_name", "_first", "_taken"))
