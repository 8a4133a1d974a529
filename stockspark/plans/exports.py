"""S-13 export registry: report type -> plan, title; unknown types rejected;
every export also yields its EXPORT audit row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.operators import reports as R
from stockspark.operators.dims import export_manifest
from stockspark.params import Params
from stockspark.sources.commits import CommitLog
from stockspark.sources.sinks import write_csv

# FIXED VALUES: export types and titles
TITLES = {
    "daily_issues": "Daily Issue Report",
    "stock_summary": "Stock Summary Report",
    "low_stock": "Low Stock Alert Report",
    "emp_history": "Employee Issue History",
    "category_stock": "Category-wise Stock Report",
    "stock_ledger": "Stock Movement Ledger",
    "audit_log": "Audit Log Export",
}

PLANS = {
    "daily_issues": R.daily_issue_report,
    "stock_summary": R.stock_summary,
    "low_stock": R.low_stock_report,
    "emp_history": R.employee_history,
    "category_stock": R.category_stock_report,
    "stock_ledger": R.stock_ledger,
    "audit_log": R.audit_export,
}


def export(v, p: Params, report_type: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Return (report rows, EXPORT audit row).  Raises on an unknown type."""
    if report_type not in PLANS:
        raise ValueError(f"Invalid report type: {report_type}")
    rows = PLANS[report_type](v, p)
    spark: SparkSession = v.spark
    audit = spark.range(1).select(
        F.lit(None).cast("bigint").alias("user_id"), F.lit("System").alias("user_name"),
        F.lit("system").alias("user_role"), F.lit("EXPORT").alias("action"),
        F.lit("Reports").alias("module"),
        F.lit(f"Exported {report_type} as {fmt} [{p.date_from} to {p.date_to}]").alias("details"))
    return rows, audit


def run_export(v, p: Params, report_type: str, path: str, audit_path: str, export_id: str) -> bool:
    """Write a report as CSV with its manifest and add its EXPORT row to the stored audit log.

    ``export_id`` names the export: run again after a crash it writes the
    files anew and logs them once.  Returns whether the row was added.
    """
    rows, audit = export(v, p, report_type)
    write_csv(rows, path, export_manifest({report_type: rows}, TITLES, p.date_from, p.date_to))
    log = CommitLog(v.spark, audit_path)
    if log.known(export_id):
        return False
    log.put("rows", audit.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")), export_id)
    log.commit(export_id)
    return True
