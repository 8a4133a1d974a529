"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as the application defines them:
enum domains, label texts, thresholds, page sizes, top-k sizes, the
permission matrix and the session gap.  They are data, listed in their
natural order.
"""

from decimal import Decimal

# ---- FIXED VALUES: enum domains -------------------------------------------
MOVEMENT_TYPES = ["stock_in", "stock_out", "adjustment_in", "adjustment_out", "return"]
OUT_TYPES = ["stock_out", "adjustment_out"]  # every other type adds stock
IN_TYPES = ["stock_in", "adjustment_in", "return"]
REFERENCE_TYPES = ["grn", "issue", "adjustment", "return", "opening"]
ROLES = ["admin", "keeper", "employee", "management"]
ACTIVE_STATUSES = ["active", "inactive"]
INDENT_STATUSES = ["pending", "approved", "rejected", "converted"]
ISSUE_STATUSES = ["pending", "issued", "partially_issued", "rejected"]
PRIORITIES = ["normal", "urgent", "critical"]
NOTIFICATION_TYPES = ["info", "success", "warning", "danger"]

# ---- FIXED VALUES: thresholds ----------------------------------------------
CRITICAL_FACTOR = Decimal("0.3")   # critical: current <= min * 0.3 (alert path: <)
SESSION_GAP_SECONDS = 3600         # idle gap that ends a session
AGENT_MAX_CHARS = 250              # audit user agent is cut to this length
NUMBER_PAD = 4                     # PREFIX-0001, grows past 9999

# ---- FIXED VALUES: page and top-k sizes ------------------------------------
ROWS_PER_PAGE = 25
AUDIT_ROWS_PER_PAGE = 50
TOP_LOW_STOCK = 8
TOP_PENDING = 5
TOP_ACTIVITY = 8
TOP_PRODUCTS = 10
TOP_EMPLOYEES = 15
TOP_NOTIFICATIONS = 8

# ---- FIXED VALUES: labels ---------------------------------------------------
MOVEMENT_LABELS = {
    "stock_in": "Stock In",
    "stock_out": "Stock Out",
    "adjustment_in": "Adjustment In",
    "adjustment_out": "Adjustment Out",
    "return": "Return",
}
STATUS_LABELS = {
    "pending": "Pending",
    "approved": "Approved",
    "rejected": "Rejected",
    "issued": "Issued",
    "converted": "Converted",
    "partially_issued": "Partial",
    "active": "Active",
    "inactive": "Inactive",
}
ROLE_LABELS = {
    "admin": "Store Admin",
    "keeper": "Store Keeper",
    "employee": "Employee",
    "management": "Management",
}
PRIORITY_LABELS = {
    "normal": "Normal",
    "urgent": "Urgent",
    "critical": "Critical",
}
ACTION_SEVERITY = {
    "LOGIN": "info",
    "LOGOUT": "gray",
    "APPROVE": "success",
    "REJECT": "danger",
    "STOCK IN": "success",
    "ADJUSTMENT": "warning",
    "CREATE USER": "info",
    "UPDATE USER": "warning",
    "STATUS": "warning",
    "ADD": "success",
    "EDIT": "warning",
    "REQUEST": "pending",
    "ISSUE": "success",
    "FAILED_LOGIN": "danger",
    "EXPORT": "gray",
}

# ---- FIXED VALUES: permission matrix (permission -> roles) ------------------
PERMISSIONS = {
    "add_product": ["admin"],
    "edit_product": ["admin"],
    "approve_indent": ["admin", "keeper"],
    "approve_issue": ["admin", "keeper"],
    "stock_in": ["admin", "keeper"],
    "stock_adjust": ["admin"],
    "manage_users": ["admin"],
    "view_reports": ["admin", "keeper", "management"],
    "raise_request": ["admin", "keeper", "employee"],
    "view_audit": ["admin", "management"],
    "view_stock_ledger": ["admin", "keeper", "management"],
}

# ---- FIXED VALUES: counters (name, prefix) ----------------------------------
COUNTER_PREFIXES = {
    "indent": "IND",
    "issue": "ISS",
    "grn": "GRN",
    "txn": "TXN",
    "adjustment": "ADJ",
}

# ---- FIXED VALUES: column length limits (DDL) -------------------------------
LENGTH_LIMITS = {
    "categories": {"name": 50},
    "users": {"employee_id": 20, "name": 100, "username": 100, "department": 50},
    "products": {"product_code": 20, "name": 200, "unit": 20, "rack_location": 50,
                 "supplier_name": 100},
    "issue_requests": {"employee_name": 100, "department": 50, "work_order_ref": 100},
    "audit_log": {"user_name": 100, "user_role": 50, "action": 100, "module": 100},
}
# DECIMAL(12,2) holds |x| < 10^10
DECIMAL_12_2_LIMIT = Decimal("10000000000")
