"""The application's own seed rows as DataFrames (golden inputs).

FIXED VALUES: categories, users, products, opening movements, indents and
issue requests exactly as the application's install script seeds them
(natural order).  Relative dates (NOW() - n days) are anchored at NOW.
"""

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

from stockspark.functions.filters import date_range

NOW = dt.datetime(2025, 3, 15, 12, 0, 0)
D = Decimal

CATEGORIES = ["Civil", "Electrical", "Plumbing", "Safety", "Office", "Mechanical", "Finishing"]

# (id, employee_id, name, department, role)
USERS = [
    (1, "EMP-001", "Rajesh Sharma", "Administration", "admin"),
    (2, "EMP-002", "Mukesh Patel", "Store", "keeper"),
    (3, "EMP-003", "Deepak Verma", "Electrical", "employee"),
    (4, "EMP-004", "Priya Singh", "Project", "employee"),
    (5, "EMP-005", "Vikram Mishra", "Management", "management"),
    (6, "EMP-006", "Suresh Yadav", "Civil", "employee"),
    (7, "EMP-007", "Neha Tiwari", "Admin", "employee"),
]

# (code, name, category_id, unit, current, reserved, min, rack, supplier)
PRODUCTS = [
    ("P-001", "14mm TMT Steel Rod", 1, "Nos", 150, 20, 50, "Yard-A1", "Raj Steel Traders"),
    ("P-002", "OPC Cement 50kg", 1, "Bag", 85, 10, 100, "Yard-B", "UltraTech Cement"),
    ("P-003", "XLPE Cable 4mm (Per Meter)", 2, "Meter", 300, 50, 100, "Rack-B2", "Havells India"),
    ("P-004", "MCB 32A Double Pole", 2, "Nos", 8, 2, 15, "Rack-B1", "Legrand India"),
    ("P-005", "PVC Conduit Pipe 25mm", 2, "Meter", 200, 0, 50, "Rack-B3", "Supreme Industries"),
    ("P-006", "CPVC Pipe 1 Inch (Per Meter)", 3, "Meter", 5, 0, 20, "Rack-C1", "Astral Pipes"),
    ("P-007", "ISI Safety Helmet", 4, "Nos", 25, 3, 20, "Rack-D1", "Safari Pro"),
    ("P-008", "Full Body Safety Harness", 4, "Nos", 12, 2, 10, "Rack-D2", "Karam Industries"),
    ("P-009", "A4 Paper Ream 500 Sheets", 5, "Ream", 20, 0, 10, "Office-1", "JK Paper Ltd"),
    ("P-010", "Exterior Wall Paint 20L", 7, "Pail", 18, 5, 10, "Yard-C", "Asian Paints"),
    ("P-011", "Coarse Sand 20mm Gravel", 1, "Cum", 45, 10, 20, "Yard-A", "Local Supplier"),
    ("P-012", "GI Binding Wire 1mm", 1, "Kg", 60, 0, 25, "Rack-A2", "Local Supplier"),
    ("P-013", "High Visibility Safety Vest", 4, "Nos", 30, 5, 20, "Rack-D3", "Safari Pro"),
    ("P-014", "Angle Grinder 4.5 inch", 6, "Nos", 4, 1, 2, "Tool-1", "Bosch India"),
    ("P-015", "Welding Rod 3.15mm (Box)", 6, "Box", 22, 3, 10, "Rack-E1", "D&H Secheron"),
]

# opening stock_in movements: (product_id, quantity)
OPENING = [(1, 150), (2, 85), (3, 300), (4, 8), (5, 200), (6, 5), (7, 25), (8, 12), (9, 20),
           (10, 18)]

# (number, employee_id, status, days_ago)
INDENTS = [("IND-0001", 3, "pending", 2), ("IND-0002", 6, "approved", 4),
           ("IND-0003", 4, "pending", 1), ("IND-0004", 7, "rejected", 5)]

# (number, employee_id, name, dept, product_id, requested, issued, work_order, status,
#  issued_by, issued_days_ago, created_days_ago)
ISSUES = [
    ("ISS-0001", 3, "Deepak Verma", "Electrical", 4, 2, 2, "WO-2501", "issued", 1, 2, 3),
    ("ISS-0002", 6, "Suresh Yadav", "Civil", 2, 10, None, "WO-2502", "pending", None, None, 1),
    ("ISS-0003", 4, "Priya Singh", "Project", 7, 5, None, "WO-2503", "pending", None, None, 1),
    ("ISS-0004", 7, "Neha Tiwari", "Admin", 9, 3, 3, "ADMIN-01", "issued", 2, 3, 4),
    ("ISS-0005", 6, "Suresh Yadav", "Civil", 6, 30, None, "WO-2501", "rejected", None, None, 2),
    ("ISS-0006", 3, "Deepak Verma", "Electrical", 3, 50, 50, "WO-2501", "issued", 1, 4, 5),
    ("ISS-0007", 4, "Priya Singh", "Project", 8, 3, None, "WO-2504", "pending", None, None, 0),
]


def seed_views(spark):
    ago = lambda n: None if n is None else NOW - dt.timedelta(days=n)
    cats = spark.createDataFrame([(i + 1, n, "active") for i, n in enumerate(CATEGORIES)],
                                 "id long, name string, status string")
    users = spark.createDataFrame(
        [(i, name, e.lower(), dept, role, "active") for i, e, name, dept, role in USERS],
        "id long, name string, username string, department string, role string, status string")
    prod = spark.createDataFrame(
        [(i + 1, c, n, cat, u, D(cur), D(res), D(mn), rack, sup, "active")
         for i, (c, n, cat, u, cur, res, mn, rack, sup) in enumerate(PRODUCTS)],
        "id long, product_code string, name string, category_id long, unit string, "
        "current_stock decimal(12,2), reserved_stock decimal(12,2), "
        "min_stock_level decimal(12,2), rack_location string, supplier_name string, status string")
    moves = spark.createDataFrame(
        [(p, NOW, "stock_in", D(q)) for p, q in OPENING],
        "product_id long, created_at timestamp_ntz, type string, quantity decimal(12,2)")
    indents = spark.createDataFrame(
        [(i + 1, e, st, "normal", ago(d)) for i, (_, e, st, d) in enumerate(INDENTS)],
        "id long, employee_id long, status string, priority string, created_at timestamp_ntz")
    issues = spark.createDataFrame(
        [(num, e, n, dept, p, D(rq), None if iq is None else D(iq), wo, st, by, ago(ia), ago(ca))
         for num, e, n, dept, p, rq, iq, wo, st, by, ia, ca in ISSUES],
        "id string, employee_id long, employee_name string, department string, "
        "product_id long, quantity_requested decimal(12,2), quantity_issued decimal(12,2), "
        "work_order_ref string, status string, issued_by long, issued_at timestamp_ntz, "
        "created_at timestamp_ntz")
    return SimpleNamespace(spark=spark, categories=cats, users=users, products=prod,
                           product_base=prod.drop("current_stock"), accepted_movements=moves,
                           accepted_between=lambda a, b: moves.where(date_range("created_at", a, b)),
                           indents=indents, issue_requests=issues)
