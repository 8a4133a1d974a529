"""Driver tables -> domain views of the inventory application.

The mapping (which driver column plays which domain column) is fixed in
FIXTURES.md section B; the oracle SQL uses the same mapping as CTEs.  The
views here are plain DataFrame plans: they add no shuffle of their own
except the joins the mapping needs, and Catalyst prunes every column a
report does not ask for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.functions import exprs as X
from stockspark.functions.filters import date_range
from stockspark.sources.tables import Tables

D12 = "decimal(12,2)"
TXN_ORDER = ["created_at", "product_id", "ord_key", "ord_line"]


def _earlier(col: str, day) -> Column:
    """What comes before the day in time order; nulls come first."""
    return F.col(col).isNull() | (F.to_date(col) < F.lit(day))


class Views:
    """Domain views over one test-data directory.

    ``stock`` selects how ``products.current_stock`` is derived:
    ``"ledger"`` (default) is the last accepted balance of the conditional
    ledger fold (K-02/K-03), ``"net"`` the plain sum of signed movements.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stock: str = "ledger"):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)
        self.stock = stock

    @cached_property
    def parts(self) -> int:
        """Tasks that sort what has a row a line item: as many as the session's, more where those would be too large."""
        from stockspark.operators.ledger import ROWS_PER_CHUNK
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")),
                   -(-self.t.lineitem.count() // ROWS_PER_CHUNK))

    # ---------------------------------------------------------------- dims
    @cached_property
    def categories(self) -> DataFrame:
        """Distinct part types plus one category no product uses.

        The numbering window has no partition key; it runs after the
        distinct, i.e. over the (small, bounded) set of type names.
        """
        names = (self.t.part.select(F.col("p_type").alias("name")).distinct()
                 .unionByName(self.spark.range(1).select(F.lit("UNUSED").alias("name"))))
        return names.select(
            F.row_number().over(Window.orderBy("name")).cast("bigint").alias("id"),
            "name",
            F.lit("active").alias("status"))

    @cached_property
    def users(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.col("c_name").alias("name"),
            F.lower("c_name").alias("username"),
            F.when(k % 50 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("c_mktsegment")).alias("department"),
            F.when(k % 20 == 0, "admin").when(k % 20 == 1, "keeper")
             .when(k % 20 == 2, "management").otherwise("employee").alias("role"),
            F.when(k % 25 == 3, "inactive").otherwise("active").alias("status"))

    # ---------------------------------------------------------------- ledger input
    @cached_property
    def movements(self) -> DataFrame:
        """Ledger input: one movement per line item, typed by flag/status."""
        li = self.t.lineitem
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        mtype = (F.when(rf == "R", "return")
                 .when((rf == "N") & (ls == "O"), "stock_in")
                 .when(rf == "N", "stock_out")
                 .when(ls == "O", "adjustment_in")
                 .otherwise("adjustment_out"))
        qty = F.col("l_quantity").cast(D12)
        return li.select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_orderkey").alias("ord_key"),
            F.col("l_linenumber").alias("ord_line"),
            mtype.alias("type"),
            qty.alias("quantity"),
            X.signed_quantity(mtype, qty).alias("signed_qty"),
            F.col("l_suppkey").alias("supplier_id"),
            (F.col("l_orderkey") % 30).alias("created_by"))

    def net_stock(self) -> DataFrame:
        """Sum of signed movements per product (map-side partial sums)."""
        return (self.movements.groupBy("product_id")
                .agg(F.sum("signed_qty").cast(D12).alias("current_stock")))

    @cached_property
    def store(self):
        """The stored ledger of these movements (S-11): loaded by the first query that needs it, read by the rest.

        It lies in the shared checkpoint folder under a digest of the source
        files' names, sizes and times, so changed files are a new ledger.
        """
        from stockspark.operators.ledger_store import LedgerStore
        from stockspark.session import ensure_checkpoint_dir
        root = ensure_checkpoint_dir(self.spark)
        store = LedgerStore(self.spark, f"{root}/ledger-store/{self.t.digest('lineitem')}")
        store.append(self.movements, "load")
        return store

    @cached_property
    def ledger(self) -> DataFrame:
        """Every movement with its balances under the refusing rule (K-02), as stored."""
        return self.store.rows()

    @cached_property
    def stock_levels(self) -> DataFrame:
        """Last balance per product: the stored chunk ends (K-03), or the net sums."""
        return self.store.snapshot() if self.stock == "ledger" else self.net_stock()

    @cached_property
    def accepted_movements(self) -> DataFrame:
        """Rows of the stock_transactions table without their numbers (enough
        for sums and counts; avoids the numbering shuffle)."""
        return self.ledger.filter(F.col("accepted"))

    def accepted_between(self, date_from, date_to) -> DataFrame:
        """The accepted movements of a closed date range; of the stored ledger, its months only."""
        rows = self.store.rows(str(date_from), str(date_to))
        return rows.filter(F.col("accepted") & date_range("created_at", date_from, date_to))

    @cached_property
    def stock_transactions(self) -> DataFrame:
        """Accepted movements (refused ones never reach the table), numbered
        TXN-0001... in time order (W-01), with their references."""
        from stockspark.operators.numbering import number_rows
        return self._with_references(number_rows(self.accepted_movements, TXN_ORDER, "TXN", out="txn_number",
                                                 n_parts=self.parts))

    def transactions_between(self, date_from, date_to) -> DataFrame:
        """``stock_transactions`` of a closed date range: numbers are in time order, so those before the range are
        counted and only its own rows are sorted."""
        from stockspark.operators.numbering import number_rows
        before = self.store.rows(date_to=str(date_from)).filter(F.col("accepted") & _earlier("created_at", date_from))
        rows = self.accepted_between(date_from, date_to)
        return self._with_references(number_rows(rows, TXN_ORDER, "TXN", out="txn_number", base=before.count(),
                                                 n_parts=self.parts))

    def _with_references(self, numbered: DataFrame) -> DataFrame:
        key, mtype = F.col("ord_key").cast("string"), F.col("type")
        return (numbered
                .withColumn("reference_number", F.when(mtype == "stock_out", F.concat(F.lit("ISS-"), key)))
                .withColumn("invoice_number", F.when(mtype == "stock_in", F.concat(F.lit("INV-"), key)))
                .withColumn("remarks", F.when(mtype.startswith("adjustment"), F.lit("Stock count"))))

    @cached_property
    def product_base(self) -> DataFrame:
        """Product master data without the stock level (no ledger needed)."""
        p = self.t.part
        k = F.col("p_partkey")
        cats = self.categories.select(F.col("id").alias("category_id"),
                                      F.col("name").alias("_cat_name"))
        base = p.join(cats, p.p_type == cats._cat_name, "left")
        return base.select(
            k.alias("id"),
            X.product_code(k).alias("product_code"),
            F.col("p_name").alias("name"),
            F.col("category_id"),
            F.lit("Nos").alias("unit"),
            (k % 7).cast(D12).alias("reserved_stock"),
            (F.col("p_size") * 10).cast(D12).alias("min_stock_level"),
            F.col("p_brand").alias("rack_location"),
            F.when(k % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("p_brand")).alias("supplier_name"),
            F.col("p_retailprice").cast(D12).alias("unit_price"),
            F.when(k % 20 == 0, "inactive").otherwise("active").alias("status"))

    @cached_property
    def products(self) -> DataFrame:
        """Product master + ``current_stock`` (0 for products never moved)."""
        b = self.product_base
        j = b.join(self.stock_levels, b.id == F.col("product_id"), "left")
        cols = [c for c in b.columns]
        cols.insert(5, "current_stock")
        return j.withColumn("current_stock", F.coalesce(F.col("current_stock"),
                                                        F.lit(0).cast(D12)).cast(D12)
                            ).select(*cols)

    # ---------------------------------------------------------------- requests
    @cached_property
    def issue_requests(self) -> DataFrame:
        return self.requests_of(self.t.lineitem)

    def requests_of(self, lineitem: DataFrame) -> DataFrame:
        """The issue requests of line items, a table or a stream."""
        li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
        o = self.t.orders.select(
            "o_orderkey", "o_custkey", "o_orderdate",
            F.when(F.col("o_orderstatus") == "F", "issued")
             .when(F.col("o_orderstatus") == "P", "partially_issued")
             .when(F.col("o_orderpriority") == "5-LOW", "rejected")
             .otherwise("pending").alias("st"))
        u = self.users.select(F.col("id").alias("_uid"), F.col("name").alias("employee_name"),
                              "department")
        # the requester joins the orders, so the line items are dealt out once
        ou = o.join(u, F.col("o_custkey") == F.col("_uid"))
        j = li.join(ou, li.l_orderkey == ou.o_orderkey)
        st = F.col("st")
        qty = F.col("l_quantity").cast(D12)
        pending = st == "pending"
        return j.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string"),
                        F.col("l_partkey").cast("string"),
                        F.to_date("l_shipdate").cast("string")).alias("id"),
            F.col("o_custkey").alias("employee_id"),
            "employee_name", "department",
            F.col("l_partkey").alias("product_id"),
            qty.alias("quantity_requested"),
            F.when(st == "issued", qty)
             .when(st == "partially_issued", F.floor(F.col("l_quantity") / 2).cast(D12))
             .alias("quantity_issued"),
            F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("WO-"), (F.col("l_orderkey") % 500).cast("string")))
             .alias("work_order_ref"),
            st.alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.when(pending, F.lit(None))
             .otherwise(F.col("o_orderdate")
                        + F.make_dt_interval(1 + F.col("l_linenumber") % 5)).alias("issued_at"),
            F.when(pending, F.lit(None)).otherwise(F.col("o_custkey") % 30).alias("issued_by"))

    @cached_property
    def numbered_requests(self) -> DataFrame:
        """``issue_requests`` with their numbers ISS-0001... in time order (W-01)."""
        return self.requests_numbered()

    def requests_numbered(self, keep: Column | None = None) -> DataFrame:
        """``numbered_requests``, those that ``keep`` holds for; the others are counted."""
        from stockspark.operators.numbering import number_rows
        return number_rows(self.issue_requests, ["created_at", "id"], "ISS", out="issue_number", n_parts=self.parts,
                           keep=keep)

    def requests_between(self, date_from, date_to) -> DataFrame:
        """``numbered_requests`` of a closed date range; the requests before it are only counted."""
        from stockspark.operators.numbering import number_rows
        before = self.issue_requests.filter(_earlier("created_at", date_from)).count()
        rows = self.issue_requests.filter(date_range("created_at", date_from, date_to))
        return number_rows(rows, ["created_at", "id"], "ISS", out="issue_number", base=before, n_parts=self.parts)

    @cached_property
    def indents(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("employee_id"),
            F.when(F.col("o_orderstatus") == "F", "approved")
             .when(F.col("o_orderstatus") == "O", "pending")
             .when(F.col("o_orderpriority") == "5-LOW", "converted")
             .otherwise("rejected").alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
             .when(F.col("o_orderpriority") == "2-HIGH", "urgent")
             .otherwise("normal").alias("priority"),
            F.col("o_orderdate").alias("created_at"))

    @cached_property
    def product_links(self) -> DataFrame:
        """Category and author of each product, as loaded (some name no parent)."""
        return self.product_base.select("id", "category_id", (F.col("id") % 31 - 1).alias("created_by"))

    @cached_property
    def request_transactions(self) -> DataFrame:
        """The stock transaction that each issued request names."""
        li = self.t.lineitem.join(self.t.orders.filter(F.col("o_orderstatus").isin("F", "P")),
                                  F.col("l_orderkey") == F.col("o_orderkey"))
        return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stock_txn_id"))

    @cached_property
    def indent_links(self) -> DataFrame:
        """Approver and category of each indent."""
        return self.indent_submissions.select(
            "id", F.when(F.col("status") == "approved", F.col("employee_id") % 30).alias("approved_by"),
            F.when(F.col("category_id") != 0, F.col("category_id")).alias("category_id"))

    @cached_property
    def indent_submissions(self) -> DataFrame:
        """``indents`` with requester, item, quantity and category, before they get a number."""
        k = F.col("id")
        u = self.users.select(F.col("id").alias("_uid"), F.col("name").alias("employee_name"), "department")
        return (self.indents.join(u, F.col("employee_id") == F.col("_uid"), "left").drop("_uid")
                .withColumn("item_name", F.when(k % 40 == 0, F.lit(" "))
                            .otherwise(F.concat(F.lit("Item "), (k % 100).cast("string"))))
                .withColumn("quantity", (k % 25).cast(D12)).withColumn("unit", F.lit("Nos"))
                .withColumn("category_id", k % 10))

    @cached_property
    def numbered_indents(self) -> DataFrame:
        """``indent_submissions`` with their numbers IND-0001... in time order (W-01)."""
        from stockspark.operators.numbering import number_rows
        return number_rows(self.indent_submissions, ["created_at", "id"], "IND", out="indent_number")

    # ---------------------------------------------------------------- events
    @cached_property
    def audit_log(self) -> DataFrame:
        e = self.t.events
        u = self.users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"),
                              F.col("role").alias("user_role"))
        et = F.col("event_type")
        return (e.join(u, e.user_id == u._uid, "left").select(
            F.col("event_id").alias("id"),
            "user_id", "user_name", "user_role",
            F.when(et == "click", "REQUEST").when(et == "view", "EXPORT")
             .when(et == "purchase", "APPROVE").when(et == "signup", "LOGIN")
             .otherwise("FAILED_LOGIN").alias("action"),
            F.when(et == "click", "Issue Request").when(et == "view", "Reports")
             .when(et == "purchase", "Indent").otherwise("System").alias("module"),
            F.col("props").alias("details"),
            F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip_address"),
            F.col("ts").alias("created_at")))
