"""Request workflows as batches of decisions applied to tables.

Batch semantics: a batch of decisions is validated (W-03) and taken in
(decided_at, decision_id) order; per request the first valid decision that
takes effect wins (W-05).  Approvals of one product consume its available
stock in that order; an approval larger than what is left is refused and
leaves the request open for its next decision (W-04, the same refusing fold
as the ledger, started at current - reserved); a valid rejection sets an open
request rejected (W-06).  Indent decisions have no stock check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions import exprs as X
from stockspark.operators import ledger as L
from stockspark.operators.common import materialize
from stockspark.operators.retry_fold import fold_candidates
from stockspark.session import collect_garbage

D12 = "decimal(12,2)"
DEC_ORDER = ("decided_at", "decision_id")


# ------------------------------------------------------------------ W-03
def validate_decisions(decisions: DataFrame) -> DataFrame:
    """Rule columns -> ``valid`` + ``reasons`` (text, ';'-joined).

    Reject: reason mandatory (blank = missing); decision must be approve or
    reject.  An approval's quantity needs no rule: one that isn't positive
    falls back to the requested quantity."""
    d = F.col("decision")
    reason_missing = F.col("reason").isNull() | (F.trim(F.col("reason")) == "")
    rules = F.array(
        F.when(~d.isin("approve", "reject"), F.lit("unknown decision")),
        F.when((d == "reject") & reason_missing, F.lit("rejection reason is mandatory")))
    reasons = F.array_compact(rules)
    return (decisions.withColumn("reasons", F.array_join(reasons, ";"))
            .withColumn("valid", F.size(reasons) == 0))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Intake rule: a product and a positive quantity."""
    rules = F.array(
        F.when(F.col("product_id").isNull(), F.lit("product required")),
        F.when(F.col("quantity_requested").isNull() | (F.col("quantity_requested") <= 0),
               F.lit("quantity must be positive")))
    reasons = F.array_compact(rules)
    return (requests.withColumn("reasons", F.array_join(reasons, ";"))
            .withColumn("valid", F.size(reasons) == 0))


# ------------------------------------------------------------------ W-05
def first_decision(decisions: DataFrame, key: str = "request_id") -> DataFrame:
    """First decision per request by (decided_at, decision_id).

    ``min_by`` is an aggregate with map-side partial aggregation, so a
    request with very many decisions is reduced before the shuffle."""
    cols = [c for c in decisions.columns if c != key]
    firsts = decisions.groupBy(key).agg(
        F.min_by(F.struct(*cols), F.struct(*DEC_ORDER)).alias("_d"))
    return firsts.select(key, *[F.col(f"_d.{c}").alias(c) for c in cols])


# ------------------------------------------------------------------ W-04 / W-06
def _reject_time(valid: DataFrame) -> DataFrame:
    """First valid rejection per request: it always takes effect if the
    request is still open, so no later decision of that request counts."""
    return (valid.filter(F.col("decision") == "reject").groupBy("request_id")
            .agg(F.min_by(F.struct("decided_by", "reason"), F.struct(*DEC_ORDER)).alias("_r"),
                 F.min(F.struct(*DEC_ORDER)).alias("_at")))


def approval_candidates(valid: DataFrame, pending: DataFrame, rejects: DataFrame) -> DataFrame:
    """Approvals that could take effect, numbered ``k`` = 1.. per request, ``more``: not the last.

    Decisions only consume stock, so an approval that isn't smaller than an
    earlier one of its request can never succeed where that one failed:
    candidates are the strict running minima of the quantity before the first
    rejection.  The earliest approval per (request, quantity) is kept first
    (partial aggregation), so repeated decisions on one request are reduced
    before the shuffle.
    """
    return _candidates(valid.join(pending, "request_id"), rejects)


def _candidates(asked: DataFrame, rejects: DataFrame) -> DataFrame:
    appr = (asked.filter(F.col("decision") == "approve")
            .withColumn("qty", F.when(F.col("qty_issued") > 0, F.col("qty_issued"))
                        .otherwise(F.col("quantity_requested")).cast(D12)))
    early = appr.groupBy("request_id", "product_id", "quantity_requested", "qty").agg(
        F.min(F.struct(*DEC_ORDER)).alias("_at"), F.min_by("decided_by", F.struct(*DEC_ORDER)).alias("decided_by"))
    before = early.join(rejects.select("request_id", F.col("_at").alias("_rej")), "request_id", "left") \
                  .filter(F.col("_rej").isNull() | (F.col("_at") < F.col("_rej"))).drop("_rej")
    w = Window.partitionBy("request_id").orderBy("_at")
    least = F.min("qty").over(w.rowsBetween(Window.unboundedPreceding, -1))
    minima = before.withColumn("_least", least).filter(
        F.col("_least").isNull() | (F.col("qty") < F.col("_least"))).drop("_least")
    return minima.select("*", F.row_number().over(w).alias("k"), F.lead("_at").over(w).isNotNull().alias("more"),
                         *[F.col(f"_at.{c}").alias(c) for c in DEC_ORDER]).drop("_at")


def _by_request(asked: DataFrame) -> DataFrame:
    """What can count of the decisions on pending requests: each request's first rejection (``rejection``) and its
    approval candidates (see ``approval_candidates``), by windows over the requests as the join has dealt them out."""
    request = Window.partitionBy("request_id")
    kind, at, qty = F.col("rejection"), F.col("_at"), F.col("qty")
    issued = F.when(F.col("qty_issued") > 0, F.col("qty_issued")).otherwise(F.col("quantity_requested")).cast(D12)
    rows = (asked.filter(F.col("decision").isin("approve", "reject"))
            .withColumn("rejection", F.col("decision") == "reject").withColumn("_at", F.struct(*DEC_ORDER))
            .withColumn("qty", F.when(~kind, issued)).drop("decision", "qty_issued")
            .withColumn("_first", F.min(F.when(kind, at)).over(request)))
    rows = rows.filter(F.when(kind, at == F.col("_first")).otherwise(F.col("_first").isNull() | (at < F.col("_first"))))
    w = Window.partitionBy("request_id", "rejection").orderBy("_at", "qty")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    least, unknown = F.min("qty").over(earlier), F.count_if(qty.isNull()).over(earlier)
    rows = (rows.withColumn("_least", least).withColumn("_unknown", F.coalesce(unknown, F.lit(0)))
            .filter(kind | (qty < F.col("_least")) | (F.col("_least").isNull() & (qty.isNotNull() | (F.col("_unknown") == 0)))))
    return (rows.withColumn("k", F.row_number().over(w)).withColumn("more", F.lead("_at").over(w).isNotNull())
            .filter(~kind | (F.col("k") == 1)).drop("_first", "_least", "_unknown", "_at"))


def apply_issue_decisions(requests: DataFrame, products: DataFrame,
                          decisions: DataFrame) -> DataFrame:
    """Apply one batch; returns the state of every pending request that had a
    valid decision: status, quantity_issued, issued_by, issued_at,
    rejection_reason and the product's available stock after it.

    An approval refused for stock leaves its request open, and the request's
    next decision counts.  All candidates go through one fold by product that
    carries the blocked requests along with the balance (``retry_fold``).
    ``available_after`` of a request left pending is the stock at its first
    refusal.
    """
    pending = requests.filter(F.col("status") == "pending").select(
        F.col("id").alias("request_id"), "product_id", "quantity_requested")
    valid = validate_decisions(decisions).filter("valid").drop("valid", "reasons")
    # what counts of the decisions on pending requests is written once: rejections and approvals are both taken from it
    asked = materialize(_by_request(valid.join(pending, "request_id")), "asked")
    collect_garbage(asked.sparkSession)
    rejects = asked.filter("rejection").select("request_id", F.struct("decided_by", "reason").alias("_r"),
                                               F.col("decided_at").alias("_rejected_at"))
    opening = products.select(F.col("id").alias("product_id"), X.available().alias("balance"))
    tried = fold_candidates(asked.filter("not rejection").drop("rejection", "reason"), opening, DEC_ORDER)
    hit = F.col("accepted")
    out = tried.groupBy("request_id").agg(
        F.max(F.when(hit, F.struct("qty", "quantity_requested", "decided_by", "decided_at", "balance_after"))).alias("_a"),
        F.min_by("balance_after", "k").alias("_left"))
    both = out.join(rejects, "request_id", "full_outer")
    ok, rej = F.col("_a").isNotNull(), F.col("_r").isNotNull()
    return both.select(
        "request_id",
        F.when(ok & (F.col("_a.qty") < F.col("_a.quantity_requested")), "partially_issued")
         .when(ok, "issued").when(rej, "rejected").otherwise("pending").alias("status"),
        F.col("_a.qty").alias("quantity_issued"),
        F.when(ok, F.col("_a.decided_by")).otherwise(F.col("_r.decided_by")).alias("issued_by"),
        F.when(ok, F.col("_a.decided_at")).otherwise(F.col("_rejected_at")).alias("issued_at"),
        F.when(~ok, F.trim("_r.reason")).alias("rejection_reason"),
        F.when(ok, F.col("_a.balance_after")).when(~rej, F.col("_left")).alias("available_after"))


def issue_movements(updates: DataFrame, requests: DataFrame) -> DataFrame:
    """Stock-out movement for each accepted approval (ledger input)."""
    r = requests.select(F.col("id").alias("request_id"), "product_id")
    return (updates.filter(F.col("status").isin("issued", "partially_issued"))
            .join(r, "request_id")
            .select("product_id", F.col("issued_at").alias("created_at"),
                    F.lit("stock_out").alias("type"), F.col("quantity_issued").alias("quantity"),
                    F.col("request_id").alias("reference_number"),
                    F.lit("issue").alias("reference_type")))


# ------------------------------------------------------------------ W-07
def apply_indent_decisions(indents: DataFrame, decisions: DataFrame) -> DataFrame:
    pending = indents.filter(F.col("status") == "pending").select(F.col("id").alias("request_id"))
    valid = validate_decisions(decisions).filter("valid").drop("valid", "reasons")
    first = first_decision(valid).join(pending, "request_id")
    ok = F.col("decision") == "approve"
    return first.select(
        "request_id",
        F.when(ok, "approved").otherwise("rejected").alias("status"),
        F.when(ok, F.col("decided_by")).alias("approved_by"),
        F.when(ok, F.col("decided_at")).alias("approved_at"),
        F.when(~ok, F.trim("reason")).alias("rejection_reason"))


# ------------------------------------------------------------------ W-04b
def allocate_requests(requests: DataFrame, products: DataFrame) -> DataFrame:
    """First-come allocation of available stock to pending requests.

    Closed form per request: greatest(0, least(requested, available -
    requested-before)), where requested-before is the running sum of the
    product's earlier requests, taken from the chunked prefix sums of the
    ledger module (no window spans a whole product)."""
    pend = requests.filter(F.col("status") == "pending").select(
        "id", "product_id", "created_at", "quantity_requested")
    run = L.running_balance(pend, order_cols=("created_at", "id"), qty_col="quantity_requested")
    avail = products.select(F.col("id").alias("product_id"), X.available().alias("available"))
    j = run.join(avail, "product_id", "left")
    before = (F.col("balance_after") - F.col("quantity_requested"))
    alloc = F.greatest(F.lit(0).cast(D12),
                       F.least(F.col("quantity_requested"),
                               F.coalesce("available", F.lit(0).cast(D12)) - before)).cast(D12)
    return j.select("id", "product_id", "created_at", "quantity_requested",
                    alloc.alias("allocated")).withColumn(
        "allocation", F.when(F.col("allocated") == F.col("quantity_requested"), "full")
        .when(F.col("allocated") > 0, "partial").otherwise("none"))
