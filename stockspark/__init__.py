"""stockspark: inventory-ledger analytics on Spark.

Subpackages
-----------
sources    driver tables -> domain views, sinks (CSV export, ledger append)
functions  native Column helpers (classes, labels, formats, filters)
operators  ledger fold, reports, workflow, alerts, paging, data quality
plans      parameter objects and the query / export registries
streaming  Structured Streaming versions of the ledger, alerts, audit, counts
"""

from stockspark.params import Params
from stockspark.session import ensure_checkpoint_dir, get_session

__all__ = ["Params", "get_session", "ensure_checkpoint_dir"]
