"""Query catalog: key -> (Spark query, oracle SQL).

``QUERIES[key](spark, sf_dir)`` returns the Spark DataFrame; ``ORACLE[key]``
is independent DuckDB SQL over the same parquet tables (views as CTEs).
Results are compared after ``for_compare``: decimals as double and dates
as ``yyyy-MM-dd`` text on both sides, so the value hash does not depend on
how each engine hands decimals and dates to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.params import DEFAULT, Params
from stockspark.plans.oracle_views import with_views  # noqa: F401  (re-exported to q_* modules)
from stockspark.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOCS: dict[str, str] = {}


def for_compare(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(key: str, sql: str | None = None, views_kw: dict | None = None,
             params: Params = DEFAULT):
    """Decorator: ``fn(views, params) -> DataFrame`` becomes a catalog query."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            v = Views(spark, sf_dir, **(views_kw or {}))
            return for_compare(fn(v, params))
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        DOCS[key] = (fn.__doc__ or "").strip().split("\n")[0]
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL helpers
P = DEFAULT
D_FROM, D_TO = f"date '{P.date_from}'", f"date '{P.date_to}'"
A_FROM, A_TO = f"date '{P.audit_from}'", f"date '{P.audit_to}'"
AS_OF = f"date '{P.as_of}'"


def in_range(col: str, a: str = D_FROM, b: str = D_TO) -> str:
    return f"cast({col} as date) between {a} and {b}"


def dbl(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as double) {name or expr.split('.')[-1]}"


def sql_case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"coalesce(case {col} {whens} end, {default})"


def sql_ucfirst(col: str) -> str:
    return f"(upper(substr({col}, 1, 1)) || substr({col}, 2))"


LOW = "p.current_stock <= p.min_stock_level"
CRIT = "p.current_stock <= p.min_stock_level * 0.3"
