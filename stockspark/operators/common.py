"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back,
    so several readers see the same rows whatever the planner reuses."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of a one-row aggregate to each row.

    The aggregate is one struct-valued scalar subquery (no join, no
    cartesian product); its fields share that subquery's single run."""
    out = rows.withColumn("_scalars", one_row.select(F.struct(*one_row.columns).alias("s")).scalar())
    return out.select(*rows.columns, *[F.col(f"_scalars.{c}").alias(c) for c in one_row.columns])
