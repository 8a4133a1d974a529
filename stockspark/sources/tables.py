"""Driver tables: parquet scans with explicit column lists.

Every operator reads through :class:`Tables` so that Catalyst sees a plain
parquet relation and can prune columns and push filters into the scan.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """Lazy access to ``{sf_dir}/{name}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def digest(self, name: str) -> str:
        """A digest of the table's files: their paths, sizes and times of change."""
        files = self.read(name).select("_metadata.file_path", "_metadata.file_size",
                                       "_metadata.file_modification_time").distinct().collect()    # one row a file
        return hashlib.sha1(repr(sorted(map(tuple, files))).encode()).hexdigest()[:16]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
