"""Batches written whole or not at all.

A table that is appended to batch by batch keeps each batch in a folder of its
own and an empty marker file once all of the batch is there.  Readers take the
marked batches only, so a job that died half-way shows nothing, and a batch
that comes again is found by its id and adds nothing.  Everything goes through
Hadoop's file system API, so any shared store will do.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()


class CommitLog:
    """Committed batches of one or more named tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _markers(self) -> list[tuple[int, str]]:
        """(sequence number, batch) of every commit, in order."""
        fs, folder = _fs(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted((int(seq), unquote(batch)) for seq, _, batch in (n.partition("-") for n in names) if seq.isdigit())

    def batches(self) -> dict[str, int]:
        """Committed batch ids with their sequence numbers, in order; without those that a later one replaced."""
        found = self._markers()
        last = max((seq for seq, batch in found if batch.startswith("compact-")), default=0)
        return {batch: seq for seq, batch in found if seq >= last}

    def known(self, batch: str) -> bool:
        """Whether a batch of this id was ever committed."""
        return any(b == batch for _, b in self._markers())

    def next_seq(self) -> int:
        return max((seq for seq, _ in self._markers()), default=0) + 1

    def folder(self, table: str, batch: str) -> str:
        """Where a batch's rows lie; the prefix keeps ids of digits text when the folder names are read back."""
        return f"{self.path}/{table}/commit=b-{quote(batch, safe='')}"

    def value(self, batch: str) -> str:
        """The batch as the column ``commit`` has it when its rows are read back."""
        return "b-" + unquote(quote(batch, safe=""), encoding="latin-1")

    def put(self, table: str, df: DataFrame, batch: str, partition_by: tuple = ()) -> None:
        """Write a batch's rows; what an earlier attempt left is replaced."""
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.folder(table, batch))

    def commit(self, batch: str) -> int:
        """Make the batch visible; its sequence number."""
        seq = self.next_seq()
        fs, marker = _fs(self.spark, f"{self.path}/commits/{seq:08d}-{quote(batch, safe='')}")
        fs.create(marker, False).close()
        return seq

    def compact(self, table: str, merge, after: int) -> None:
        """Put ``merge`` of all rows in the place of the visible batches once there are more than ``after``.

        For tables whose parts add up.  The new batch hides all before it, so
        readers see either the parts or their sum.
        """
        visible = self.batches()
        if len(visible) > after:
            batch = f"compact-{max(visible.values())}"
            self.put(table, merge(self.get(table).drop("commit")), batch)
            self.commit(batch)

    def get(self, table: str, batches=None) -> DataFrame | None:
        """The rows of the committed batches (or of some of them); None where there are none."""
        batches = list(self.batches()) if batches is None else list(batches)
        folders = [f for f in (self.folder(table, b) for b in batches) if self._exists(f)]
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*folders)

    def _exists(self, path: str) -> bool:
        fs, jpath = _fs(self.spark, path)
        return fs.exists(jpath)
