"""Helpers shared by the corpus operators: staging, Arrow passes, folds, blocks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.session import ensure_checkpoint_dir, ship_package

#: ASCII white space; every other code point belongs to a word (fixed by the contracts).
WHITE = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound Arrow batches.

    A batch holds at most 1,000 rows and about 16 MB, so a run of very long
    texts cannot fill a worker.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    Cuts the lineage: later stages re-read files every executor can reach,
    so a lost executor never repeats what lies before.
    """
    path = staged_path(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(df: DataFrame, name: str) -> str:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    _MADE.append((None, path))
    df.write.option("compression", "zstd").parquet(path)
    return path


#: (table or None, folder) of all that was staged and not dropped yet, in order.
_MADE: list = []


def staged_so_far() -> int:
    return len(_MADE)


def drop_staged(spark: SparkSession, since: int = 0, keep: tuple = ()) -> None:
    """Drop the tables and folders staged after the first ``since``, but for the folders to ``keep``.

    For callers whose results are written: a result that still reads staged
    rows is lost with them.
    """
    for table, path in _MADE[since:]:
        if path not in keep:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _MADE[since:] = [x for x in _MADE[since:] if x[1] in keep]


def bucketed(df: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """``df`` written as a table bucketed by ``key`` in the shared folder, and read back.

    Large rows are written once in the layout that later joins and co-groups
    by ``key`` need: only their other side is shuffled.
    """
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    n = n or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{ensure_checkpoint_dir(spark)}/{table}"
    _MADE.append((table, path))
    (df.write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", path).saveAsTable(table))
    return spark.table(table)


def fold_of(doc_id, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id (in no named fold)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def fold_col(col: str, mod: int):
    """The same as a column."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % mod, F.lit(-1))


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict], dict]) -> DataFrame:
    """Arrow pass: ``fn`` gets a batch as lists by column and returns lists by column."""
    names = df.columns
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn({c: b.column(i).to_pylist() for i, c in enumerate(names)})
            yield pa.RecordBatch.from_pydict(got, schema=out)
    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


#: Text bytes of one bucket of ``sized_buckets``.
BUCKET_BYTES = 32 << 20


def sized_buckets(df: DataFrame, key: str, name: str, source: DataFrame, column: str) -> DataFrame:
    """``bucketed`` with as many buckets as the bytes of ``source``'s ``column`` need.

    A bucketed scan is not split, so the number follows the data: a task's
    share stays the same at every size.
    """
    spark = df.sparkSession
    total = source.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    n = max(2 * spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    return bucketed(df, key, name, n)
