"""The corpus pipeline: five stages, each one operator over all its predecessor kept.

Quality classifier, SimHash near-duplicates, repeated passages, benchmark
decontamination, BPE encoding.  Each stage takes ``(spark, docs, sf_dir)``;
its result is written as Parquet in the shared checkpoint folder and read
again as the next stage's ``docs``.  All but the last return the columns of
``documents`` (others are dropped, whatever their names); ``n_chars`` follows
the text.  Every stage takes nulls in any column, empty and very long texts,
and an empty table, which stays empty.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockspark.llm import bpe_index, bwt_dedup, decontamination, rule_ensemble, simhash_vp  # noqa: E402
from stockspark.llm.common import drop_staged, prepare, staged_path, staged_so_far  # noqa: E402
from stockspark.llm.queries import read, tokenizer_path  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    Every row is scored by its own statistics, so rows that repeat a doc_id
    are judged one by one.  A null text counts as empty; where no label is
    known all rows get the same score.
    """
    return rule_ensemble.keep_good(docs, read(spark, sf_dir, "labels"), COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each SimHash component (one row where several share it).

    Texts without words, nulls included, are one component; a row without a
    doc_id stays only where no row of its component has one.
    """
    return simhash_vp.keep_first(docs, COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that start earlier in the corpus.

    Of repeated rows the first in its block keeps the passage.  A null text
    stays null, a text under 100 bytes as it is; a null doc_id comes first.
    """
    cut = bwt_dedup.remove_repeats(docs, with_text=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than a twentieth of the words.

    Rows are judged one by one, repeated ones alike.  A text without words
    stays, and all do where the benchmark is empty; items without an id count.
    """
    hits = decontamination.find_hits(docs, read(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return decontamination.verdict(hits).where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row; a null text counts as empty."""
    return bpe_index.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: The classifier, the byte-level passages and the merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; the rows of the last.

    Once a stage's rows are written, what it staged on the way and the rows of
    the stage before are dropped.
    """
    prepare(spark)
    docs, before = read(spark, sf_dir, "documents"), staged_so_far()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = staged_path(out, f"stage-{name}")
        drop_staged(spark, before, keep=(path,))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
