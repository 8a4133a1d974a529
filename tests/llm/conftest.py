import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])


def rows(texts, first_id=0):
    return [(i, t, "en" if (i or 0) % 2 else "de", f"s{(i or 0) % 3}", len(t or ""))
            for i, t in (x if isinstance(x, tuple) else (k + first_id, x) for k, x in enumerate(texts))]


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of documents from texts or (doc_id, text) pairs."""
    return lambda texts, parts=3: spark.createDataFrame(rows(texts), DOCS).repartition(parts)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and white-space texts, repeated rows, ties, a very long text, unusual characters."""
    rng = random.Random(5)
    words = ["the", "of", "Ünder", "naïve", "***", "a$$$", "b!!", "1,5", "über", "ok.", "中文", "x" * 70]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    texts = [None, "", " \n\t ", base, base, base + " end", text(1), text(3), text(4), "A\nA\nA\n\nB", "\x00a\x1cb c\xa0d",
             "  lead  and   trail  ", text(30_000), "!", "é" * 300, "ab" * 400]
    return make([*enumerate(texts), (None, base), (None, None), (3, base), (3, base)])
