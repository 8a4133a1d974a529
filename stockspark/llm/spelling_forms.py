"""Spelling variants by permuterm rotations.

A word is marked with a terminator and all its rotations are sorted.  With
the edited character at its end, a rotation of ``a x b`` reads ``b $ a x``:
all replacements of ``x`` share the prefix ``b $ a`` and end one character
later, and the word without ``x`` is the rotation ``b $ a`` itself, the head
of that prefix range.  So a range holds at most one head and one word for
each letter, whatever the words' counts, and one scan finds each member's
partners without forming pairs: how many, and the best by count.  Deleting
one letter of a run of equal letters gives the same word at each of its
places; only the first counts.

Everything is DataFrame code: occurrences are summed map-side before the
shuffle, ranges are windows over sorted rotations, and roots come from
pointer doubling (a form's count is at least twice the word's, so the number
of rounds follows from the largest count).

A null text has no words; a null doc_id stands as an empty string in the
checksummed text.  Repeated rows count as often as they occur.  Very long
texts are split like any other.  An empty table gives no rows; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import prepare, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
MARK = "$"                  # no letter, so it is in no word


def count_words(docs: DataFrame, min_len: int = 5, min_n: int = 3, typo_mod: int = 97) -> DataFrame:
    """word, n: runs of letters over all texts, with the contract's deletions (one letter where ``typo_mod``
    divides the checksum of doc_id and run)."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % typo_mod == 0, cut).otherwise(F.col("run"))
    return (runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= min_len)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n))


def rotations(words: DataFrame) -> DataFrame:
    """key, edited, first, n: heads (``edited`` empty) and rotations without their last letter."""
    size = F.char_length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    before, after = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 1, size)
    turned = F.concat(after, F.lit(MARK), before)
    letter = F.substring("word", F.col("i"), F.lit(1))
    kept = F.array(
        F.struct(turned.alias("key"), F.lit("").alias("edited"), F.lit(True).alias("first")),
        F.struct(F.substring(turned, F.lit(1), size).alias("key"), letter.alias("edited"),
                 ((F.col("i") == 1) | (letter != F.substring("word", F.col("i") - 1, F.lit(1)))).alias("first")))
    kept = F.when(F.col("i") == 0, F.slice(kept, 1, 1)).otherwise(kept)
    return places.select("n", F.inline(kept))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word): partial results of every prefix range."""
    head = F.col("edited") == ""
    own = F.concat(F.substring_index("key", MARK, -1), "edited", F.substring_index("key", MARK, 1))
    rows = rotations(words).withColumn("me", F.struct((-F.col("n")).alias("m"), own.alias("word")))
    whole = Window.partitionBy("key")
    ranked = whole.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    changed = F.when(~head, F.col("me"))
    scan = rows.select(
        "me", "first", head.alias("head"),
        F.count(changed).over(ranked).alias("n_changed"),
        F.count(F.when(~head & F.col("first"), 1)).over(ranked).alias("n_longer"),
        F.min(F.when(head, F.col("me"))).over(ranked).alias("shorter"),
        F.first(changed, ignorenulls=True).over(ranked).alias("best1"),
        F.nth_value(changed, 2, ignoreNulls=True).over(ranked).alias("best2"),
        F.min(F.when(~head & F.col("first"), F.col("me"))).over(ranked).alias("longer"))
    shorter = F.when(F.col("first"), F.col("shorter"))
    other = F.when(F.col("best1.word") == F.col("me.word"), F.col("best2")).otherwise(F.col("best1"))
    near = F.when(F.col("head"), F.col("n_longer")).otherwise(
        F.col("n_changed") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(F.col("head"), F.col("longer")).otherwise(F.least(other, shorter))
    return (scan.select(F.col("me.word").alias("word"), near.alias("near"), best.alias("best"))
            .where(F.col("near") > 0).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``form`` followed to its end, for the words that have one."""
    step = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    top = forms.agg(F.max("n").alias("n"), F.min("n").alias("low")).first()
    length = 1 + log2((top["n"] or 1) / (top["low"] or 1))          # links of the longest possible chain
    for k in range(ceil(log2(length + 1))):
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(step.join(onward, "root", "left")
                      .select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    return step


def spelling_forms(docs: DataFrame, min_len: int = 5, min_n: int = 3, typo_mod: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least ``min_len`` letters and ``min_n`` occurrences."""
    prepare(docs.sparkSession)
    words = staged(count_words(docs, min_len, min_n, typo_mod), "words")
    far = -F.col("best.m") >= 2 * F.col("n")
    forms = staged(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n")), "forms")
    return (forms.join(roots(forms), "word", "left")
            .withColumn("root", F.coalesce("root", "word")))
