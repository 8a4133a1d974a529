"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows adds its log frequency in each language.  An
unseen word is looked up as its character n-grams (with word boundaries) of
the greatest length, then of one less and so on down to single characters;
the first length with a known n-gram gives the mean of their log frequencies.

Fitting: from each language about ``max_docs`` training documents, those whose
id hash lies below the share of its documents that makes so many (a bounded,
documented sample of labelled rows; all where there are fewer); every word and
n-gram of their whole texts is counted by Spark.  Each language adds its
``max_words`` most frequent words and, of every length, its ``max_grams`` most
frequent n-grams, so a language with few rows keeps its own; that bounds what
is broadcast by the number of languages.  Prediction covers every whole text.

Words begin with a letter and go on with letters and combining marks, so the
vowel signs of Indic scripts stay in their words; superscripts, fractions and
enclosed numbers are no letters.  A null text or one without a letter is
``und`` with score 0.  Null langs are not learned; without any labelled row
(an empty table, too) all is ``und``.  Ties go to the first language in name
order.  Repeated rows count as they occur, a very long text like any other.
Only doc_id, lang and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import fold_col, map_rows, pa_schema, prepare, staged



def _ranges_of(wanted: Callable[[str], bool]) -> str:
    """The characters that ``wanted`` picks, as ranges of a regular expression's class."""
    points = [c for c in range(0x110000) if wanted(chr(c))]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(points)]))


#: Numbers that are word characters without being digits, and marks, which are none.
_LETTER = "[^\\W\\d_" + _ranges_of(lambda c: c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]"
_WORDS = re.compile(f"{_LETTER}(?:{_LETTER}|[{_ranges_of(lambda c: unicodedata.category(c)[0] == 'M')}])*").findall
LONGEST = 4
SMOOTH = 0.5
#: Languages up to which the sample's bounds are broadcast.
MAX_SMALL = 10_000
#: Words whose scores a worker keeps.
KEPT_WORDS = 400_000


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i:i + n] for i in range(len(framed) - n + 1)]


def sample(training: DataFrame, max_docs: int) -> DataFrame:
    """About ``max_docs`` rows of each language, all of those with fewer (rows of equal id stay together)."""
    share = (training.groupBy("lang").agg(F.count("*").alias("n"))
             .select("lang", F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n")).alias("share")))
    share = staged(share, "lang-sample")
    if share.count() <= MAX_SMALL:            # one row a language; beyond that a shuffled join
        share = F.broadcast(share)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))          # from 0 to 1
    return training.join(share, "lang").where((F.col("share") >= 1) | (place < F.col("share"))).select("lang", "text")


def count_entries(rows: DataFrame) -> DataFrame:
    """(kind, entry, lang, n): kind 0 words, else n-grams of that length; counted in each task first."""
    schema = "kind int, entry string, lang string, n bigint"
    out = pa_schema(rows.sparkSession, schema)

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    counts[0, w, lang] += n
                    for k in range(1, LONGEST + 1):
                        for g in grams_of(w, k):
                            counts[k, g, lang] += n
            if counts:
                kind, entry, lang = zip(*counts)
                yield pa.RecordBatch.from_pydict(
                    {"kind": kind, "entry": entry, "lang": lang, "n": list(counts.values())}, schema=out)
    return (rows.select("lang", "text").mapInArrow(run, schema)
            .groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")))


def fit(training: DataFrame, max_docs: int = 1500, max_words: int = 25_000, max_grams: int = 10_000) -> dict:
    """The model from rows (doc_id, lang, text): languages, and per kind {entry: log frequencies}."""
    prepare(training.sparkSession)
    counts = staged(count_entries(sample(training.where("lang IS NOT NULL AND text IS NOT NULL"), max_docs)), "lang-counts")
    totals = {(r["kind"], r["lang"]): (r["n"], r["v"]) for r in
              counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted({lang for _, lang in totals})
    model: dict = {"langs": langs, "tables": {}}
    order = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "entry")
    most = F.when(F.col("kind") == 0, max_words).otherwise(max_grams)
    own = (counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(max_words, max_grams))
           .where(F.col("r") <= most).select("kind", "entry").distinct())
    each = F.map_from_entries(F.collect_list(F.struct("lang", "n")))      # one entry a language
    for r in counts.join(own, ["kind", "entry"]).groupBy("kind", "entry").agg(each.alias("by")).toLocalIterator():
        model["tables"].setdefault(r["kind"], {})[r["entry"]] = [
            math.log((r["by"].get(lang, 0) + SMOOTH) / (t + SMOOTH * (v + 1)))
            for lang, (t, v) in zip(langs, (totals.get((r["kind"], lang), (0, 0)) for lang in langs))]
    return model


class Scorer:
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.tables = {k: {e: np.array(v) for e, v in t.items()} for k, t in model["tables"].items()}
        self.known = self.tables.get(0, {})
        self.start()

    def start(self) -> None:
        self.rows, self.place = [], {}
        self.matrix = np.empty((0, len(self.langs)))

    def word(self, w: str) -> np.ndarray:
        """Log frequencies of a word by the first table that knows it or its n-grams."""
        got = self.known.get(w)
        if got is not None:
            return got
        for k in range(LONGEST, 0, -1):
            table = self.tables.get(k, {})
            hits = [table[g] for g in grams_of(w, k) if g in table]
            if hits:
                return sum(hits) / len(hits)
        return np.zeros(len(self.langs))

    def predict(self, texts: list) -> tuple[list, list]:
        if len(self.place) > KEPT_WORDS:
            self.start()
        place, found, names, scores = self.place, [], [], []
        cut = [words_of(t) for t in texts]
        new = {w for ws in cut for w in ws if w not in place}
        if new and self.langs:
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.matrix = np.concatenate((self.matrix, np.array([self.word(w) for w in new])))
        for ws in cut:
            if not ws or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.matrix[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return names, scores


_SCORERS: dict = {}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, lang_pred, score of every row."""
    import uuid
    spark = docs.sparkSession
    prepare(spark)
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(cols: dict) -> dict:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        names, scores = _SCORERS[key].predict(cols["text"])
        return {id_col: cols[id_col], "lang_pred": names, "score": scores}
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, "text"), f"`{id_col}` {kind}, lang_pred string, score double", run)


def identify(docs: DataFrame, held_mod: int = 4, held_is: int = 2, **sizes) -> DataFrame:
    """Fit on all folds but ``held_is`` and predict every row: doc_id, held_out, lang_pred, score."""
    held = fold_col("doc_id", held_mod) == held_is
    model = fit(docs.where(~held).select("doc_id", "lang", "text"), **sizes)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
