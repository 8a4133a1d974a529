"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees are grown on the statistics of labelled documents; every path
from a root to a node is a rule (a conjunction of thresholds).  A lasso
logistic regression gives most rules no weight; the rest is compiled into one
Spark column expression over the statistics, which scores any number of rows
without Python.

Fitting uses at most ``max_rows`` labelled rows, those of smallest id hash (a
bounded, documented sample); statistics cover whole texts of all rows.

A null or empty text has zero statistics and gets a score like any other.
Repeated labels of an id count once (their highest value).  With labels of
one class only, or none, every score is the smoothed share of class 1.
Repeated rows are scored one by one, a very long text by its statistics like
any other; an empty table gives no rows.  Of the documents only doc_id, text
and the columns to keep are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import fold_col, staged
from stockspark.llm.quality_rules import ledger

_ratio = "CASE WHEN {1} = 0 THEN 0D ELSE CAST({0} AS DOUBLE) / {1} END"
#: Statistics: name and SQL over the measurements of ``quality_rules``.
STATISTICS: tuple[tuple[str, str], ...] = (
    ("log_words", "log1p(CAST(n_words AS DOUBLE))"),
    ("word_length", _ratio.format("word_chars", "n_words")),
    ("symbol_chars", _ratio.format("n_symbols", "word_chars")),
    ("symbol_words", _ratio.format("n_symbol_words", "n_words")),
    ("bang_words", _ratio.format("n_bang_words", "n_words")),
    ("upper", _ratio.format("n_upper", "n_letters")),
    ("letters", _ratio.format("n_letters", "word_chars")),
    ("digits", _ratio.format("n_digits", "word_chars")),
    ("dup_lines", _ratio.format("n_dup_lines", "n_lines")),
    ("repeat_words", _ratio.format("n_repeat_words", "n_words")),
    ("ended_lines", _ratio.format("n_ended_lines", "n_lines")),
    ("words_a_line", _ratio.format("n_words", "n_lines")),
    ("longest_word", "CAST(longest_word AS DOUBLE)"),
)
NAMES = [n for n, _ in STATISTICS]


def statistics(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics of each row's whole text."""
    return ledger(docs, keep).select(*keep, *(F.expr(sql).alias(n) for n, sql in STATISTICS))


def tree_rules(trees) -> list[tuple]:
    """The distinct conjunctions on the paths of fitted trees: ((statistic, '<=' or '>', threshold), ...)."""
    found: dict = {}

    def walk(node, path: tuple) -> None:
        if path:
            found.setdefault(_tight(path))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, cut = NAMES[split.featureIndex()], split.threshold()
        walk(node.leftChild(), (*path, (name, "<=", cut)))
        walk(node.rightChild(), (*path, (name, ">", cut)))
    for tree in trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def _tight(path: tuple) -> tuple:
    """The same conjunction with one threshold for each statistic and direction."""
    best: dict = {}
    for name, way, cut in path:
        old = best.get((name, way))
        best[name, way] = cut if old is None else min(old, cut) if way == "<=" else max(old, cut)
    return tuple(sorted((n, w, c) for (n, w), c in best.items()))


def rule_column(rule: tuple) -> Column:
    out = None
    for name, way, cut in rule:
        c = F.col(name) <= F.lit(cut) if way == "<=" else F.col(name) > F.lit(cut)
        out = c if out is None else out & c
    return out


class RuleEnsemble:
    """Weighted rules; ``score()`` is their logistic sum as a column."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, n_trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on rows with the statistics and ``label`` (0 or 1)."""
    import math

    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    classes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    if not n0 or not n1:
        return RuleEnsemble(math.log((n1 + 1) / (n0 + 1)), [])
    rows = VectorAssembler(inputCols=NAMES, outputCol="stats").transform(labelled)
    boosted = GBTClassifier(featuresCol="stats", labelCol="label", maxIter=n_trees, maxDepth=depth, maxBins=64,
                            subsamplingRate=0.8, featureSubsetStrategy="0.6", minInstancesPerNode=5,
                            seed=seed).fit(rows.select("stats", "label"))
    rules = tree_rules(boosted.trees)
    if not rules:
        return RuleEnsemble(math.log((n1 + 1) / (n0 + 1)), [])
    held = rows.select("label", F.array(*(rule_column(r).cast("double") for r in rules)).alias("held"))
    from pyspark.ml.functions import array_to_vector
    lr = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                            standardization=False, maxIter=60).fit(
        held.select("label", array_to_vector("held").alias("rules")))
    weights = lr.coefficients.toArray()
    return RuleEnsemble(lr.intercept, [(r, w) for r, w in zip(rules, weights) if w != 0])


def labelled_rows(stats: DataFrame, labels: DataFrame, held_mod: int, held_is: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, with their statistics."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .where(fold_col("doc_id", held_mod) != held_is)
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    # ids repeated in the documents share their label
    return (stats.join(known, "doc_id").sort(F.xxhash64("doc_id"), *NAMES).limit(max_rows)
            .select("label", *NAMES))


def score_quality(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_is: int = 0, max_rows: int = 20_000,
                  threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    stats = staged(statistics(docs), "statistics")
    model = fit(staged(labelled_rows(stats, labels, held_mod, held_is, max_rows), "labelled"))
    return stats.select("doc_id", (fold_col("doc_id", held_mod) == held_is).alias("held_out"),
                        model.score().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, columns: tuple, held_mod: int = 5, held_is: int = 0,
              max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The ``columns`` of the rows that the model, fitted as in ``score_quality``, predicts as good."""
    # two passes over the texts, for the fit and for the filter, rather than a shuffle of texts
    stats = staged(statistics(docs), "statistics")
    model = fit(staged(labelled_rows(stats, labels, held_mod, held_is, max_rows), "labelled"))
    held = docs.select(F.struct(*columns).alias("row"), "text")
    return statistics(held, keep=("row",)).where(model.score() >= threshold).select("row.*")
