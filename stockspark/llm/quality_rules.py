"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one ``fail_bits`` long (bit *i* set: rule *i* failed); policies are
versioned sets of rules, applied to the stored bits, and the ablation report
comes from bitwise work on the distinct masks.

Nulls, empty texts: a null or empty text has no word and no line; every count
is 0 and only ``min_words`` fails.  Null ids pass through.  Repeated rows give
repeated ledger rows; a very long text is measured whole, in memory in
proportion to it; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import WHITE, map_rows, prepare

SYMBOLS = b"#*$%&|<>"
#: Endings that close a sentence line.
ENDS = (b".", b"!", b"?", b'"', b":", b";", b")", b"]", "…".encode(), "»".encode(), "”".encode())

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_ended_lines long, n_upper long, n_letters long, n_digits long, "
            "n_bang_words long, n_symbol_words long, longest_word long")


def _repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words lying in a window of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == n:
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def measure_text(text: str | None) -> tuple:
    """All measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()          # bytes.split() cuts at ASCII white space only
    n_dup = n_lines = n_ended = 0
    lines: set = set()
    for line in raw.split(b"\n"):
        bare = line.strip(WHITE)
        if bare:
            n_lines += 1
            n_ended += bare.endswith(ENDS)
            if line in lines:
                n_dup += 1
            else:
                lines.add(line)
    white = sum(raw.count(WHITE[i:i + 1]) for i in range(len(WHITE)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    wide = len(text) - len(raw.translate(None, bytes(range(128, 256))))
    return (len(words), len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), n_dup,
            _repeat_words(words), n_lines, n_ended, upper, upper + lower + wide,
            len(raw) - len(raw.translate(None, b"0123456789")),
            sum(w.endswith(b"!!") for w in words),
            sum(not w.isalnum() and w[-1] in SYMBOLS for w in words),
            max(map(len, words), default=0))


@dataclass(frozen=True)
class Rule:
    """A named condition on the measurements; true means the document fails."""
    name: str
    sql: str


#: Append only: a rule's place is its bit in every stored ledger.
RULES: tuple[Rule, ...] = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_words", "100 * n_symbol_words > 20 * n_words"),
    Rule("symbol_chars", "100 * n_symbols > 10 * word_chars"),
    Rule("shouted_words", "100 * n_bang_words > 20 * n_words"),
    Rule("upper_case", "100 * n_upper > 50 * n_letters"),
    Rule("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("digits", "100 * n_digits > 30 * word_chars"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    Rule("no_sentence_ends", "n_lines >= 3 AND 100 * n_ended_lines < 10 * n_lines"),
)

#: Versioned policies: the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("min_words", "repeated_words"),
    "v1": ("min_words", "repeated_words", "symbol_words", "symbol_chars", "shouted_words"),
    "v2": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def ledger(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the measurements and ``fail_bits``, one row per input row."""
    prepare(docs.sparkSession)
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def run(cols: dict) -> dict:
        rows = [measure_text(t) for t in cols["text"]]
        out = dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
        return {**{c: cols[c] for c in keep}, **out}

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    measured = map_rows(source, f"{fields}, {MEASURES}", run)
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether stored bits pass a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept without it.

    The ledger is first reduced to its distinct masks (map-side counts; at
    most 2^rules rows whatever the corpus), then masks are compared bitwise.
    """
    mask = mask_of(policy)
    masks = (led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
             .agg(F.count("*").alias("n")))
    names = [r.name for r in RULES]
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit"))
                                for n in POLICIES[policy])))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n_if((F.col("bits") == F.col("bit"))).alias("n_failed_only_this"),
        n_if(rest == 0).alias("n_kept_without"),
        F.bit_or(F.col("bits")).alias("bits_seen"))
