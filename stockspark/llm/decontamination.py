"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, words of letters, digits and non-ASCII
characters, single spaces); every window of 13 consecutive words of an item
(or the whole of a shorter item) is a pattern ``" w1 ... w13 "``.  Each text
is scanned once; hits are word ranges mapped to byte offsets of the original.

Size of what is broadcast: the patterns' bytes are counted first.  Up to
``max_pattern_bytes`` they form one automaton; a larger benchmark is dealt
into several automata of that size, each built and scanned in turn over all
texts, and the hit ranges are merged in the row.

Null or empty texts have no word: no hit, not contaminated.  Items without a
word have no window; an empty benchmark hits nothing.  Repeated item ids count
once.  Windows of items with a null id hit like any other; only ``items``
leaves the id out.  Repeated document rows each get a row; extra columns pass
through ``keep`` only.  A very long text is one line for the automaton.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import map_rows, prepare

WINDOW = 13
#: Fixed by the contract: everything but digits, letters and non-ASCII bytes separates words.
_TABLE = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def windows_of(text: str | None, width: int = WINDOW) -> list[str]:
    w = [x.decode() for x in words_of(text)]
    if not w:
        return []
    return [" " + " ".join(w[i:i + width]) + " " for i in range(max(1, len(w) - width + 1))]


class Scanner:
    """An automaton over windows; built once per Python worker and kept by key."""
    _kept: dict = {}

    def __init__(self, patterns: list[tuple[str, list]]):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for text, items in patterns:
            self.auto.add_word(text, (text.count(" ") - 1, tuple(items)))
        if patterns:
            self.auto.make_automaton()
        self.any = bool(patterns)

    @classmethod
    def of(cls, key: str, patterns) -> "Scanner":
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(patterns)
        return cls._kept[key]

    def scan(self, text: str | None) -> tuple[int, list, list]:
        """Number of words, merged hit ranges in words, ids of items with a window inside."""
        if not text:
            return 0, [], []
        folded = text.encode("utf-8", "replace").translate(_TABLE)
        words = folded.split()
        if not words or not self.any:
            return len(words), [], []
        line = " " + b" ".join(words).decode() + " "
        found = list(self.auto.iter(line))
        if not found:
            return len(words), [], []
        ends = [i for i, c in enumerate(line) if c == " "]   # ends[k]: the blank before word k
        spans, items = [], set()
        for at, (n, ids) in found:
            last = bisect_left(ends, at)
            spans.append((last - n, last))
            items.update(ids)
        return len(words), merge(spans), sorted(items, key=str)


def merge(spans) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def byte_spans(text: str, spans) -> list:
    """Word ranges as (first byte, end byte) in the UTF-8 of the original text."""
    at = [m.span() for m in _WORD.finditer(text.encode("utf-8", "replace").translate(_TABLE))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def pattern_table(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids (as text) of their items, null ids left out."""
    def run(cols: dict) -> dict:
        pairs = [(w, i) for i, t in zip(cols["item_id"], cols["text"]) for w in windows_of(t, width)]
        return {"pattern": [p for p, _ in pairs], "item": [None if i is None else str(i) for _, i in pairs]}
    rows = map_rows(benchmark.select("item_id", "text"), "pattern string, item string", run)
    return rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _as_pairs(spans) -> list:
    return [{"a": a, "b": b} for a, b in spans]


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, keep: tuple = ("doc_id",),
              max_pattern_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns, n_words, spans (words), byte_spans, items (ids as text), per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    table = pattern_table(benchmark, width)
    total = table.agg(F.sum(F.length("pattern") + F.size("items") * 8).alias("b")).first()["b"] or 0
    n_automata = max(1, -(-total // max_pattern_bytes))
    carry = keep if n_automata == 1 or "text" in keep else (*keep, "text")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    pair = "array<struct<a:bigint,b:bigint>>"
    schema = f"{fields}, n_words bigint, spans {pair}, byte_spans {pair}, items array<string>"
    out = docs.select(*carry, *(["text"] if "text" not in carry else []))
    for k in range(n_automata):
        part = table if n_automata == 1 else table.where(F.pmod(F.xxhash64("pattern"), F.lit(n_automata)) == k)
        patterns = [(r["pattern"], list(r["items"])) for r in part.sort("pattern").toLocalIterator()]
        shared, key = spark.sparkContext.broadcast(patterns), uuid.uuid4().hex

        def run(cols: dict, shared=shared, key=key) -> dict:
            scanner = Scanner.of(key, shared.value)
            before = zip(cols["spans"], cols["items"]) if "spans" in cols else (((), ()) for _ in cols["text"])
            n, words, where, ids = [], [], [], []
            for t, (s0, i0) in zip(cols["text"], before):
                count, spans, items = scanner.scan(t)
                spans = merge([(x["a"], x["b"]) for x in s0] + [tuple(x) for x in spans])
                n.append(count)
                words.append(_as_pairs(spans))
                where.append(_as_pairs(byte_spans(t, spans)) if spans else [])
                ids.append(sorted({*i0, *items}))
            return {**{c: cols[c] for c in carry}, "n_words": n, "spans": words, "byte_spans": where, "items": ids}
        out = map_rows(out, schema, run)
    return out.select(*keep, "n_words", "spans", "byte_spans", "items")


def verdict(hits: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: at least a twentieth of the words hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return (hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
