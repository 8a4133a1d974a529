"""Phrase collocations from weighted acyclic automata.

Texts are cut into runs of whole documents.  Runs learn from hash shards the
ids of their frequent words, and which of their word pairs are frequent; a
phrase with a rare word or pair is rare itself.  What is left gives each run
its sorted n-grams with counts.

*Union*: the runs' sorted n-grams are cut at common bounds, which evenly
spaced samples of all runs give; a range merges its slices and sums equal
prefixes, so it holds the weights of its part of the union.  Prefixes at a
range's edge are summed across ranges.  *Build*: the surviving
phrases, sorted, go one by one into an acyclic automaton for each range; a
state is closed as soon as the next phrase leaves it and shared with an equal
one.  An arc weighs by how much the count drops, so equal continuations are
equal states whatever their counts.  *Compose*: the parts of all candidates
are sorted requests, an acyclic automaton too; both are walked together, which
weighs every part.

Hot words, pairs and passages: a run sends an n-gram once, ranges are cut at
any n-gram, and requests name a part once for each range of candidates, so
nothing is gathered by word, lang or phrase.

A null text is empty, a null lang is ``und``.  doc_id is not read.  Repeated
rows count as often as they occur; a very long text is a run of its own; an
empty table gives no rows.  Columns other than text and lang are not read, so
their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.blocks import cut_blocks
from stockspark.llm.common import pa_schema, prepare, sized_buckets, staged
from stockspark.llm.packed import deal_slices, pack_bits, planes, shard_cuts, unpack_bits, unplanes

RUN_BYTES = 8 << 20
WORDS_PER_SHARD, PAIRS_PER_SHARD, GRAMS_PER_RANGE, PHRASES_PER_AUTOMATON = 500_000, 2_000_000, 1_000_000, 100_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
_BREAKS = {bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"}
#: ``tokens``: places in ``words``, -1 between pieces; ``words``: the run's words, each with its lang (``langs`` index).
RUNS = "block long, langs array<string>, words array<binary>, lang_at array<int>, tokens binary, lang_words array<long>"
WORDS = "shard long, block long, at binary, words array<binary>, langs array<string>, counts binary"
IDS = "kind int, shard long, block long, at binary, ids binary, id long, word binary, lang string, n long"
PAIRS = "shard long, block long, keys binary, own binary"
ANSWER, ENTRY, PAIR = range(3)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ runs
def _run_of(block: int, langs, texts) -> dict:
    """Words of a run of documents, numbered by (lang, word)."""
    names: dict = {}
    of: dict = {}
    words, lang_at, tokens, totals = [], [], [], []
    for lang, text in zip(langs, texts):
        k = names.setdefault(lang, len(names))
        if k == len(totals):
            totals.append(0)
        for w in _TOKEN.findall(text.translate(_LOWER)):
            if w in _BREAKS:
                tokens.append(-1)
                continue
            at = of.get((k, w))
            if at is None:
                at = of[k, w] = len(words)
                words.append(w)
                lang_at.append(k)
            tokens.append(at)
            totals[k] += 1
        tokens.append(-1)
    return {"block": [block], "langs": [list(names)], "words": [words], "lang_at": [lang_at],
            "tokens": [np.asarray(tokens, "<i4").tobytes()], "lang_words": [totals]}


def _tokens(row) -> np.ndarray:
    return np.frombuffer(row["tokens"], "<i4").astype(np.int64)


def _send_words(n_shards: int):
    def run(frames):
        for rows in frames:
            for row in rows.to_dict("records"):
                words, langs = row["words"], [row["langs"][k] for k in row["lang_at"]]
                tokens = _tokens(row)
                counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
                shard = np.fromiter((zlib.crc32(w) % n_shards for w in words), np.int64, len(words))
                by = np.argsort(shard, kind="stable")
                parts = [p for p in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(p)]
                yield pd.DataFrame({
                    "shard": [int(shard[p[0]]) for p in parts], "block": row["block"],
                    "at": [p.astype("<i4").tobytes() for p in parts], "words": [[words[i] for i in p] for p in parts],
                    "langs": [[langs[i] for i in p] for p in parts],
                    "counts": [counts[p].astype("<i8").tobytes() for p in parts]})
    return run


def _number_words(min_n: int, n_shards: int):
    """Sums the counts of a shard's words; the frequent ones get ids, which are dictionary rows and go back to the runs."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total: dict = {}
        for words, langs, counts in zip(rows["words"], rows["langs"], rows["counts"]):
            for entry, n in zip(zip(langs, words), np.frombuffer(counts, "<i8").tolist()):
                total[entry] = total.get(entry, 0) + n
        shard = int(rows["shard"].iloc[0])
        ids, out = {}, []
        for entry in sorted(e for e, n in total.items() if n >= min_n):
            ids[entry] = 1 + shard + len(ids) * n_shards
            out.append((ENTRY, shard, -1, b"", b"", ids[entry], entry[1], entry[0], total[entry]))
        for block, at, words, langs in zip(rows["block"], rows["at"], rows["words"], rows["langs"]):
            got = np.fromiter((ids.get(e, 0) for e in zip(langs, words)), "<i8")
            full = got > 0
            out.append((ANSWER, shard, block, np.frombuffer(at, "<i4")[full].tobytes(), got[full].tobytes(), 0, b"", "", 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in IDS.split(", ")])
    return run


def _id_tokens(row, got: pd.DataFrame) -> np.ndarray:
    """The run's tokens as global ids; 0: a rare word or the end of a piece."""
    ids = np.zeros(len(row["words"]) + 1, np.int64)              # the last stands for -1
    for at, found in zip(got["at"], got["ids"]):
        ids[np.frombuffer(at, "<i4")] = np.frombuffer(found, "<i8")
    return ids[_tokens(row)]


def _pairs(t: np.ndarray):
    """Distinct 48-bit keys of the pairs of frequent words, their counts, the pairs' places and keys."""
    places = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
    h = (t[places].astype(np.uint64) * _M1 ^ (t[places] >> 32).astype(np.uint64)) + t[places + 1].astype(np.uint64) * _M2
    h ^= h >> np.uint64(31)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    keys, at, counts = np.unique(h >> np.uint64(16), return_inverse=True, return_counts=True)
    return keys, counts, places, at


def _frequent_pairs(min_n: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unplanes(k, "<u8", 6) for k in rows["keys"]]
        counts = np.concatenate([unplanes(o, "<u4") for o in rows["own"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        often = (np.bincount(at, weights=counts) >= min_n)[at]
        cuts = np.cumsum(list(map(len, keys)))[:-1]
        return pd.DataFrame({"kind": PAIR, "shard": rows["shard"], "block": rows["block"], "at": b"",
                             "ids": [pack_bits(x) for x in np.split(often, cuts)], "id": 0, "word": b"", "lang": "",
                             "n": 0})
    return run


def _grams(t: np.ndarray, often: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of at most ``size`` words from every place, 0-filled, in order, with counts.

    ``often``: the place and the next hold a frequent pair.  Equal n-grams are found by numbering longer and
    longer prefixes.
    """
    chain = np.concatenate((often, np.zeros(size + 1, bool)))
    start = np.flatnonzero(often)
    ids = np.concatenate((t, np.zeros(size + 1, np.int64)))
    code = np.unique(ids[start], return_inverse=True)[1]
    cols, linked = [ids[start]], np.ones(len(start), bool)
    for k in range(1, size):
        linked = linked & chain[start + k - 1]
        nxt = np.where(linked, ids[start + k], 0)
        words, at = np.unique(nxt, return_inverse=True)
        code = np.unique(code * len(words) + at, return_inverse=True)[1]
        cols.append(nxt)
    firsts, counts = np.unique(code, return_index=True, return_counts=True)[1:]
    return np.stack([c[firsts] for c in cols], 1) if len(start) else np.zeros((0, size), np.int64), counts


def _packed(ids: np.ndarray) -> bytes:
    """A matrix of ids, column by column in byte planes: sorted n-grams take little room."""
    return planes(np.ascontiguousarray(ids.T).reshape(-1))


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(unplanes(raw, "<i8").reshape(size, -1).T)


# ------------------------------------------------------------------ union
#: A run's sorted n-grams with counts and langs (``lang_at``: places in ``langs``), and some of them, evenly spaced.
GRAMS = "block long, n_grams long, grams binary, counts binary, lang_at binary, langs array<string>, sample binary"
SLICES = "shard long, grams binary, counts binary, lang_at binary, langs array<string>"
SAMPLED = 64                       # n-grams of a run's sample
MAX_SAMPLE = 1_000_000             # sampled n-grams that the driver sorts for the bounds


def _bytes_of(ids: np.ndarray) -> np.ndarray:
    """Rows as strings of the same order."""
    return np.ascontiguousarray(ids.astype(">i8")).view(f"S{8 * ids.shape[1]}").reshape(-1)


def _range_bounds(grams: DataFrame, n_ranges: int, size: int) -> np.ndarray:
    """The first n-grams of all ranges but the first, from the runs' samples, each by the n-grams it stands for."""
    n_runs = grams.count()
    if n_ranges < 2 or not n_runs:
        return np.zeros((0, size), np.int64)
    some = grams.sample(min(1.0, MAX_SAMPLE / SAMPLED / n_runs), seed=1) if n_runs * SAMPLED > MAX_SAMPLE else grams
    rows = some.select("n_grams", "sample").collect()                # at most about MAX_SAMPLE n-grams
    keys = [_unpacked(r["sample"], size) for r in rows]
    weight = np.concatenate([np.full(len(k), r["n_grams"] / max(len(k), 1)) for k, r in zip(keys, rows)])
    ids = np.concatenate(keys)
    by = np.lexsort(ids.T[::-1])
    upto = np.cumsum(weight[by])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n_ranges) / n_ranges) if len(upto) else np.empty(0, np.int64)
    return np.unique(ids[by[at]], axis=0)


def _send_slices(bounds: np.ndarray, size: int):
    """Every run's n-grams cut at the bounds, a row for each range it has some of."""
    edges = _bytes_of(bounds) if len(bounds) else None

    def run(frames):
        for rows in frames:
            for raw, counts, lang_at, langs in zip(rows["grams"], rows["counts"], rows["lang_at"], rows["langs"]):
                ids, n, at = _unpacked(raw, size), unplanes(counts, "<u4"), np.frombuffer(lang_at, "<u4")
                cuts = [0, *(np.searchsorted(_bytes_of(ids), edges).tolist() if edges is not None else []), len(ids)]
                full = [k for k in range(len(cuts) - 1) if cuts[k + 1] > cuts[k]]
                part = [slice(cuts[k], cuts[k + 1]) for k in full]
                yield pd.DataFrame({"shard": full, "grams": [_packed(ids[x]) for x in part],
                                    "counts": [planes(n[x]) for x in part],
                                    "lang_at": [at[x].tobytes() for x in part], "langs": [langs] * len(part)})
    return run


def _union_range(size: int, min_n: int):
    """All runs' n-grams of a range to the weights of their prefixes of two or more words.

    A prefix below ``min_n`` counts only at the range's edge, where another range may hold the rest of it.
    """
    names = [f"w{k}" for k in range(1, size + 1)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        every: dict = {}
        code = [np.array([every.setdefault(x, len(every)) for x in langs], np.int64) for langs in rows["langs"]]
        m = np.concatenate([_unpacked(g, size) for g in rows["grams"]])
        n = np.concatenate([unplanes(c, "<u4") for c in rows["counts"]]).astype(np.int64)
        lang = np.concatenate([c[np.frombuffer(a, "<u4")] for c, a in zip(code, rows["lang_at"])])
        by = np.lexsort(m.T[::-1])
        m, n, lang = m[by], n[by], lang[by]
        changed = np.zeros(len(m), bool)
        changed[0] = True
        parts = []
        for level in range(1, size + 1):
            changed[1:] |= m[1:, level - 1] != m[:-1, level - 1]
            if level == 1:
                continue
            lead = np.flatnonzero(changed)
            sums = np.add.reduceat(n, lead)
            real = m[lead, level - 1] > 0
            lead, sums = lead[real], sums[real]
            keep = sums >= min_n
            keep[:1] = keep[-1:] = True
            ids = np.zeros((int(keep.sum()), size), np.int64)
            ids[:, :level] = m[lead[keep], :level]
            frame = pd.DataFrame(ids, columns=names)
            frame["n"], frame["lang"] = sums[keep], np.array(list(every), object)[lang[lead[keep]]]
            parts.append(frame)
        return pd.concat(parts)
    return run


# ------------------------------------------------------------------ automata
class Automaton:
    """Phrases with counts as a minimal acyclic automaton; an arc's weight is the drop of the count along it."""

    def __init__(self, labels, drops, targets, starts, root: int):
        self.labels, self.drops, self.targets, self.starts, self.root = labels, drops, targets, starts, root

    @classmethod
    def build(cls, phrases, counts) -> Automaton:
        """From phrases (tuples of ids) in ascending order, prefixes before what they begin.

        A prefix that lies in another range takes its first continuation's count; it is not asked here.
        """
        labels: list = []
        drops: list = []
        targets: list = []
        starts: list = [0]
        known: dict = {}
        path: list = [[0, 0, []]]                       # open states: [label to it, count, closed arcs]

        def close(state) -> int:
            arcs = tuple(state[2])
            at = known.get(arcs)
            if at is None:
                at = known[arcs] = len(starts) - 1
                for label, drop, target in arcs:
                    labels.append(label)
                    drops.append(drop)
                    targets.append(target)
                starts.append(len(labels))
            return at

        def leave(depth: int) -> None:
            while len(path) > depth + 1:
                last = path.pop()
                path[-1][2].append((last[0], path[-1][1] - last[1], close(last)))
        before: tuple = ()
        for phrase, n in zip(phrases, counts):
            same = 0
            while same < len(before) and same < len(phrase) and before[same] == phrase[same]:
                same += 1
            leave(same)
            for label in phrase[same:]:
                path.append([label, n, []])
            before = phrase
        leave(0)
        root = close(path[0])
        return cls(labels, drops, targets, starts, root)

    def step(self, state: int, n: int, label: int):
        """(state, count) after ``label``; None where no phrase goes on so."""
        lo, hi = self.starts[state], self.starts[state + 1]
        k = bisect_left(self.labels, label, lo, hi)
        return (self.targets[k], n - self.drops[k]) if k < hi and self.labels[k] == label else None

    def compose(self, parts) -> list:
        """Counts of sorted ``parts``: both automata are walked together, shared prefixes once."""
        out, path, before = [], [(self.root, 0)], ()
        for part in parts:
            same = 0
            while same < min(len(before), len(part), len(path) - 1) and before[same] == part[same]:
                same += 1
            del path[same + 1:]
            for label in part[same:]:
                path.append(self.step(*path[-1], label))
                if path[-1] is None:
                    raise ValueError(f"no weight for a part of a phrase: {part}")
            out.append(path[-1][1])
            before = part
        return out

    def dump(self) -> bytes:
        return b"".join(np.asarray(x, "<i8").tobytes() for x in (
            [len(self.labels), len(self.starts), self.root], self.labels, self.drops, self.targets, self.starts))

    @classmethod
    def load(cls, raw: bytes) -> Automaton:
        a = np.frombuffer(raw, "<i8").tolist()
        n, s = a[0], a[1]
        return cls(a[3:3 + n], a[3 + n:3 + 2 * n], a[3 + 2 * n:3 + 3 * n], a[3 + 3 * n:3 + 3 * n + s], a[2])


def _phrases(ids: np.ndarray) -> list:
    """Rows of a 0-filled matrix as tuples."""
    return [tuple(r[:r.index(0)] if 0 in r else r) for r in ids.tolist()]


def _matrix(phrases, size: int) -> bytes:
    out = np.zeros((len(phrases), size), np.int64)
    for k, p in enumerate(phrases):
        out[k, :len(p)] = p
    return planes(out.reshape(-1))


def _parts(phrases) -> list:
    """Distinct first parts and rests of all phrases of two or more words, in order."""
    return sorted({x for p in phrases for k in range(1, len(p)) for x in (p[:k], p[k:])})


def _build_ranges(size: int):
    """Sorted phrases of a partition to one automaton, with its phrases of two or more words (the candidates)."""
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids = np.stack([t.column(k).to_numpy() for k in range(size)], 1)
        phrases, counts = _phrases(ids), t.column(size).to_pylist()
        long_ = [k for k, p in enumerate(phrases) if len(p) > 1]
        yield pa.RecordBatch.from_pydict({
            "low": [list(phrases[0])], "automaton": [Automaton.build(phrases, counts).dump()],
            "phrases": [_matrix([phrases[k] for k in long_], size)], "counts": [[counts[k] for k in long_]],
            "langs": [[t.column(size + 1)[k].as_py() for k in long_]]}, schema=pa.schema([
                ("low", pa.list_(pa.int64())), ("automaton", pa.binary()), ("phrases", pa.binary()),
                ("counts", pa.list_(pa.int64())), ("langs", pa.list_(pa.string()))]))
    return run


def _ask(lows: list, size: int):
    """Requests of a range's candidates: their parts, dealt to the ranges that hold them."""
    def run(frames):
        for rows in frames:
            for low, raw in zip(rows["low"], rows["phrases"]):
                parts = _parts(_phrases(unplanes(raw, "<i8").reshape(-1, size)))
                by = [(k, list(g)) for k, g in groupby(parts, lambda p: bisect_right(lows, p) - 1)]
                yield pd.DataFrame({"shard": [k for k, _ in by], "block": bisect_right(lows, tuple(low)) - 1,
                                    "parts": [_matrix(g, size) for _, g in by]})
    return run


# ------------------------------------------------------------------ the operator
def collocations(docs: DataFrame, min_n: int = 100, size: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases by their weakest cut."""
    scored, words = score_phrases(docs, min_n, size)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ahead = scored.withColumn("place", F.rank().over(first)).where(F.col("place") <= top)
    spelled = (ahead.select("lang", "a", "l", "r", "n", "score", "ids", F.posexplode("ids").alias("at", "id"))
               .join(words.select("id", "word"), "id")
               .groupBy("ids").agg(*(F.first(c).alias(c) for c in ("lang", "a", "l", "r", "n", "score")),
                                   F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws")))
    text = F.concat_ws(" ", F.transform("ws", lambda x: x["word"]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (spelled.select("lang", text.alias("phrase"), "a", "l", "r", "n", "score")
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def score_phrases(docs: DataFrame, min_n: int = 100, size: int = 5):
    """(lang, ids, a, l, r, n, score of all kept candidates; id, word, lang, n of the frequent words)."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    out = pa_schema(spark, RUNS)

    def to_runs(batches):
        for block, langs, texts in cut_blocks(batches, RUN_BYTES):
            yield pa.RecordBatch.from_pydict(_run_of(block, langs, texts), schema=out)
    runs = sized_buckets(src.mapInArrow(to_runs, RUNS), "block", "phrase_runs", src, "text")
    totals = (runs.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x"))
              .groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n")))
    sums = runs.agg(F.sum(F.size("words")).alias("w"), F.sum(F.length("tokens")).alias("t")).first()
    n_shards = max(1, -(-(sums["w"] or 0) // WORDS_PER_SHARD))
    n_pair_shards = max(1, (sums["t"] or 0) // 4 // PAIRS_PER_SHARD)

    def with_answers(got, fn, schema):
        return runs.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(fn, schema)

    def send_pairs(rows, got):
        for row in rows.to_dict("records"):
            keys, counts, _, _ = _pairs(_id_tokens(row, got))
            return deal_slices(row["block"], keys >> np.uint64(16), lambda a, b: planes(keys[a:b], 6),
                               lambda a, b: planes(counts[a:b].astype("<u4")), n_pair_shards)
        return pd.DataFrame(columns=[c.split()[0] for c in PAIRS.split(", ")])

    names = [f"w{k}" for k in range(1, size + 1)]

    def to_grams(rows, got):
        for row in rows.to_dict("records"):
            t = _id_tokens(row, got[got["kind"] == ANSWER])
            keys, _, places, at = _pairs(t)
            cuts = shard_cuts(keys >> np.uint64(16), n_pair_shards)
            frequent = np.zeros(len(keys), bool)
            pairs = got[got["kind"] == PAIR]
            for s, raw in zip(pairs["shard"], pairs["ids"]):
                frequent[cuts[s]:cuts[s + 1]] = unpack_bits(raw, cuts[s + 1] - cuts[s])
            often = np.zeros(len(t), bool)
            often[places[frequent[at]]] = True
            grams, counts = _grams(t, often, size)
            known = _id_all(row, got)                          # the lang of an n-gram is that of its first word
            order = np.argsort(known, kind="stable")
            lang_at = np.asarray(row["lang_at"], np.int64)[order[np.searchsorted(known[order], grams[:, 0])]] \
                if len(grams) else np.empty(0, np.int64)
            return pd.DataFrame({
                "block": [row["block"]], "n_grams": [len(grams)], "grams": [_packed(grams)],
                "counts": [planes(counts.astype("<u4"))], "lang_at": [lang_at.astype("<u4").tobytes()],
                "langs": [list(row["langs"])],
                "sample": [_packed(grams[np.linspace(0, len(grams), SAMPLED, endpoint=False).astype(np.int64)]
                                   if len(grams) else grams)]})
        return pd.DataFrame(columns=[c.split()[0] for c in GRAMS.split(", ")])

    sent = runs.select("block", "langs", "words", "lang_at", "tokens").mapInPandas(_send_words(n_shards), WORDS)
    numbered = staged(sent.groupBy("shard").applyInPandas(_number_words(min_n, n_shards), IDS), "phrase-ids")
    words = numbered.where(F.col("kind") == ENTRY).select(
        "id", F.decode("word", "utf-8").alias("word"), "lang", "n")
    got = numbered.where(F.col("kind") == ANSWER)
    pairs = staged(with_answers(got, send_pairs, PAIRS).groupBy("shard").applyInPandas(_frequent_pairs(min_n), IDS),
                   "phrase-pairs")
    grams = staged(with_answers(got.unionByName(pairs), to_grams, GRAMS), "phrase-grams").where("n_grams > 0")

    # union: ranges of the sorted n-grams, weights of all prefixes; edges are summed across ranges
    cores = spark.sparkContext.defaultParallelism
    n_grams = grams.agg(F.sum("n_grams").alias("n")).first()["n"] or 0
    bounds = _range_bounds(grams, max(1, min(cores, n_grams // 10_000), -(-n_grams // GRAMS_PER_RANGE)), size)
    slices = grams.select("grams", "counts", "lang_at", "langs").mapInPandas(_send_slices(bounds, size), SLICES)
    wide = ", ".join(f"{c} long" for c in [*names, "n"]) + ", lang string"
    summed = slices.groupBy("shard").applyInPandas(_union_range(size, min_n), wide)
    phrases = (summed.groupBy(*names).agg(F.sum("n").alias("n"), F.first("lang").alias("lang"))
               .where(F.col("n") >= min_n)
               .unionByName(words.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(c) for c in names[1:]),
                                         "n", "lang")))
    phrases = staged(phrases, "phrases")
    parts = max(cores, -(-phrases.count() // PHRASES_PER_AUTOMATON))
    automata = staged(
        phrases.repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInArrow(
            _build_ranges(size), "low array<long>, automaton binary, phrases binary, counts array<long>, "
                                 "langs array<string>"), "automata")
    lows = sorted(tuple(r["low"]) for r in automata.select("low").collect())       # one row a range

    # compose: parts of candidates against the ranges that hold them
    number = F.udf(lambda low: bisect_right(lows, tuple(low)) - 1, "long")
    automata = automata.withColumn("shard", number("low"))
    asked = automata.select("low", "phrases").mapInPandas(_ask(lows, size), "shard long, block long, parts binary")

    def weigh(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton.load(held["automaton"].iloc[0]) if len(asked) else None
        return pd.DataFrame({
            "shard": asked["shard"], "block": asked["block"], "parts": asked["parts"],
            "counts": [automaton.compose(_phrases(unplanes(raw, "<i8").reshape(-1, size))) for raw in asked["parts"]]})
    weights = staged(automata.select("shard", "automaton").groupBy("shard").cogroup(asked.groupBy("shard"))
                     .applyInPandas(weigh, "shard long, block long, parts binary, counts array<long>"), "weights")

    def candidates(held: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        f = {p: n for raw, ns in zip(got["parts"], got["counts"])
             for p, n in zip(_phrases(unplanes(raw, "<i8").reshape(-1, size)), ns)}
        rows = []
        for raw, counts, langs in zip(held["phrases"], held["counts"], held["langs"]):
            for p, a, lang in zip(_phrases(unplanes(raw, "<i8").reshape(-1, size)), counts, langs):
                rows.append((list(p), int(a), lang, [{"l": f[p[:k]], "r": f[p[k:]]} for k in range(1, len(p))],
                             [list(x) for x in (p[:-1], p[1:]) if len(x) > 1 and f[x] == a]))
        return pd.DataFrame(rows, columns=["ids", "a", "lang", "cuts", "dropped"])
    found = staged(
        automata.select(F.col("shard").alias("block"), "phrases", "counts", "langs").groupBy("block")
        .cogroup(weights.groupBy("block")).applyInPandas(
            candidates, "ids array<long>, a long, lang string, cuts array<struct<l:long,r:long>>, "
                        "dropped array<array<long>>"), "candidates")
    # a longer candidate with an equal count drops what it holds; one word longer suffices, since counts only fall
    dropped = found.select(F.explode("dropped").alias("ids")).distinct()
    wide_n = [F.col(c).cast("decimal(18,0)") for c in ("a", "n")]
    ratio = F.expr("cast(cast(1000 as decimal(4,0)) * (a18 * n18) as decimal(38,0))")
    scored = (found.join(dropped, "ids", "left_anti").join(totals, "lang")
              .withColumn("a18", wide_n[0]).withColumn("n18", wide_n[1]).withColumn("top", ratio)
              .withColumn("cut", F.array_min(F.transform("cuts", lambda x, i: F.struct(
                  F.call_function("div", F.col("top"), (x["l"].cast("decimal(18,0)") * x["r"].cast("decimal(18,0)"))
                                  ).alias("score"), i.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))))
    return scored.select("lang", "ids", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").alias("score")), words


def _id_all(row, got: pd.DataFrame) -> np.ndarray:
    """The global id of each of the run's words (0: rare)."""
    ids = np.zeros(len(row["words"]), np.int64)
    got = got[got["kind"] == ANSWER]
    for at, found in zip(got["at"], got["ids"]):
        ids[np.frombuffer(at, "<i4")] = np.frombuffer(found, "<i8")
    return ids
