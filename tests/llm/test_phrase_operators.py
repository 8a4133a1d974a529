"""Repeated word passages, spelling variants and collocations against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stockspark.llm import anchor_dedup, collocations, queries, spelling_forms
from tests.llm.test_text_operators import clash, same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ repeated passages
def plain_repeats(docs, window):
    """(doc_id, n_words, n_removed, digest, kept words) of (doc_id, text) rows; a null id orders first."""
    key = lambda i: (i is not None, i or 0)
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k:k + window])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, ws in words:
        gone = {j for k in range(len(ws) - window + 1) if first[tuple(ws[k:k + window])] < key(i)
                for j in range(k, k + window)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def check_repeats(df, window):
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = anchor_dedup.find_repeats(clash(df), window, with_text=True).collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got],
         plain_repeats(docs, window))
    return docs, got


@pytest.mark.parametrize("window", [13, 4, 1])
def test_passages_odd_rows(odd, window):
    check_repeats(odd, window)


def test_passages_are_maximal_and_name_their_source(make):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    a, b = fresh(40), fresh(60)
    texts = [a + fresh(5), fresh(7) + b, fresh(3) + a[5:30] + fresh(4) + b[10:50] + fresh(2), a[:12] + fresh(30),
             fresh(2) + a[20:40] + fresh(1) + a[20:40], b[59:] + a[:13]]
    df = make([" ".join(t) for t in texts])
    _, got = check_repeats(df, 13)
    repeats = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in got}
    assert repeats[2] == [(3, 25, 0, 5), (32, 40, 1, 17)]
    assert repeats[3] == [] and repeats[0] == [] and repeats[1] == []
    assert repeats[4] == [(2, 20, 0, 20), (23, 20, 0, 20)] and repeats[5] == [(1, 13, 0, 0)]


def test_passages_few_words_many_copies(make):
    """Two-word texts make nearly every window a repeat; exact copies, overlaps and self-overlaps."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += ["x " * 50] * 40 + [texts[0] + " tail"] * 30
    rng.shuffle(texts)
    check_repeats(make(texts, parts=7), 13)
    check_repeats(make(texts, parts=7), 6)


def test_passages_across_shards_and_runs(make, monkeypatch):
    monkeypatch.setattr(anchor_dedup, "RUN_BYTES", 400)
    monkeypatch.setattr(anchor_dedup, "KEYS_PER_SHARD", 50)
    rng = random.Random(8)
    shared = [" ".join(f"s{k}_{j}" for j in range(40)) for k in range(5)]
    texts = [" ".join(rng.choice([rng.choice(shared), f"u{rng.random()}"]) for _ in range(6)) for _ in range(80)]
    check_repeats(make(texts, parts=5), 13)


def test_passages_empty_table(odd):
    assert anchor_dedup.find_repeats(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ spelling variants
def plain_words(docs):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate(AZ)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_forms(n):
    """Rows of the contract from word counts; near words by wildcard and deletion dictionaries."""
    holes, cut = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
            cut[w[:k] + w[k + 1:]].add(w)
    rows, form = [], {}
    for w in n:
        near = set().union(*(holes[w[:k], w[k + 1:]] for k in range(len(w)))) - {w}
        near |= cut[w] if w in cut else set()
        near |= {w[:k] + w[k + 1:] for k in range(len(w))} & n.keys()
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        rows.append((w, len(near)))
    for w, near in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, n[w], near, form[w], None if form[w] is None else n[form[w]], root


COLS = ("word", "n", "n_near", "form", "form_n", "root")


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_spelling_variants(spark, SF).collect()
    want = list(plain_forms(plain_words(docs)))
    assert len(want) > 300 and any(r[3] for r in want) and any(r[3] and r[5] != r[3] for r in want)
    same([tuple(r[c] for c in COLS) for r in got], want)


def test_spelling_dense_words(make):
    """Short alphabets make large prefix ranges, runs of equal letters, ties and long chains of forms."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(600)]
    weights = [2 ** rng.randrange(0, 6) for _ in words]
    texts = [" ".join(rng.choices(words, weights, k=900)).upper().replace("É", "é") + "…" for _ in range(12)]
    df = make([*enumerate(texts), (None, texts[0]), (3, texts[3]), (50, None), (51, ""), (52, "aaaaa-aaaaa aaaaaa aaaa")])
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = list(plain_forms(plain_words(docs)))
    assert max(r[2] for r in want) > 10
    same([tuple(r[c] for c in COLS) for r in spelling_forms.spelling_forms(clash(df)).collect()], want)


def test_spelling_odd_rows(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same([tuple(r[c] for c in COLS) for r in spelling_forms.spelling_forms(clash(odd)).collect()],
         list(plain_forms(plain_words(docs))))
    assert spelling_forms.spelling_forms(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ collocations
def plain_collocations(docs, min_n, size=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, size + 1):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    f = {k: c for k, c in f.items() if c >= min_n}
    held = {}
    for (lang, p), c in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                held[lang, p[i:i + m]] = max(held.get((lang, p[i:i + m]), 0), c)
    rows = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and held.get((lang, p), 0) < a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k,
                                  f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    for lang, found in rows.items():
        for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]):
            yield lang, k + 1, p.decode(), -a, l, r, n[lang], -s


def check_collocations(df, **kw):
    docs = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
    got = [tuple(r) for r in collocations.collocations(clash(df), **kw).collect()]
    want = list(plain_collocations(docs, **kw))
    same(got, want)
    return want


def phrases(rng, n_words, n):
    """Texts with hot words, hot pairs and fixed phrases, several languages, breaks and odd white space."""
    vocab = [f"w{k}" for k in range(n_words)]
    fixed = [rng.choices(vocab, k=rng.randrange(2, 7)) for _ in range(8)]
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 40)):
            out += rng.choice([rng.choice(fixed), ["The"], ["the", "of"], [rng.choice(vocab)]])
            out += rng.choice([[], [], [], [rng.choice([".", ",", "\n", "\r", ":"])]])
        yield rng.choice([" ", "  ", "\t"]).join(out)


def test_collocations_match_plain_counts(make):
    rng = random.Random(4)
    df = make(list(phrases(rng, 30, 150)), parts=5)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("lang")))
    assert len(check_collocations(df, min_n=12)) > 60
    check_collocations(df, min_n=3, top=7)
    check_collocations(df, min_n=5, size=3)


def test_collocations_across_shards_and_ranges(make, monkeypatch):
    for name, value in (("RUN_BYTES", 500), ("WORDS_PER_SHARD", 40), ("PAIRS_PER_SHARD", 300), ("GRAMS_PER_RANGE", 60),
                        ("PHRASES_PER_AUTOMATON", 20), ("SAMPLED", 5)):
        monkeypatch.setattr(collocations, name, value)
    check_collocations(make(list(phrases(random.Random(5), 12, 60)), parts=4), min_n=6)


def test_collocations_odd_rows(odd, make):
    assert check_collocations(odd, min_n=100)
    check_collocations(make(["a b"]), min_n=100)
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_automaton_shares_states_and_weighs_parts():
    counts = {(1,): 9, (1, 2): 7, (1, 2, 3): 7, (1, 4): 2, (5,): 6, (5, 2): 4, (5, 2, 3): 4, (6,): 6, (6, 2): 4, (6, 2, 3): 4}
    items = sorted(counts)
    a = collocations.Automaton.load(collocations.Automaton.build(items, [counts[p] for p in items]).dump())
    assert a.compose(items) == [counts[p] for p in items]
    assert len(a.starts) - 1 == 5             # end, "2 3" behind 1, 5 and 6, the state after 1, after 5 and 6, the root
    with pytest.raises(ValueError):
        a.compose([(5, 9)])
