"""Language ID, LM scores, classifier, passages, near-duplicates and the pipeline."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockspark.llm import bwt_dedup, langid, ngram_trie, queries, rule_ensemble, simhash_vp
from stockspark.llm.common import fold_of, staged
from tests.llm.test_text_operators import clash, same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ------------------------------------------------------------------ language ID


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.collect() if fold_of(r["doc_id"], 4) == 2]
    assert all(p["held_out"] for _, p in held) and sum(p["held_out"] for p in got.values()) == len(held)
    assert sum(lang == p["lang_pred"] for lang, p in held) >= 0.97 * len(held)


def test_language_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id doc_id", "if(id % 100 = 0, 'b', 'a') lang", "'x' text")
    got = {r["lang"]: r["count"] for r in langid.sample(rows, 1500).groupBy("lang").count().collect()}
    assert got["b"] == 200 and abs(got["a"] - 1500) < 200


def test_language_odd_rows(odd, make):
    got = langid.identify(clash(odd)).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in texts.get(r["doc_id"]) or "") if r["doc_id"] is not None else True
        assert 0 <= r["score"] <= 1 and (letters or r["lang_pred"] == "und")
    none = langid.identify(make([(2, "a b")]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
    assert langid.identify(odd.limit(0)).count() == 0


def test_unseen_words_back_off():
    model = {"langs": ["a", "b"], "tables": {0: {"known": [0.0, -9.0]}, 2: {"zz": [-9.0, -1.0]}, 1: {"q": [-1.0, -9.0]}}}
    s = langid.Scorer(model)
    assert s.predict(["known", "xzzx", "q", "", None, "12"])[0] == ["a", "b", "a", "und", "und", "und"]


def plain_languages(docs, max_words, max_grams):
    """Language and score of each (doc_id, lang, text) row by counting in Python, without a sample."""
    import unicodedata
    kind = lambda c: unicodedata.category(c)[0]

    def words(text):
        out, cur = [], ""
        for c in (text or "").lower() + " ":
            if kind(c) == "L" or cur and kind(c) == "M":
                cur += c
            elif cur:
                out.append(cur)
                cur = ""
        return out
    grams = lambda w, k: [f" {w} "[i:i + k] for i in range(len(w) + 3 - k)]
    n = Counter()
    for i, lang, text in docs:
        if fold_of(i, 4) != 2 and lang is not None and text is not None:
            for w in words(text):
                n[0, w, lang] += 1
                for k in (1, 2, 3, 4):
                    n.update((k, g, lang) for g in grams(w, k))
    total, size, by = Counter(), Counter(), {}
    for (k, e, lang), c in n.items():
        total[k, lang] += c
        size[k, lang] += 1
        by.setdefault((k, lang), []).append((-c, e))
    known = {(k, e) for (k, _), es in by.items() for _, e in sorted(es)[:max_words if k == 0 else max_grams]}
    langs = sorted({lang for _, lang in total})
    logp = lambda k, e: np.array([math.log((n[k, e, x] + 0.5) / (total[k, x] + 0.5 * (size[k, x] + 1))) for x in langs])
    for i, _, text in docs:
        ws, sums = words(text), np.zeros(len(langs))
        for w in ws:
            hits = next((h for h in ([(0, w)] * ((0, w) in known), *([(k, g) for g in grams(w, k) if (k, g) in known]
                                                                     for k in (4, 3, 2, 1))) if h), [])
            if hits:
                sums = sums + sum(logp(*h) for h in hits) / len(hits)
        if not ws or not langs:
            yield i, "und", 0.0
        else:
            yield i, langs[int(sums.argmax())], float(1 / np.exp(sums - sums.max()).sum())


def test_languages_equal_plain_scorer(make):
    """Every prediction against counting in Python: a language of few rows, tight bounds, marks, numbers."""
    rng = random.Random(9)
    vocab = {"de": "der die und über straße nicht größe", "en": "the and over street not size of it", "hi": "यह किताब अच्छी है हिन्दी में"}
    texts = []
    for i in range(90):
        lang = "hi" if i % 18 == 0 else ("de", "en")[i % 2]
        base = vocab[lang].split()
        texts.append((i, lang, " ".join(rng.choice(base) + rng.choice(["", "", "x", "½"]) for _ in range(rng.randrange(1, 25)))))
    texts += [(200, "en", "½ ² ③ Ⅷ 12 _"), (201, None, None), (202, "de", ""), (203, None, "किताब हिन्दी"), (204, "en", "zzz")]
    df = make([(i, t) for i, _, t in texts]).drop("lang").join(
        make([]).sparkSession.createDataFrame([(i, lang) for i, lang, _ in texts], "doc_id long, lang string"), "doc_id", "left")
    for words, grams in ((1000, 1000), (4, 6)):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in
               langid.identify(df, max_words=words, max_grams=grams).collect()}
        for i, lang, score in plain_languages(texts, words, grams):
            assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), i
        assert got[200] == ("und", 0.0) and got[203][0] == "hi"


def test_languages_with_few_rows(spark):
    """A language of a few dozen rows among full ones is still told apart on held-out rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = docs.where("lang = 'es'").orderBy("doc_id").limit(40)
    got = langid.identify(docs.where("lang <> 'es'").unionByName(few), max_words=3000, max_grams=1500)
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    es = [r for r in held if r["lang"] == "es"]
    assert len(es) >= 5 and sum(r["lang_pred"] == "es" for r in es) >= 0.9 * len(es)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


# ------------------------------------------------------------------ LM scores
def plain_lm(docs, order):
    mu, grams = ngram_trie.MU, [Counter() for _ in range(order)]
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t in docs]
    train = [t for i, t in tokens if i is None or fold_of(i, 5) != 1]
    for t in train:
        for k in range(order):
            grams[k].update(tuple(t[j - k:j + 1]) for j in range(k, len(t)))
    n, v = sum(map(len, train)), len(grams[0])

    def p(t, j, k):
        if k == 0:
            return (grams[0][t[j],] + 0.5) / (n + 0.5 * (v + 1))
        if j < k:
            return p(t, j, k - 1)
        g = tuple(t[j - k:j + 1])
        return (grams[k][g] + mu * p(t, j, k - 1)) / (grams[k - 1][g[:-1]] + mu)
    return [(i, len(t), sum(grams[0][w,] > 0 for w in t), n,
             sum(math.log10(p(t, j, 0)) for j in range(len(t))),
             sum(math.log10(p(t, j, order - 1)) for j in range(len(t)))) for i, t in tokens]


@pytest.mark.parametrize("order", [2, 3])
def test_lm_matches_plain_counts(spark, odd, order, monkeypatch):
    docs = clash(odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(40)))
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(ngram_trie, "KEYS_PER_SHARD", 3_000)
    got = ngram_trie.score_documents(docs, order).collect()
    want = plain_lm([(r["doc_id"], r["text"]) for r in docs.collect()], order)
    key = lambda r: (str(r[0]), r[1], round(r[4], 3))
    rows = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert abs(a[5] - b[5]) <= a[1] * order / ngram_trie.STEPS_PER_UNIT
    assert all(r["held_out"] == (r["doc_id"] is not None and fold_of(r["doc_id"], 5) == 1) for r in got)


def test_elias_fano_sequences():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (7, 3), (1000, 10**7), (5000, 300), (2000, 2001)):
        v = np.sort(rng.integers(0, top, n))
        assert (ngram_trie.EliasFano(v).access(np.arange(n)) == v).all()
        d = np.unique(v)
        t = np.concatenate((d, rng.integers(0, top + 50, 500)))
        place = {int(x): k for k, x in enumerate(d)}
        assert ngram_trie.EliasFano(d).find(t).tolist() == [place.get(int(x), -1) for x in t]


def test_lm_on_nothing(make):
    assert ngram_trie.score_documents(make([(1, "a")]).limit(0)).count() == 0


# ------------------------------------------------------------------ classifier
def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, sf).collect()}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
            if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_scores_equal_the_rules_by_hand(spark, monkeypatch):
    """Each score of the query against its rules, evaluated in Python on statistics of the stored measurements."""
    from stockspark.llm.quality_rules import ledger
    sf = "/root/testdata/sf0.01"
    models = []
    fit = rule_ensemble.fit
    monkeypatch.setattr(rule_ensemble, "fit", lambda rows: models.append(fit(rows)) or models[-1])
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, sf).collect()}
    model, = models
    assert model.rules
    ratio = lambda a, b: a / b if b else 0.0
    for r in ledger(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        x = {"log_words": math.log1p(r["n_words"]), "word_length": ratio(r["word_chars"], r["n_words"]),
             "symbol_chars": ratio(r["n_symbols"], r["word_chars"]), "symbol_words": ratio(r["n_symbol_words"], r["n_words"]),
             "bang_words": ratio(r["n_bang_words"], r["n_words"]), "upper": ratio(r["n_upper"], r["n_letters"]),
             "letters": ratio(r["n_letters"], r["word_chars"]), "digits": ratio(r["n_digits"], r["word_chars"]),
             "dup_lines": ratio(r["n_dup_lines"], r["n_lines"]), "repeat_words": ratio(r["n_repeat_words"], r["n_words"]),
             "ended_lines": ratio(r["n_ended_lines"], r["n_lines"]), "words_a_line": ratio(r["n_words"], r["n_lines"]),
             "longest_word": float(r["longest_word"])}
        total = model.intercept + sum(w for rule, w in model.rules if all(
            x[name] <= cut if way == "<=" else x[name] > cut for name, way, cut in rule))
        score = 1 / (1 + math.exp(-total))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == int(score >= 0.3)


def test_classifier_odd_labels(spark, odd):
    ids = [(i, q) for i in range(16) for q in ((i % 2, None) if i else (None,))]
    labels = clash(spark.createDataFrame([*ids, (None, 1), (3, 1), (3, 0), (99, 7)], "doc_id long, quality int"))
    assert rule_ensemble.score_quality(clash(odd), labels).count() == odd.count()
    one = rule_ensemble.score_quality(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in one] == [0.5]
    assert rule_ensemble.score_quality(odd.limit(0), labels).count() == 0
    kept = rule_ensemble.keep_good(odd, labels.limit(0), tuple(odd.columns))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# ------------------------------------------------------------------ passages
def plain_repeats(rows, length=100):
    """rows in order of place: (id, bytes)."""
    seen, out = set(), []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def passages(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, docs = [text(40) for _ in range(4)], []
    for k in range(70):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randint(0, 60):])
        docs.append(" ".join(parts))
    docs += docs[:9] + [d[5:] for d in docs[10:14]] + ["x" * 500, "ab" * 300, "y" * 99, "z" * 100, "z" * 100, None, ""]
    return docs


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeats_match_plain_search(make, most, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(bwt_dedup, "KEYS_PER_SHARD", 100)
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", 3_000)
    texts = passages()
    got = bwt_dedup.remove_repeats(clash(make(texts)), max_contexts=most).collect()
    want = plain_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], want)


def test_merged_transforms_mark_repeats():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 2000).astype(np.uint8).tobytes()
    texts = [base[a:a + int(rng.integers(100, 240))] for a in rng.integers(0, 1700, 60).tolist()] + [b"a" * 180, b"ab" * 90]
    for shard in (500, 1 << 20):
        marks, seen = bwt_dedup.mark_bucket(texts, 100, shard), set()
        for t, m in zip(texts, marks):
            for k in range(len(t) - 99):
                assert m[k] == (t[k:k + 100] in seen)
                seen.add(t[k:k + 100])


@pytest.mark.parametrize("symbol", [1, 3, 8, 13, 32])
def test_common_prefixes_of_a_merge(symbol, monkeypatch):
    texts = [np.frombuffer(t, np.uint8) for t in (b"banana-banana-bandana" + bytes(8), b"ananas-banana-x" + bytes(8))]
    length = 20
    monkeypatch.setattr(bwt_dedup, "SYMBOL", symbol)
    ranks = bwt_dedup.symbols(texts, bwt_dedup._rounds(length))
    built = [bwt_dedup.transform({s: r[k] for s, r in ranks.items()}, length) for k in range(2)]
    z, interval, common = bwt_dedup.merge_transforms(built, length)
    order = np.empty((len(z), 2), np.int64)
    slot = np.argsort(z, kind="stable")
    order[slot] = [(k, p) for k, (o, _) in enumerate(built) for p in o]
    pre = [bytes(np.resize(np.roll(texts[k], -p), length)) for k, p in order.tolist()]
    assert pre == sorted(pre)
    for i in range(1, len(pre)):
        lcp = next((j for j in range(length) if pre[i][j] != pre[i - 1][j]), length)
        assert (interval[i] == interval[i - 1]) == (lcp == length)
        assert common[i] <= lcp and (lcp - common[i] < symbol)


def test_repeats_odd_rows(odd):
    got = bwt_dedup.remove_repeats(clash(odd), with_text=True).collect()
    assert len(got) == odd.count()
    assert sum(r["n_removed"] > 0 for r in got) >= 5
    assert bwt_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_kept_text_has_whole_characters():
    raw = "aé中b".encode()
    assert bwt_dedup._whole_characters(raw, [(2, 5)]) == "aé中b"
    assert bwt_dedup._whole_characters(raw, [(1, 6)]) == "ab"


# ------------------------------------------------------------------ near-duplicates
def plain_print(text, width=4):
    from xxhash import xxh64_intdigest
    w = WORD.findall(lower(text))
    sh = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: list of (id, fingerprint) -> component id by row."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    low: dict = {}
    for k, (i, _) in enumerate(prints):
        low.setdefault(find(k), []).append(i)
    return [min((x for x in low[find(k)] if x is not None), default=None) for k in range(len(prints))]


def near_copies(seed=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    return out


def test_components_match_plain_search(odd, make):
    docs = odd.unionByName(make([(i + 100, t) for i, t in enumerate(near_copies())]))
    data = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    got = simhash_vp.near_duplicates(clash(docs)).collect()
    want = [(i, fp - (1 << 64) if fp >> 63 else fp, c) for (i, fp), c in zip(data, plain_components(data))]
    same([(r["doc_id"], r["fp"], r["component_id"]) for r in got], want)


def test_large_shards_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63, 40)
    prints = {int(b) for b in base}
    for b in base[:6]:
        for _ in range(60):
            x = int(b) & (1 << 64) - 1
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = plain_components([(p, p & (1 << 64) - 1) for p in prints])
    for most in (8192, 20):
        roots = {r["u"]: r["root"] for r in simhash_vp.components(simhash_vp.links(df, max_shard=most)).collect()}
        assert [roots.get(p, p) for p in prints] == want


def test_dense_clusters_meet_in_blocks(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    while len(prints) < 400:
        x = base
        for bit in rng.choice(62, int(rng.integers(1, 4)), replace=False).tolist():
            x ^= 1 << bit
        prints.add(x)
    prints |= {base ^ (0x3FF << 20), base ^ (0x1FF << 30)}
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    sizes = simhash_vp.shards_of(df, max_shard=90, max_levels=1).groupBy("g").count()
    assert sizes.agg(F.max("count")).first()[0] <= 90
    found = simhash_vp.components(simhash_vp.links(df, max_shard=90, max_levels=1))
    roots = {r["u"]: r["root"] for r in found.collect()}
    assert [roots.get(p, p) for p in sorted(prints)] == plain_components([(p, p) for p in sorted(prints)])


def test_tree_hands_out_hits_by_leaf():
    p = np.array([1 << i | 1 << j for i in range(40) for j in range(i)])    # all within 4 bits of each other
    got = list(simhash_vp.VPTree(p).hits(np.arange(len(p)), 4))
    assert sum(len(a) for a, _ in got) == len(p) ** 2
    assert max(len(a) for a, _ in got) <= len(p) * simhash_vp.LEAF
    assert (simhash_vp.forest(p, 4)[1] == p.min()).all()


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    p = np.unique(np.concatenate((rng.integers(0, 1 << 20, 3000), rng.integers(-2**63, 2**63, 500))))
    a, b = simhash_vp.VPTree(p).near(np.arange(len(p)), 2)
    u = p.view(np.uint64)
    x, y = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(x.tolist(), y.tolist()) if i != j}


def test_near_duplicates_of_nothing(make):
    assert simhash_vp.near_duplicates(make([(1, "a")]).limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup",
                                        "benchmark_decontamination", "bpe_encoding"]
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test-" + name)
        assert docs.columns == list(p.COLUMNS)
        after = docs.count()
        assert after <= before and (after < before or name == "suffix_array_dedup")
        before = after
        if name == "simhash_near_dedup":
            prints = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
            assert plain_components(prints) == [i for i, _ in prints]
        if name == "suffix_array_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert p.STAGES[-1][1](spark, docs, SF).count() == before


def plain_cut(rows, length=100):
    """The texts of (id, text) rows in order without their repeats, spans narrowed to whole characters."""
    seen = set()
    for i, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        out, at = b"", 0
        for m in re.finditer(b"\1+", bytes(gone)):
            lo, hi = m.span()
            while lo < hi and b[lo] & 0xC0 == 0x80:
                lo += 1
            while lo < hi < len(b) and b[hi] & 0xC0 == 0x80:
                hi -= 1
            out, at = out + b[at:lo], hi
        yield i, (out + b[at:]).decode()


def plain_contaminated(text, windows):
    """Whether windows (sets of word tuples by length) hit a twentieth of the words."""
    words, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set()
    for n, known in windows.items():
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in known:
                hit.update(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def test_pipeline_rows_equal_plain_stages(spark):
    """run()'s rows against every stage in plain Python, from the classifier's verdicts on."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [r["doc_id"] for r in queries.op8_quality_classifier(spark, SF).collect() if r["predicted"]]
    prints = [(i, plain_print(docs[i])) for i in sorted(good)]
    firsts = sorted(set(plain_components(prints)))
    cut = dict(plain_cut([(i, docs[i]) for i in firsts]))
    assert any(cut[i] != docs[i] for i in firsts)
    windows: dict = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[k:k + n]))
    clean = {i: t for i, t in cut.items() if not plain_contaminated(t, windows)}
    assert len(clean) < len(cut)
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = p.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    same(got, want)


def test_pipeline_leaves_its_last_rows_only(spark, tmp_path):
    import os

    import corpus_pipeline as p
    from stockspark.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, tables = set(os.listdir(root)), {t.name for t in spark.catalog.listTables()}
    out = p.run(spark, SF)
    new = {x for x in set(os.listdir(root)) - before if x.startswith("llm")}
    assert len(new) == 1 and new.pop().startswith("llm-stage-bpe_encoding")
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert out.count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p
    docs = clash(odd)
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        docs = staged(out, "odd-" + name)
        assert name == "bpe_encoding" or docs.columns == list(p.COLUMNS)
    empty = odd.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_rows_in_the_passage_stage(spark, make):
    import corpus_pipeline as p
    rng = random.Random(8)
    one, two = ("".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(2))
    docs = make([(3, one), (3, one), (4, two), (4, two), (4, two), (None, "n"), (None, "n"), (5, None), (5, ""), (6, "x" + one)])
    docs = docs.withColumn("lang", F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")))
    got = p.cut_repeated_passages(spark, docs, SF)
    assert got.dtypes == docs.select(*p.COLUMNS).dtypes
    same([(r["doc_id"], r["text"]) for r in got.collect()],
         [(3, one), (3, ""), (4, two), (4, ""), (4, ""), (None, "n"), (None, "n"), (5, None), (5, ""), (6, "x")])
    before = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    assert all((r["lang"], r["source"]) == before[r["doc_id"]] and r["n_chars"] == len(r["text"] or "") for r in got.collect())


def test_one_row_of_each_component_stays(make):
    docs = make([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z y x w v u"), (None, "z y x w v u"),
                 (None, "q r s t u v w"), (7, None), (8, "")])
    got = simhash_vp.keep_first(docs, tuple(docs.columns)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(
        [(1, "a b c d e f"), (None, "z y x w v u"), (None, "q r s t u v w"), (7, None)], key=str)
