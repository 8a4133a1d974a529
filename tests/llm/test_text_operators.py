"""Rules, decontamination, pages, tokenizing and the token store against plain versions."""
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockspark.llm import bpe_index, decontamination, html_main, quality_rules, queries, token_store
from stockspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def clash(df):
    """Extra columns named like results and helpers."""
    for c in ("n_words", "score", "fp", "part", "block", "spans", "row", "ids", "fail_bits", "h", "root"):
        df = df.withColumn(c, F.lit("x"))
    return df


def plain_rules(text):
    words = WORD.findall(text or "")
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    covered = {k for i, t in enumerate(tri) if often[t] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules_match_plain_counts(odd):
    got = quality_rules.ledger(clash(odd)).collect()
    want = [(r["doc_id"], *plain_rules(r["text"])) for r in odd.collect()]
    assert quality_rules.ledger(odd.limit(0)).count() == 0
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
          for r in got], want)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert failed == bool(r["fail_bits"] & quality_rules.mask_of("base"))


def test_ablations_recount_the_ledger(spark):
    led = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r["fail_bits"] & quality_rules.mask_of("v2") for r in led.collect()]
    names = [r.name for r in quality_rules.RULES]
    for r in quality_rules.ablations(led, "v2").collect():
        bit = 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_failed_only_this"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(not b & ~bit for b in bits)


def plain_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = fold(text), set(), set()
    for i, t in items:
        w = fold(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[k:k + n]:
                    hit.update(range(at, at + n))
                    ids |= set() if i is None else {str(i)}
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_matches_plain_search(spark, make):
    long_item = " ".join(f"w{i}" for i in range(20))
    items = [(1, long_item), (2, "Short item"), (10, "ÜBER w3 W4"), (3, ""), (4, None), (5, "short, item!"), (None, "zz")]
    bench = clash(spark.createDataFrame(items, "item_id long, text string"))
    texts = [None, "", "...", "short ITEM, short item", "x " + " ".join(f"W{i}." for i in range(3, 19)) + " y",
             " ".join(f"w{i}" for i in range(12)), "a ÜBER; w3 w4 b", "zz", "pre short\nitem " + "t " * 300]
    docs = make(texts)
    for limit in (8 << 20, 200):       # one automaton, then several
        got = decontamination.verdict(decontamination.find_hits(clash(docs), bench, max_pattern_bytes=limit))
        rows = queries.items_digest(got).collect()
        want = {i: plain_hits(t, items) for i, t in enumerate(texts)}
        assert want[7][:3] == (1, 1, 0)             # an item without an id hits, but is in no list
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows} == want
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in rows)
        spans = {r["doc_id"]: r["byte_spans"] for r in got.collect()}
        assert [texts[6].encode()[s["a"]:s["b"]].decode() for s in spans[6]] == ["ÜBER; w3 w4"]
    long_doc = make(["t " * 400_000 + long_item])
    assert decontamination.verdict(decontamination.find_hits(long_doc, bench)).first()["n_hit"] == 20
    none = decontamination.verdict(decontamination.find_hits(docs, bench.limit(0))).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></ul></nav><!-- x <p>no</p> --><div class="cookie-banner">We use cookies, yes.</div>
<main><article class="post"><header><h2>The  &eacute;tude</h2></header><p>First para,<br>with <b>bold
text</b> &lt;kept&gt;.<p>Second <a href="/x">link</a> para.<script>var a="<p>no</p>";</script>
<ul><li>one, two<li>three; four</ul><aside>Side note.</aside><form><input value=a>Send</form>
<section id="comments"><article><p>Reader comment, long, very long.</p></article></section></article></main>
<footer>&copy; someone</footer></body></html>"""


def test_main_text_of_pages(spark):
    assert html_main.main_text(PAGE) == \
        "The étude\n\nFirst para, with bold text <kept>.\n\nSecond link para.\n\none, two\n\nthree; four"
    plain = ("<body><div id=top-menu><a href=1>A</a> <a href=2>B</a></div><div class=body><p>Some real sentence, with commas, "
             "and an end.</p><p>Another real sentence, which is long enough.</p></div><div class=footer>Imprint</div>")
    assert html_main.main_text(plain).startswith("Some real sentence") and "Imprint" not in html_main.main_text(plain)
    for broken in (None, "", "<", "<p", "<!--", "text only, no tags.", "<article><p>cut &am", "<script>var x"):
        html_main.main_text(broken)
    assert html_main.main_text("text only, no tags.") == "text only, no tags."
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")],
                                  "page_id long, url string, html string, text string")
    got = html_main.extract(pages).collect()
    assert len(got) == 3 and {r["n_chars"] for r in got} == {0, len(html_main.main_text(PAGE))}


def test_named_sections_stay_in_the_article():
    page = ('<div class="has-sidebar"><article><h1>Title</h1><p class="alert">Heed this.</p><section id="discussion"><p>Talk, talk.</p></section>'
            '<section id="related-work"><h2 id="search-strategy">Search</h2><p>Found <span id="comment-rates">rates</span>.</p></section>'
            '<div class="side-effects">Nausea, rarely.</div><p data-id="comments" title="hidden">Data.</p>'
            '<figure><img src=x><figcaption>A caption.</figcaption></figure>'
            '<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>'
            '<div class="box sidebar">Aside, aside.</div><div class="advert">Buy, buy.</div><div role="navigation">Up, up.</div>'
            '<ol><li class="comment">Reader, reader.</ol></article></div>')
    assert html_main.main_text(page).split("\n\n") == [
        "Title", "Heed this.", "Talk, talk.", "Search", "Found rates.", "Nausea, rarely.", "Data.", "A caption.", "So x=2 holds."]


def test_short_blocks_of_the_content_stay():
    long = " ".join(["A sentence with commas, as texts have them, and an end."] * 7)
    links = "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
    menu = "<nav>no</nav><div id=top-menu><a href=1>no</a> <a href=2>no</a></div>"
    foot = "<div class=site-footer>no</div><footer>no</footer>"
    inner = (f"<h1>Title</h1><p>{long}</p><p>{long}</p><ul><li>thirty characters without marks<li>item</ul><h2>Late</h2>"
             f"<table><tr><th>k<td>v<tr><td>a<td>b</table><section id=discussion><h3>More</h3><p>end</p></section>{links}")
    want = ["Title", long, long, "thirty characters without marks", "item", "Late", *"kvab", "More", "end", "One", "Two"]
    for page in (f"<body>{menu}<div class=text>{inner}</div>{foot}", f"<body>{menu}<article>{inner}</article>{foot}",
                 f"<body><table><tr><td>{menu}<td><div>{inner}</div></table>{foot}"):
        assert html_main.main_text(page).split("\n\n") == want
    parts = (f"<body>{menu}<h1>Title</h1><div><section><h2>a</h2><p>{long}</p></section><section><h2>b</h2><ul><li>c</ul>"
             f"</section></div><h2>Sources</h2>{links}{foot}")
    assert html_main.main_text(parts).split("\n\n") == ["Title", "a", long, "b", "c", "Sources", "One", "Two"]
    bare = f"<body>{menu}<p>{long}</p><h2>Late</h2>{links}<p>{long}</p><table><tr><td>x</table>{foot}"
    assert html_main.main_text(bare).split("\n\n") == [long, "Late", "One", "Two", long, "x"]


def test_scripts_with_markup_signs():
    """What looks like tags inside raw elements is no markup, before and inside the article."""
    for raw in ("<script>for(i=0;i<n;i++){t()}</script>", '<script type="application/ld+json">{"x":"x<b","y":"<p>"}</script>',
                "<SCRIPT>if(a<b&&c>d){'</scripty>'}</Script >", "<style>a<b{}</style>", "<textarea>x<y</textarea>",
                "<noscript><img src='a>b'></noscript>", "<script>a<b\n</script\n>"):
        assert html_main.main_text(f"{raw}<article><p>Body text here.</p></article>") == "Body text here.", raw
        page = f"<article><p>One.</p>{raw}<p>Two{raw} and three.</p></article>"
        assert html_main.main_text(page) == "One.\n\nTwo and three.", raw
    assert html_main.main_text("<article><p>One.</p><script>i<n") == "One."


def test_path_ratios_choose_inside_articles():
    body = ["A first paragraph, with commas, and an end.", "A second one, which is longer; it has marks, too.",
            "Third: the last of them, as it were, and done."]
    text = "".join(f"<p>{b}</p>" for b in body)
    boxes = ('<div class="share-buttons"><a href=1>Tweet</a> <a href=2>Post</a></div>', '<div class="ad-slot">Buy now</div>',
             '<div class="newsletter-signup"><h3>Stay up to date</h3>Get our news</div>', '<div class="sidebar-left"><p>Side, side.</p></div>',
             '<ul class="related-posts"><li><a href=1>Other</a><li><a href=2>More, more of it</a></ul>')
    for box in boxes:
        for page in (f"<main>{box}{text}</main>", f"<article>{text}{box}</article>", f"<main><article>{text}{box}</article></main>"):
            assert html_main.main_text(page).split("\n\n") == body, page
    kept = f'<article>{text}<div class="related-work"><p>{body[1]}</p></div></article>'
    assert html_main.main_text(kept).split("\n\n") == [*body, body[1]]
    teaser = '<article class="teaser"><h2>Another</h2><p>Read on.</p></article>'
    for page in (f"<article>{text}</article>{teaser}", f"<main><h1>Top</h1>{teaser}<article>{text}</article>{teaser}</main>"):
        assert [b for b in html_main.main_text(page).split("\n\n") if b != "Top"] == body
    assert html_main.main_text(f"<article>{text}</article><article>{text}</article>").split("\n\n") == [*body, *body]


def test_long_page_and_empty_table(spark):
    paragraph = "A long page, with a sentence that ends. "
    page = "<main>" + f"<p>{paragraph * 20}</p><script>if(a<b){{}}</script>" * 6100 + "</main>"
    assert len(page) > 5_000_000
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = html_main.extract(pages).first()["text"]
    assert got == "\n\n".join([(paragraph * 20).strip()] * 6100)
    assert html_main.extract(pages.limit(0)).count() == 0


def test_every_page_gives_its_article(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", " ", b))).strip()
                  for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()} == want


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(odd, library):
    got = bpe_index.encode_decode(clash(odd), tokenizer_path(), with_ids=True).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    same([(r["doc_id"], r["ids"], r["decoded"]) for r in got],
         [(r["doc_id"], ids, library.decode(ids, skip_special_tokens=False)) for r, ids in zip(odd.collect(), want)])
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])


def test_both_word_tables_on_random_strings(library):
    import random
    rng = random.Random(3)
    parts = ["a", "aa", " ", "  ", "\n", "\t", "'s", "'ll", "12", "½", "é", "中文", "🙂", "<|endoftext|>", "!!", " the",
             "\x1c", "\x85", "　", "\x00", "aaaa", "abab", "==", " ", "ǅ", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for table in (bpe_index.PairIndexBPE(tokenizer_path(), max_words=500), token_store.LibraryBPE(tokenizer_path(), 500)):
        got = []
        for i in range(0, len(texts), 700):
            flat, sizes = table.encode_batch(texts[i:i + 700])
            at = 0
            for n in sizes.tolist():
                got.append(flat[at:at + n].tolist())
                at += n
        assert got == want


def test_token_store_round_trip(spark, odd, library):
    import numpy as np
    store = token_store.write_store(clash(odd), tokenizer_path())
    got = token_store.read_store(spark, store).collect()
    data = odd.collect()
    ids = [e.ids + [0] for e in library.encode_batch([r["text"] or "" for r in data], add_special_tokens=False)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got],
         [(r["doc_id"], len(x), crc(x)) for r, x in zip(data, ids)])
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]
    assert at == store["n_tokens"]


def test_blocks_decode_from_checkpoints_and_tell_damage():
    import numpy as np
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.4, 1_400_000) % 500).astype(np.int64)
    tables = token_store.Tables(np.bincount(ids, minlength=600))
    data = token_store.encode_block(ids, [7, None], [150_000, 1_250_000], tables)
    block = token_store.Block(data)
    assert block.docs == [7, None] and (block.ids(tables) == ids).all()
    parts = [block.ids(tables, k, k + 1) for k in range(len(block.at))]
    assert len(parts) > 2 and (np.concatenate(parts) == ids).all()
    with pytest.raises(ValueError):
        token_store.Block(data[:-1] + bytes([data[-1] ^ 1]))


def test_empty_tables(spark, make):
    none = make([(1, "a")]).limit(0)
    assert quality_rules.ledger(none).count() == 0
    assert bpe_index.encode_decode(none, tokenizer_path()).count() == 0
    assert token_store.read_store(spark, token_store.write_store(none, tokenizer_path())).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_hits(none, bench).count() == 0
