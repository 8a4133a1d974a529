"""The contracts' queries: each reads its whole table and applies one operator.

``ORACLE`` has DuckDB SQL where SQL can express the result; the other queries
are tested against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm import (
    anchor_dedup, bpe_index, bwt_dedup, collocations, decontamination, html_main, langid, ngram_trie, quality_rules,
    rule_ensemble, simhash_vp, spelling_forms, token_store,
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule bitmask ledger of all documents under the ``base`` and ``v1`` policies."""
    led = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"),
                      "fail_bits")


def items_digest(hits: DataFrame) -> DataFrame:
    """doc_id ... contaminated, with the contract's digest of the item ids."""
    keep = ["doc_id", "n_words", "n_hit", "n_items", "contaminated"]
    joined = hits.withColumn("items_sha256", F.sha2(F.concat_ws(",", F.sort_array("items")), 256))
    return joined.select(*keep, "items_sha256")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    hits = decontamination.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return items_digest(decontamination.verdict(hits))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_main.extract(read(spark, sf_dir, "pages"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return bpe_index.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to range-ANS files and read them back."""
    store = token_store.write_store(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_store.read_store(spark, store)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents."""
    return ngram_trie.score_documents(read(spark, sf_dir, "documents"), order=3)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return rule_ensemble.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from all documents."""
    return bwt_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=100).drop("spans")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    out = simhash_vp.near_duplicates(read(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 13 words removed from all documents."""
    return anchor_dedup.find_repeats(read(spark, sf_dir, "documents"), window=13).drop("repeats")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their more frequent near words."""
    return spelling_forms.spelling_forms(read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two to five words."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_benchmark_decontamination, op3_html_extraction, op4_bpe_encoding, op5_token_store,
    op6_language_id, op7_lm_scoring, op8_quality_classifier, op9_suffix_dedup, op10_simhash_dedup,
    op11_substring_dedup, op12_spelling_variants, op13_phrase_collocations)}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# op1: words and lines with DuckDB's list functions; a window's words count once each.
_OP1 = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, regexp_extract_all(t, '[^\n]+') ls from d),
tri as (select rid, unnest(range(1, len(ws) - 1)) i, ws from w),
tri2 as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) n from tri),
rep as (select rid, count(distinct i + k) n from tri2, (values (0), (1), (2)) v(k) where n > 1 group by rid),
ln as (select rid, unnest(ls) l from w),
dup as (select rid, count(*) - count(distinct l) n from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
sw as (select rid, unnest(ws) x from w),
sy as (select rid, count(*) filter (where regexp_matches(x, '[#*$%&|<>]$')) s,
              count(*) filter (where ends_with(x, '!!')) b from sw group by rid),
m as (select w.doc_id, len(ws)::bigint n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
             coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
             coalesce(length(regexp_replace(t, '[^A-Z]', '', 'g')), 0) up,
             coalesce(length(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')), 0) letters,
             length(regexp_replace(t, '[^0-9]', '', 'g')) digits,
             (select count(*) from (select unnest(ls) l) where regexp_matches(l, '[^\x20\x09-\x0D]')) n_lines,
             (select count(*) from (select unnest(ls) l) where regexp_matches(l, '[.!?":;)\]…»”][\x20\x09-\x0D]*$')) ended,
             coalesce(sy.s, 0) n_sym_words, coalesce(sy.b, 0) n_bang
      from w left join rep using (rid) left join dup using (rid) left join sy using (rid)),
r as (select *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_sym_words > 20 * n_words,
                 100 * n_symbols > 10 * word_chars, 100 * n_bang > 20 * n_words, 100 * up > 50 * letters,
                 100 * n_dup_lines > 30 * n_lines, 100 * digits > 30 * word_chars, 100 * letters < 50 * word_chars,
                 word_chars > 25 * n_words or word_chars < 2 * n_words, n_lines >= 3 and 100 * ended < 10 * n_lines] f
      from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] or f[2] base_failed,
       not (f[1] or f[2] or f[3] or f[4] or f[5]) kept,
       (@BITS@)::bigint fail_bits
from r""".replace("@BITS@", " + ".join(f"case when f[{i + 1}] then {1 << i} else 0 end" for i in range(11)))

# op2: windows of the items joined with the windows of the documents of the same number of words.
_OP2 = rf"""
with iw as (select item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
            from benchmark),
pat as (select distinct item_id, least(len(ws), 13) n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') p
        from (select item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) i from iw where len(ws) > 0)),
dw as (select row_number() over () rid, doc_id,
              regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
win as (select rid, l.n, i, array_to_string(ws[i:i + l.n - 1], ' ') p
        from (select rid, ws, unnest(range(1, len(ws) + 1)) i from dw) d, (select distinct n from pat) l
        where i + l.n - 1 <= len(ws)),
hit as (select rid, item_id, i, n from win join pat using (n, p)),
words as (select rid, count(distinct i + k) n_hit from (select rid, i, unnest(range(0, n)) k from hit) group by rid),
items as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids
          from hit group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from dw left join words using (rid) left join items using (rid)"""

# op11: every window with the smallest doc_id that holds it.
_OP11 = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws
           from documents),
win as (select rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') p
        from (select rid, doc_id, ws, unnest(range(1, len(ws) - 11)) i from d)),
first as (select p, min(doc_id) m from win group by p),
gone as (select distinct rid, i + k i from win join first using (p), (select unnest(range(0, 13)) k) where m < doc_id),
w as (select rid, i, ws[i] x from (select rid, ws, unnest(range(1, len(ws) + 1)) i from d)),
kept as (select rid, string_agg(x, ' ' order by i) t from w anti join gone using (rid, i) group by rid),
n as (select rid, count(*) n from gone group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (rid) left join n using (rid)"""

# op13: all n-grams as lists; the cuts of every candidate in 128-bit integers.
_OP13 = rf"""
with d as (select coalesce(lang, 'und') lang, {_AZ.format("coalesce(text, '')")} t from documents),
p as (select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') ws from d),
g as (select lang, ws[i:i + k - 1] g
      from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from p, (select unnest(range(1, 6)) k))),
f as (select lang, g, count(*) f from g group by lang, g having count(*) >= 100),
tot as (select lang, sum(len(ws))::hugeint n from p group by lang),
cuts as (select c.lang, c.g, c.f a, k, a.f l, b.f r, n, (1000::hugeint * c.f * n) // (a.f::hugeint * b.f) score
         from (select lang, g, f, unnest(range(1, len(g))) k from f where len(g) > 1) c
              join f a on a.lang = c.lang and a.g = c.g[1:k] join f b on b.lang = c.lang and b.g = c.g[k + 1:]
              join tot on tot.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
held as (select lang, s, max(f) f
         from (select lang, f, g[i:i + m - 1] s
               from (select lang, f, g, m, unnest(range(1, len(g) - m + 2)) i
                     from f, (select unnest(range(2, 5)) m) where m < len(g))) group by lang, s),
kept as (select best.* from best left join held h on h.lang = best.lang and h.s = best.g
         where h.f is null or h.f < best.a),
named as (select lang, array_to_string(g, ' ') phrase, a, l, r, n, score from kept),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from named)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from ranked where rank <= 2000"""

ORACLE = {"op1_quality_rules": _OP1, "op2_benchmark_decontamination": _OP2, "op11_substring_dedup": _OP11,
          "op13_phrase_collocations": _OP13}
