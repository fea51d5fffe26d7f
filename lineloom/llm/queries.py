"""Queries over the driver's tables, one for each operator of this package, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard_join, language_id, license_scan, lm_scoring, periodic_runs, piecewise, quality_classifier, quality_rules, sentencepiece_nbest, tiered_search, warc
from .common import table


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *(f"_s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = lm_scoring.score(docs, docs.where(~held_out(7, 2)))
    return got.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts = language_id.training_texts(docs.where(~held_out(5, 0)))
    return language_id.identify(docs, texts).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.conversations(chat.linear(rows.unionByName(more))))


def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_nbest.encode(table(spark, sf_dir, "documents"), n=4)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    others = F.array_join(F.transform("edits", lambda e: F.to_json(e)), "\n")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest(F.array_join("ids", ",")).alias("ids_sha256"), "score", "losses", digest(others).alias("others_sha256"), "lossless")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0))
    got = quality_classifier.scores(table(spark, sf_dir, "documents"), labels)
    return got.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, one in ten of them with a repeated tail."""
    return periodic_runs.report(periodic_runs.find(periodic_runs.repeated_tail(table(spark, sf_dir, "documents"))))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return tiered_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near these and the next document are."""
    return piecewise.against_next(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_license_scans, op3_quality_rules, op4_lm_scoring, op5_language_id, op6_chat_formatting,
        op7_sentencepiece_nbest, op8_quality_classifier, op9_benchmark_decontamination, op10_warc, op11_periodic_runs, op12_tiered_search, op13_piecewise_fingerprints,
    )
}

_TERMS = r"list_transform(regexp_extract_all(regexp_replace({0}, '[\x{{0}}]', ' ', 'g'), '[^\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
_ESC = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</', '\</')"
ORACLE = {
    "op6_chat_formatting": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e as (
  select *, {_ESC.format('text')} as etext, replace({_ESC.format('role')}, ':', '\\:') as erole from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(erole) + length(etext) + 15) as bigint) as formatted_chars
from e group by conv_id""",
    "op9_benchmark_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{0}]', ' ', 'g'), '[^\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w0 from documents
), dw as (
  select doc_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from d
), b as (
  select item_id, list_transform(regexp_extract_all(regexp_replace(text, '[\x{0}]', ' ', 'g'), '[^\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from benchmark where text is not null
), bw as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), lens as (select distinct k from bw
), sh as (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, lens where len(w) >= k)
), hits as (select doc_id, i, sh.k, item_id from sh join bw using (s, k)
), hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id
), hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from dw left join hit_words using (doc_id) left join hit_items using (doc_id)""",
    "op10_warc": r"""
with p as (
  select page_id, encode(coalesce(html, '')) as b, upper(sha1(encode(coalesce(html, '')))) as hex from pages
), bits as (
  select *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789ABCDEF', substr(hex, i, 1)) - 1) + 1, 4)), '') as z from p
), dig as (
  select page_id, octet_length(b) as n, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(16 * cast(substr(z, 5 * i + 1, 1) as int) + 8 * cast(substr(z, 5 * i + 2, 1) as int) + 4 * cast(substr(z, 5 * i + 3, 1) as int) + 2 * cast(substr(z, 5 * i + 4, 1) as int) + cast(substr(z, 5 * i + 5, 1) as int) as int), 1)), '') as d
  from bits
), f as (select *, min(page_id) over (partition by d, n) as first from dig)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from f""",
    "op12_tiered_search": rf"""
with d as (select doc_id, {_TERMS.format("text")} as w from documents where text is not null),
b as (select item_id, row_number() over () as i, {_TERMS.format("text")} as w from benchmark where text is not null),
g as (select count(*) as dn, cast(sum(len(w)) as bigint) as ln from d where len(w) > 0),
p as (select doc_id, t, count(*) as tf, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as t from d) group by doc_id, t),
f as (select t, count(*) as df from p group by t),
wt as (select t, cast(floor(1000 * ln((2 * dn + 2) / (2 * df + 1))) as bigint) as w from f, g),
q as (select i, item_id, t, count(*) as c from (select i, item_id, unnest(w) as t from b) group by i, item_id, t),
s as (select i, item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * dn) // ln)))) as bigint) as score from q join wt using (t) join p using (t), g group by i, item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0) where rank <= 20""",
}
