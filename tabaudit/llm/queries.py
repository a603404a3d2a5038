"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tabaudit.functions.storage import scratch_path
from tabaudit.llm import (
    byte_bpe,
    decision_list,
    discriminant,
    html_text,
    lexical_search,
    multiset_hash,
    packing,
    phrases,
    sequence_files,
    signature_join,
    token_histogram,
    toxicity,
    warc,
)
from tabaudit.llm.catalog import query
from tabaudit.llm.tokens import vocabulary

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary(WORD_VOCABULARY), capacity=2048, end_id=0)


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op4_sequence_files")
def op4_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "sequences")
    return sequence_files.read_documents(sequence_files.write_sequences(docs, folder, vocabulary(WORD_VOCABULARY), end_id=2))


@query("op5_multiset_fingerprints")
def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_with_edit(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(BYTE_RANKS)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, with_digest=True)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded_bytes", 256).alias("decoded_sha256")
    )


def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each page: its full response, and a later not-modified answer under another spelling of its URL.

    Every fifth answer has another entity tag, every seventh has only a date, every eleventh
    came before all responses, and every thirteenth has no validator.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    number, digest = F.col("page_id"), F.col("digest")

    def tag(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    full = pages.select(
        (2 * number).alias("record_id"),
        "url",
        F.lit("response").alias("kind"),
        (10 * number).alias("captured_at"),
        tag(digest).alias("etag"),
        F.concat(F.lit("day "), number % 365).alias("last_modified"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag(digest), F.lit("date"), (10 * number).cast("string"),
            F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    later = F.when(number % 11 == 0, F.lit(-1)).otherwise(10 * number + 3 + number % 1000)
    answer_tag = (
        F.when((number % 13 == 0) | (number % 7 == 0), F.lit(None).cast("string"))
        .when(number % 5 == 0, tag(F.reverse(digest)))
        .otherwise(F.concat(F.lit("W/"), tag(digest)))
    )
    answer_date = F.when(number % 13 != 0, F.concat(F.lit("day "), number % 365))
    answers = pages.select(
        (2 * number + 1).alias("record_id"),
        F.when(number % 3 == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).otherwise(F.regexp_replace("url", "^https?", "HTTPS")).alias("url"),
        F.lit("revisit").alias("kind"),
        later.alias("captured_at"),
        answer_tag.alias("etag"),
        answer_date.alias("last_modified"),
        F.create_map(
            F.lit("content-type"), F.lit("application/http"), F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"),
            F.lit("cache-control"), F.lit("max-age=90"),
        ).alias("headers"),
    )
    return full.unionByName(answers)


# The same records and rules in SQL; headers are compared by the fields that the records have.
OP7_SQL = """
with p as (select page_id as n, url, md5(coalesce(html, '')) as digest from pages),
records as (
  select 2 * n as record_id, url, 'response' as kind, 10 * n as captured_at, '"' || digest || '"' as etag,
    'day ' || (n % 365) as last_modified from p
  union all
  select 2 * n + 1,
    case when n % 3 = 0 then regexp_replace(url, '#.*$', '') || '#again' else regexp_replace(url, '^https?', 'HTTPS') end,
    'revisit', case when n % 11 = 0 then -1 else 10 * n + 3 + n % 1000 end,
    case when n % 13 = 0 or n % 7 = 0 then null when n % 5 = 0 then '"' || reverse(digest) || '"' else 'W/"' || digest || '"' end,
    case when n % 13 <> 0 then 'day ' || (n % 365) end
  from p),
plain as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as u from records),
parts as (
  select *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', '') as host,
    regexp_replace(u, '^[^/?]*', '') as rest from plain),
cut as (
  select *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') as path,
    regexp_replace(regexp_replace(regexp_extract(rest, '[?](.*)$', 1), '(^|&)(utm_[a-z_]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') as q
  from parts),
named as (select *, host || path || case when q <> '' then '?' || q else '' end as canonical_url from cut),
best as (
  select v.record_id, max((r.captured_at, r.record_id)) as m
  from named v join named r on v.canonical_url = r.canonical_url and r.captured_at < v.captured_at
  where v.kind = 'revisit' and r.kind = 'response' group by 1),
matched as (
  select v.record_id as revisit_id, v.canonical_url, v.captured_at, r.record_id as response_id, r.captured_at as response_at,
    r.etag as response_etag,
    coalesce(regexp_replace(v.etag, '^W/', '') = regexp_replace(r.etag, '^W/', ''), v.last_modified = r.last_modified) as agree
  from named v left join best b on b.record_id = v.record_id
  left join named r on r.kind = 'response' and r.record_id = b.m[2]
  where v.kind = 'revisit')
select revisit_id, canonical_url, captured_at, coalesce(response_id, -1) as response_id, coalesce(response_at, -1) as response_at,
  case when response_id is null then 'no earlier response' when agree is null then 'unverified' when agree then 'resolved' else 'validator mismatch' end as status,
  case when agree then 'text/html' else 'application/http' end as content_type,
  case when agree then response_etag end as etag, cast(captured_at as varchar) as date, 'max-age=90' as cache_control,
  case when not coalesce(agree, false) then '0' end as content_length
from matched
"""


@query("op7_revisit_resolution", OP7_SQL)
def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_records(spark, sf_dir))
    fields = ("content-type", "etag", "date", "cache-control", "content-length")
    return found.select(
        "revisit_id", "canonical_url", "captured_at", "status",
        *[F.coalesce(F.col(name), F.lit(-1)).alias(name) for name in ("response_id", "response_at")],
        *[F.col("headers")[name].alias(name.replace("-", "_")) for name in fields],
    )


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_histogram.suffix_sums(token_histogram.length_histogram(docs, vocabulary(WORD_VOCABULARY)))


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
q as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
sizes as (select doc_id, len(t) as n from d),
whole as (select count(*) filter (n > 0) as big_n, coalesce(cast(sum(n) as bigint), 0) as big_l from sizes),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from d) group by 1, 2),
w as (
  select term, cast(floor(1000 * ln((2 * max(big_n) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, whole group by term),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(t) as term from q) group by 1, 2),
scores as (
  select item_id, tf.doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) as bigint) as score
  from asked join tf using (term) join w using (term) join sizes on sizes.doc_id = tf.doc_id, whole group by 1, 2),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 10
"""


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), {_ASCII_LOWER}), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest([1, 2, 3, 4]) as k)),
f as (
  select lang, k, p, count(*) as a from (select lang, k, w[i : i + k - 1] as p from starts) group by lang, k, p having count(*) >= 30),
longer as (select * from f where k > 1),
cuts as (
  select c.lang, c.p, c.a, cut, l.a as l, r.a as r, cast(cast(c.a as hugeint) * 2000000 // (l.a + r.a) as bigint) as score
  from (select *, unnest(range(1, k)) as cut from longer) c
  join f l on l.lang = c.lang and l.p = c.p[1 : cut]
  join f r on r.lang = c.lang and r.p = c.p[cut + 1 :]),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
inside as (
  select lang, w[i : i + size - 1] as p, max(a) as whole
  from (select lang, p as w, a, size, unnest(range(1, k - size + 2)) as i
        from longer, (select unnest([2, 3]) as size) where size < k) group by 1, 2),
kept as (
  select b.*, array_to_string(b.p, ' ') as phrase from best b left join inside i on i.lang = b.lang and i.p = b.p
  where i.whole is null or 100 * i.whole < 80 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
