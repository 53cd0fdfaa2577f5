"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, html_blocks, langid, lm, minhash_dedup, token_counts, toxicity, warc_fixity
from .common import table


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).select("page_id", "url", "text", "n_chars")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), held_out_mod=5).select("doc_id", "held_out", "score", "predicted")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, held_out_mod=5).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica with planted damage: changed, cut short and lost records by rules on the id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    hurt = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("~"), body)).when(F.col("page_id") % 211 == 11, F.expr("left(coalesce(html, ''), cast(floor(char_length(coalesce(html, '')) / 2) as int))")).otherwise(body)
    replica = pages.filter("page_id % 307 <> 13").withColumn("html", hurt)
    return warc_fixity.fixity(pages, replica)


OP3_SQL = r"""
with body as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as a,
    case when page_id % 101 = 7 then '~' || coalesce(html, '')
         when page_id % 211 = 11 then left(coalesce(html, ''), cast(floor(length(coalesce(html, '')) / 2) as integer))
         else coalesce(html, '') end as b
  from pages where page_id is not null),
rec as (
  select page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) || chr(13) || chr(10) as gap, a, b
  from body),
whole as (select page_id, head || strlen(a) || gap || a || gap as ra, case when page_id % 307 <> 13 then head || strlen(b) || gap || b || gap end as rb from rec),
hashed as (select page_id, page_id // 1024 as segment, cast(strlen(ra) as bigint) as length, sha256(ra) as expected, sha256(rb) as found from whole)
select page_id, segment,
  cast(coalesce(sum(length) over (partition by segment order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
  length, expected, found,
  case when found is null then 'missing' when found = expected then 'ok' else 'changed' end as status
from hashed
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, _tokenizer("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out_mod=10)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_langid": op2_langid,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprint": op9_fingerprint,
    "op10_html": op10_html,
}
ORACLES: dict[str, str] = {"op3_warc": OP3_SQL}
