"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm import bpe, chat, decontaminate, html, language, licenses, neardup, quality, substrings, urlfilter
from metrolith.llm._spark import read

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    out = language.identify(docs.select("doc_id", "text"), docs.filter(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern that splits a text."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *tokenizer(), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.digests(substrings.dedup_substrings(docs, window=20))


#: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES, urlfilter.listed_by_digest(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10, spans=True)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "hits")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return chat.digests(chat.format_windows(turns.unionByName(more), count=bpe.TokenCounter(spark, *tokenizer())))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for n, f in globals().items() if n.startswith("op") and n[2:3].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


def _longest(value) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(f"when {_fits(h, p)} then '{value(v, h, p)}'" for v, h, p in rules)


SQL: dict[str, str] = {
    "op4_url_filter": f"""
        select page_id, host, path, case {_longest(lambda v, h, p: h + p)} end as rule,
               case {_longest(lambda v, h, p: v)}
                    when len(list_filter(list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')), lambda d: md5(d) < '1')) > 0
                    then 'block' else 'allow' end as verdict
        from (select page_id, {_HOST} as host, {_PATH} as path from pages)""",
}
