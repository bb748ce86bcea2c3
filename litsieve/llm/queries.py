"""Registered queries of the corpus operators, with production parameters over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import (
    decontaminate, exact_dedup, html_templates, jaccard_join, language, line_dedup, merkle, mixing, phrases, quality_rules, secret_ledger,
    token_files, url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha256(text):
    return F.sha2(text, 256)


@query
def op1_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_line_dedup(spark, folder):
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept_text")).alias("kept_sha256"))


@query
def op3_exact_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_token_files(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    root, files = token_files.write_tokens(docs, tokenizer_path(), end_id=1)
    return token_files.read_documents(spark, root, files, docs.schema["doc_id"].dataType.simpleString())


@query
def op5_mix(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    found = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op6_html_templates(spark, folder):
    found = html_templates.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_jaccard_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = jaccard_join.jaccard_components(docs, n=4, num=85, den=100)
    return found.select("doc_id", F.col("n_ngrams").alias("n_shingles"), F.col("component").alias("component_id"))


URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op8_url_rules(spark, folder):
    """A page is labelled by the document that its url numbers; a document of quality 0 is bad."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(url_rules.url_path(F.col("url")), "/([0-9]{1,18})(?:[./]|$)", 1)
    numbered = pages.select("url", number.alias("nr")).filter("nr <> ''")
    named = numbered.select("url", F.col("nr").cast("long").alias("doc_id"))
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    labelled = named.join(labels, "doc_id").select("url", "bad")
    return url_rules.filter_urls(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op9_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id")))
    found = quality_rules.score_documents(docs, labels, threshold=0.3)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_secret_ledger(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_ledger.find_secrets(docs)
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = [r.name for r in secret_ledger.BASE]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in base),
        _sha256(F.array_join(F.transform(own, name), ",")).alias("base_sha256"),
        F.array_join(F.transform("found", name), ",").alias("spans"),
    )


@query
def op11_collocations(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "text")
    return phrases.collocations(docs, longest=4, least=30, scale=2_000_000, cover=80, top=2000)


@query
def op12_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    found = language.identify(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op13_merkle(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"), fanout=16)
