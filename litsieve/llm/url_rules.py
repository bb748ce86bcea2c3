"""URL filters: curated rules, and rules that FP-growth mines from labelled urls.

A url becomes a set of tokens: scheme, host labels, directory names, words of the last segment, file ending, names of
query keys. FP-growth finds the token sets of any size that are frequent among labelled urls with and without the mark of
a bad url. A set is a rule when enough of the urls that hold it are bad (confidence) and enough bad
urls hold it (support: a share of the labelled urls, and 5 urls at least), and without any one of its tokens it is less sure. Rules match through an
inverted index: each rule is listed under its rarest token, so a url is compared only with rules
listed under its own tokens.

Two things keep the number of sets down without losing a rule. Tokens that too few bad urls hold are left
out, as no rule can hold them. Tokens that the same urls hold, as the words of a slug that repeats, are mined as one, since a
set with two of them is no surer than with one; each of them stands for it in a rule of its own.

The curated rules win over mined ones. Null urls have an empty host and path, no tokens and the default
verdict. Without labels nothing is mined. Repeated rows get equal verdicts. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm.html_templates import url_host
from litsieve.session import materialize, small_side

BAD = "bad:"
#: Labelled bad urls that must hold a rule, whatever share of a small table they are.
MIN_BAD_URLS = 5


def url_path(url: Column) -> Column:
    """Behind the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens. Numbers in them are written as 0, so that they can repeat."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = url_path(low)
    last = F.regexp_replace(F.regexp_extract(path, "/([^/]+)$", 1), "[.][a-z0-9]+$", "")
    marked = lambda mark, found: F.transform(found, lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    parts = [
        marked("scheme:", F.regexp_extract_all(low, F.lit("^([a-z]+)://"), 1)),
        marked("host:", F.split(url_host(low), "[.]")),
        marked("dir:", F.regexp_extract_all(path, F.lit("/([^/]*[a-z][^/.]*)(?=/)"), 1)),
        marked("word:", F.regexp_extract_all(last, F.lit(r"([\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*)"), 1)),
        marked("end:", F.regexp_extract_all(path, F.lit("[.]([a-z0-9]+)$"), 1)),
        marked("key:", F.regexp_extract_all(low, F.lit("[?&]([^=&#]+)"), 1)),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: ~x.endswith(":")))


def _key(items: Column) -> Column:
    return F.array_join(F.array_sort(items), "\n")


def _merged(marked: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that at least ``least`` bad urls hold; tokens that the same urls hold share an item."""
    found = marked.select("items", F.xxhash64(_key(F.col("items"))).alias("h")).groupBy("h").agg(F.first("items").alias("items"), F.count("*").alias("n"))
    sums = [F.sum(F.col("n") * F.shiftright("h", by).bitwiseAND(F.lit(0x3FFFFFFF))).alias(f"s{by}") for by in (0, 30)]
    held = found.withColumn("bad", F.when(F.array_contains("items", BAD), F.col("n")).otherwise(F.lit(0)))
    tokens = held.select("h", "n", "bad", F.explode("items").alias("token")).filter(F.col("token") != BAD)
    counts = tokens.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("bad").alias("freq_bad"), *sums).filter(F.col("freq_bad") >= least)
    alike = counts.groupBy("freq", "freq_bad", "s0", "s30").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return alike.select(F.explode("tokens").alias("token"), "item", "freq")


def mine_rules(
    labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.8, min_bad_urls: int = MIN_BAD_URLS
) -> DataFrame:
    """(items, confidence, support, token) from (tokens, bad): pruned rules, each under its rarest token."""
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "items array<string>, confidence double, support double, token string")
    marked = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    marked = materialize(marked.filter(F.size("items") > 0), "transactions")
    n = marked.count()
    least = max(1, min_bad_urls, math.ceil(min_support * n))
    merged = materialize(_merged(marked, least), "merged")
    if not n or merged.isEmpty():
        return none
    urls = marked.withColumn("url_nr", F.monotonically_increasing_id())
    long = urls.select("url_nr", F.explode("items").alias("token")).join(small_side(merged.select("token", "item")), "token", "left")
    item = F.when(F.col("token") == BAD, F.lit(BAD)).otherwise(F.col("item"))
    mined = materialize(long.groupBy("url_nr").agg(F.collect_set(item).alias("items")).filter(F.size("items") > 0).select("items"), "mined_urls")
    # the share is of all urls, also of those without a token left
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / mined.count()), minConfidence=1.0).fit(mined).freqItemsets
    sets = materialize(sets, "itemsets")
    bad = F.array_contains("items", BAD)
    whole = sets.filter(~bad).select("items", F.col("freq").alias("n_all"), _key(F.col("items")).alias("key"))
    hits = sets.filter(bad & (F.size("items") > 1)).select(
        F.col("freq").alias("n_bad"), _key(F.array_remove("items", BAD)).alias("key")
    )
    rules = whole.join(hits, "key").withColumn("confidence", F.col("n_bad") / F.col("n_all")).filter(F.col("confidence") >= min_confidence)
    rules = materialize(rules.withColumn("support", F.col("n_bad") / n), "rules")
    # a rule goes when it is as sure without one of its tokens
    parts = F.transform("items", lambda x: _key(F.array_remove("items", x)))
    listed = rules.select("key", "confidence", F.explode(parts).alias("part"))
    known = rules.select(F.col("key").alias("part"), F.col("confidence").alias("sure"))
    weaker = listed.join(known, "part").filter("sure >= confidence").select("key").distinct()
    kept = rules.join(weaker, "key", "left_anti")
    # an item is written as each of its tokens, which are equally frequent
    alike = merged.groupBy("item").agg(F.collect_list("token").alias("tokens"), F.first("freq").alias("freq"))
    tokens = kept.select("key", "confidence", "support", F.explode("items").alias("item")).join(alike, "item")
    rows = tokens.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("freq", "item", "tokens"))).alias("held"), F.first("confidence").alias("confidence"), F.first("support").alias("support")
    )
    start = F.array(F.array().cast("array<string>"))
    sets = F.aggregate(
        F.transform("held", lambda x: x["tokens"]), start,
        lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.concat(d, F.array(t))))),
    )
    # the rarest comes first
    return rows.select(F.explode(sets).alias("items"), "confidence", "support").withColumn("token", F.col("items")[0])


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): distinct urls of ``urls`` (url, tokens) that hold all tokens of some rule."""
    index = small_side(rules.select(F.col("token").alias("listed"), "items"), text_width=128)
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, F.col("token") == F.col("listed"))
    return looked.filter(F.size(F.array_except("items", "tokens")) == 0).select("url").distinct()


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path); null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, domain, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(begin)
        name, verdict = F.when(fits, F.lit(domain + begin)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.001, min_confidence: float = 0.8, min_bad_urls: int = MIN_BAD_URLS,
) -> DataFrame:
    """(id, url, host, path, rule, verdict) of every page; ``labelled`` has (url, bad).

    ``rules`` are a short curated list, written into the query; mined rules are joined.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    known = labelled.select(url_tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    mined = materialize(mine_rules(known, min_support, min_confidence, min_bad_urls), "mined")
    blocked = materialize(matches(rows.select("url", url_tokens(F.col("url")).alias("tokens")), mined), "blocked")
    joined = rows.join(small_side(blocked.withColumnRenamed("url", "bad_url"), text_width=128), F.col("url") == F.col("bad_url"), "left")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_url").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    placed = joined.select("id", "url", host.alias("host"), path.alias("path"), method.alias("method"))
    return placed.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", name.alias("rule"), F.coalesce(verdict, "method").alias("verdict")
    )
