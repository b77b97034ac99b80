"""URL rules as an equi-join of expressions on short digest prefixes.

A URL is expanded into every pair of a host suffix and a path prefix. An expression's SHA-256 is matched with
the rules' by its first 32 bits, then confirmed by the full digest. The longest rule wins; of two equally long
ones, the longer host, then a block.

Defined results: a null URL or one without `://` has an empty host and path and fits no rule; a rule with a null
host, path or verdict fits nothing; repeated rules count once, and of contradicting ones the block wins; repeated
pages are all returned; further columns of the pages stay as they are, under their names; empty tables give no
rows, or the default verdict. Hosts and paths of any length are expanded only as far as the longest rule reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower

#: Rules up to this many are broadcast; beyond it the join is shuffled.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def match_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of each url that some rule fits; urls: distinct, with column url.

    rules: host, path, verdict ('allow' or 'block'); a rule's text is its host followed by its path.
    """
    known = (
        rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2(_expression(F.col("host"), F.col("path")), 256))
    )
    # the shapes that rules have bound the expansion; each is one number
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/")))
    shape = known.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.when(F.col("path").endswith("/"), slashes)).alias("slashes"),
        F.collect_set(F.when(~F.col("path").endswith("/"), F.length("path"))).alias("lengths"),
    ).first()
    if not shape["n"]:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).where("false")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - shape["labels"] + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    depth = F.least(F.size(parts) - 1, F.lit(shape["slashes"] or 0))
    by_slash = F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    by_length = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]).cast("array<string>")
    paths = F.array_distinct(F.concat(by_slash, by_length))
    expressions = (
        urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .where("host <> ''")
        .select("url", "path", F.explode(hosts).alias("host"), paths.alias("paths"))
        .select("url", "host", F.explode("paths").alias("path"))
        .where("path is not null")
        .select("url", F.sha2(_expression(F.col("host"), F.col("path")), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, 8))
    )
    keyed = known.withColumn("short", F.substring("digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    fits = expressions.join(keyed, "short").where(F.col("full") == F.col("digest"))
    rank = F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("verdict"), F.col("rule"))
    return fits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; verdicts are found once for each distinct URL."""
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    best = match_urls(pages.select(F.col(url).alias("url")).where("url is not null").distinct(), rules)
    best = best.select(F.col("url").alias("__url"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"))
    joined = pages.select(kept).join(best, F.col(url) == F.col("__url"), "left")
    return joined.select(
        *kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict")
    )
