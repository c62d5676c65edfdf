"""URL filters by host-suffix and path-prefix expressions.

Every url is expanded into the expressions that some rule could have: its host's suffixes at label
boundaries, each with its path's prefixes, of those (host length, path length) shapes that the rule set
holds. An expression meets the rules in an equi-join on the first four bytes of a SHA-256 digest; the full
digests then confirm the match, and of the confirmed rules the longest decides.

The shapes come from the rules alone, so a url makes at most as many expressions as there are shapes
(a few hundred for real block lists), whatever its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Bytes of the digest in the equi-join.
PREFIX_BYTES = 4
#: Rules up to this many are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
RULES_SCHEMA = "host string, path string, action string"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default_action: str = "allow",
    no_host_action: str = "block",
) -> DataFrame:
    """Judge each url: id_col, host, path, rule, verdict, n_expressions.

    rules has host, path and action ("allow" or "block"). A rule fits its host and all subdomains if the
    url's path starts with its path. The longest rule string decides; among equally long ones the longer
    host, then "block", then the smaller string. Where no rule fits, default_action holds, or no_host_action
    where the url has no host (null, or without "://"): nothing can vouch for it.

    Repeated rows are each judged, null ids stay, other columns of pages are not read. Rules with a null
    host, path or action never fit. An empty rule set gives the default everywhere; empty pages give no rows.
    """
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_action").alias("r_action"))
    )
    sized = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p")))).alias("shapes"),
    ).first()
    keyed = rules.select(
        _digest(F.concat("r_host", F.lit("\n"), "r_path")).alias("r_full"), "r_host", "r_path", "r_action"
    ).select(F.substring("r_full", 1, 2 * PREFIX_BYTES).alias("r_key"), "r_full", "r_host", "r_path", "r_action")

    urls = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .groupBy("id", "url")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    shapes = [F.struct(F.lit(s["h"]).alias("h"), F.lit(s["p"]).alias("p")) for s in sized["shapes"]]
    shapes = F.array(*shapes) if shapes else F.array().cast("array<struct<h:int,p:int>>")
    fits = "s.p <= length(path) and (s.h = length(host) or s.h < length(host) and substring(host, length(host) - s.h, 1) = '.')"
    asked = (
        urls.withColumn("shapes", shapes)
        .withColumn("shapes", F.expr(f"filter(shapes, s -> {fits})"))
        .withColumn("n_expressions", F.size("shapes").cast("long"))
        .select("id", "url", "n_rows", "host", "path", "n_expressions", F.explode_outer("shapes").alias("s"))
        .withColumn("full", _digest(F.expr("concat(right(host, s.h), '\n', left(path, s.p))")))
        .drop("s")
        .withColumn("key", F.substring("full", 1, 2 * PREFIX_BYTES))
    )
    known = F.broadcast(keyed) if sized["n"] <= BROADCAST_RULES else keyed
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        F.col("r_action").alias("action"),
        F.concat("r_host", "r_path").alias("rule"),
    )
    return (
        asked.join(known, F.col("key") == F.col("r_key"), "left")
        .groupBy("id", "url", "n_rows", "host", "path", "n_expressions")
        .agg(F.max(F.when(F.col("full") == F.col("r_full"), rank)).alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.when(F.col("host") == "", no_host_action).otherwise(default_action)).alias("verdict"),
            "n_expressions",
        )
    )
