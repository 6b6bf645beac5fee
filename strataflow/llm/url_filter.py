"""URL filter with redirect equivalence.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest that fits decides. Pages
that are linked by a canonical link or a redirect are aliases of one another. A URL that no rule decides is blocked if one of
its aliases, near or far, is blocked by a rule, unless a rule allows one of them: an explicit allow takes precedence.

Defined cases: a null url, or one without "://", has an empty host and path and is allowed; a null html has no links;
repeated rows and repeated urls are rows of their own with equal verdicts; an empty table gives an empty result. Only page_id,
url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""

#: Largest table of aliases, in rows, that is broadcast after having been counted.
BROADCAST_ALIASES = 50_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def first_rule(host_col: Column, path_col: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of rules of equal length the one with
    the longer host comes first, and of those an allow."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host_col == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit("/" + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chain is None else chain


def node(url: Column) -> Column:
    """The name of a URL as an alias: scheme and host in lower case, without its fragment."""
    bare = F.regexp_replace(url, "#.*", "")
    scheme = F.regexp_extract(bare, r"^([^:/?#]*)://", 1)
    rest = F.regexp_extract(bare, r"^[^:/?#]*://[^/?#]*([\s\S]*)$", 1)
    return F.when(url.contains("://"), F.concat(F.translate(scheme, UPPER, LOWER), F.lit("://"), host(bare), rest)).otherwise(bare)


def resolve(href: Column, url: Column) -> Column:
    """A link's target as an absolute URL."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    origin = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, href))
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and root (the smallest alias; null for a page without links) of every page."""
    found = F.array_union(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    links = F.when(F.col("url").isNotNull() & F.col("html").isNotNull(), found)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"), links.alias("links"))
    rows = C.stage(rows.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules)), "urls")
    edges = rows.where("size(links) > 0").select("node", "url", F.explode("links").alias("href"))
    edges = edges.select("node", node(resolve(F.col("href"), F.col("url"))).alias("target"))
    alias = components(edges, "node", "target")
    alias = alias.withColumn("own", first_rule(host(F.col("node")), path(F.col("node")), rules)["verdict"])
    alias = C.stage(alias, "aliases")
    said = alias.groupBy("root").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    said = said.select(F.col("root").alias("__root"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("spread"))
    named = alias.join(said, alias.root == said["__root"]).select(F.col("node").alias("__node"), "root", "spread")
    named = C.bounded_broadcast(named, alias.count(), BROADCAST_ALIASES)
    out = rows.join(named, rows.node == named["__node"], "left")
    method = F.when(F.col("spread"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "root"
    )
