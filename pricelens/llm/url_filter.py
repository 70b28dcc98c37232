"""Operator 6: URL rules with redirect equivalence.

A url's own rule decides: the longest rule whose host (or a subdomain of it) and path prefix fit. Urls without
a rule take over a block from their aliases: canonical links and refresh redirects in the pages are edges
between urls, and a connected component with a blocked url is blocked as a whole, but for urls that a rule
allows. All steps are DataFrame operations.

A null url or one without ``://`` has an empty host and path, no rule, and is allowed. Pages may repeat; each
row gets its verdict. Urls are the same node when they differ only in the fragment or the case of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelens.llm.common import materialize
from pricelens.llm.components import connected_components

#: Production rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, group)


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def node_of(url: Column) -> Column:
    """The url without fragment, its host in lower case; null without ``://``."""
    return F.when(F.contains(url, F.lit("://")), F.concat(_part(url, 1), F.lit("://"), host_of(url), _part(url, 3), _part(url, 4)))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    tests = [
        F.when(((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*tests)


def _targets(html: Column) -> Column:
    """Link targets that name the same resource: canonical links and refresh redirects."""
    def attribute(tag: Column, name: str) -> Column:
        return F.trim(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1))

    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    both = F.concat(F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, lambda t: attribute(t, "url")))
    return F.transform(both, lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def _resolve(base: Column, target: Column) -> Column:
    """A target against the url of its page."""
    scheme, host = _part(base, 1), _part(base, 2)
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(_part(base, 3), r"(?s)^(.*/)", 1)
    return (
        F.when(target == "", F.lit(None))
        .when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that name the same resource."""
    marked = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    found = marked.select("url", F.explode(_targets(F.col("html"))).alias("target"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(_resolve(F.col("url"), F.col("target"))).alias("b")).filter("a is not null and b is not null and a <> b")


def blocked_aliases(edges: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Nodes of every component that holds a blocked url."""
    component = materialize(connected_components(edges), "url-components")
    own = component.withColumn("verdict", matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    blocked = own.filter("verdict = 'block'").select("component").distinct()
    return component.join(blocked, "component").select("node")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    url = F.col("url")
    found = pages.select("page_id", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = found.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    aliases = materialize(blocked_aliases(alias_edges(pages), rules), "url-aliases").withColumn("alias", F.lit(True))
    joined = found.join(aliases, "node", "left")
    verdict = F.coalesce(F.col("match.verdict"), F.when(F.col("alias"), F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"))
