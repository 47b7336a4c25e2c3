"""URL verdicts: explicit rules, and block decisions carried over redirect and canonical-link equivalence.

A rule names a host and the start of a path; it fits that host and its subdomains, and the longest fitting rule decides a
URL.  Pages also say that two URLs are one resource: ``<link rel=canonical>``, ``<meta http-equiv=refresh>``, and redirects that a
crawler logged (an optional table).  These are edges between URL keys; their connected components are found by distributed
label propagation, and a component with one URL that a rule blocks blocks all its URLs.  An explicit allow takes precedence:
a URL with a rule of its own keeps that rule's verdict, whatever its aliases are.  All else is allowed.

URL keys leave out scheme, fragment and default ports, lower-case the host, resolve dot segments and give an empty path a
slash; they only serve as nodes, while rules of a page are held against its URL as written.  Link targets are resolved against the
page (or its ``<base>``).  Comments, scripts, styles and text areas hold no links.

Only DataFrame functions are used.  Rules are literals of one projection.  Pages with a link are few, so edges are small
beside pages; they are made distinct first, and joins back to pages are salted, so that one URL or one component may hold a
third of all rows.

Defined cases: a URL that is null or has no ``://`` has empty host and path, fits no rule, is no node and is allowed; null html
has no links; repeated rows and rows without id are judged like others, one result row each; links to the page itself, to
other documents than ``scheme://`` ones, and empty links are no edges; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: parts of a page whose text is no markup, and tags that may carry a link
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<textarea\b.*?(?:</textarea\s*>|$)"
TAGS = r"""(?i)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
MAY_LINK = r"(?i)canonical|refresh"
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the (verdict, host/path) rules that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first, as it is wrapped last
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """One spelling for URLs that name one resource; null if there is no ``://``."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    parts = F.split(path_of(url), "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda seen, part: F.when(part == ".", seen).when(part == "..", F.when(F.size(seen) > 1, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen))
        .otherwise(F.concat(seen, F.array(part))),
    )
    walked = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    path = F.when(path_of(url).rlike(r"(?s)(?:^|/)\.\.?(?:/|$)"), walked).otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, F.when(path == "", "/").otherwise(path), query))


def attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    raw = F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(raw, r"&(?:amp|#38|#x26);", "&"))


def resolved(base: Column, target: Column) -> Column:
    """The target as an absolute URL; null if it names no other document."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(target.rlike(r"(?is)^[a-z][a-z0-9+.\-]*://"), target)
        .when(target.rlike(r"(?is)^[a-z][a-z0-9+.\-]*:") | (target == "") | target.startswith("#") | ~base.contains("://"), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(base), target))
        .otherwise(F.concat(folder, target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a`` and ``b``, the keys of a page and of the URL that its canonical link or refresh names."""
    some = pages.where(F.col(html).rlike(MAY_LINK) & F.col(url).contains("://"))
    some = some.select(F.col(url).alias("url"), F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAGS), F.lit(0)).alias("tags"))
    bases = F.filter(F.transform("tags", lambda t: F.when(t.rlike(r"(?i)^<base\b"), F.nullif(attribute(t, "href"), F.lit("")))), lambda t: t.isNotNull())
    some = some.withColumn("base", F.coalesce(resolved(F.col("url"), F.get(bases, F.lit(0))), F.col("url")))
    tags = some.select("url", "base", F.explode("tags").alias("tag"))
    rel, equiv = F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), F.lower(attribute(F.col("tag"), "http-equiv"))
    moved = F.regexp_extract(attribute(F.col("tag"), "content"), r"""(?is)^[\d.\s]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    target = (
        F.when(F.col("tag").rlike(r"(?i)^<link\b") & F.array_contains(rel, "canonical"), attribute(F.col("tag"), "href"))
        .when(F.col("tag").rlike(r"(?i)^<meta\b") & (equiv == "refresh"), F.trim(moved))
    )
    found = tags.select("url", "base", target.alias("target")).where("target is not null")
    return found.select(url_key(F.col("url")).alias("a"), url_key(resolved(F.col("base"), F.col("target"))).alias("b")).where("a <> b").distinct()


def _with_flag(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Whether ``key`` is among ``keys``; salted, as one key may hold a large part of the rows."""
    salted = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"), F.lit(True).alias(name))
    out = rows.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, [key, "__salt"], "left")
    return out.withColumn(name, F.coalesce(name, F.lit(False))).drop("__salt")


def blocked_keys(edges: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Keys without a rule of their own, in a component with a key that a rule blocks."""
    nodes = components(edges)
    url = F.concat(F.lit("http://"), F.col("node"))
    nodes = materialise(nodes.withColumn("verdict", rule_of(host_of(url), path_of(url), rules)["verdict"]), "url-nodes")
    bad = nodes.where("verdict = 'block'").select("label").distinct()
    return _with_flag(nodes.where("verdict is null"), bad, "label", "bad").where("bad").select(F.col("node").alias("key"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, *, id_col: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias``: the rule that decided, and whether an alias' block did.

    ``redirects`` may hold ``from_url`` and ``to_url`` of redirects that were followed.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        seen = redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b"))
        edges = edges.unionByName(seen.where("a <> b")).distinct()
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), url_key(F.col(url)).alias("key"))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    rows = _with_flag(rows, blocked_keys(materialise(edges, "url-edges"), rules), "key", "alias")
    alias = F.col("alias") & F.col("ruled").isNull()
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(alias, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), alias.alias("alias"))
