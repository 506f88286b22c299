"""URL filter: suffix rules, and decisions that travel along redirects and canonical links.

A rule is (verdict, host, path): it fits its host and all subdomains where the URL's path begins with the rule's path,
and the longest fitting rule decides.  A URL that no rule fits takes the decision of its redirect class, the connected
component of the graph whose edges are the links by which pages name another address of themselves: canonical links and
refreshes, whatever their delay.  An explicit allow in the class takes precedence over a block; a class without either is allowed.

Components are computed on the cluster over 128-bit keys of the addresses; the page texts are read once, for the links,
and never shuffled.  Built-in functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.plans.shared import Stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
COMPILED = 200  # rules up to which they are part of the expression; longer lists are a table that is joined


def split_url(url: str) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL column; all empty without ``://`` or for null."""
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substr(after, F.length(path) + 1), r"^[^#]*", 0)
    return F.translate(host, UPPER, LOWER), path, query


def rule_number(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Position in ``rules`` of the longest rule that fits, null if none does; of equally long rules the first."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    out = None
    for i in order:
        _, h, p = rules[i]
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judged(urls: DataFrame, url: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` with the columns host, path, query, rule and verdict of the rules alone (null where none fits)."""
    host, path, query = split_url(url)
    out = urls.withColumn("host", host).withColumn("path", path).withColumn("query", query)
    if len(rules) > COMPILED:
        return _joined(out, rules)
    out = out.withColumn("__n", rule_number(F.col("host"), F.col("path"), rules))
    said = [F.array(*[F.lit(x) for x in xs]) if rules else F.array().cast("array<string>") for xs in ([h + p for _, h, p in rules], [v for v, _, _ in rules])]
    out = out.withColumn("rule", F.when(F.col("__n").isNotNull(), F.get(said[0], F.col("__n"))))
    return out.withColumn("verdict", F.when(F.col("__n").isNotNull(), F.get(said[1], F.col("__n")))).drop("__n")


def _joined(out: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same for long lists: each distinct (host, path) asks for its host suffixes with its path prefixes of the
    lengths that rules have, an equi-join, and keeps the longest answer; no URL meets a rule that does not fit."""
    kind = "array<struct<n int, v string, h string, p string>>"
    listed = F.from_json(F.lit(json.dumps([{"n": i, "v": v, "h": h, "p": p} for i, (v, h, p) in enumerate(rules)])), kind)
    table = out.sparkSession.range(1).select(F.explode(listed).alias("r")).select("r.*").withColumn("at", F.md5(F.concat("h", F.lit("/"), "p")))
    sizes = F.array(*[F.lit(x) for x in sorted({len(p) for _, _, p in rules})])
    places = out.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(suffix).alias("s"))
    asked = asked.select("host", "path", "s", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select("host", "path", F.md5(F.concat("s", F.lit("/"), F.substring("path", F.lit(1), F.col("n")))).alias("at"))
    best = F.max(F.struct(F.length(F.concat("h", "p")), F.length("h"), -F.col("n"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict"))).alias("b")
    found = asked.join(table, "at").groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.verdict")
    return out.join(found, ["host", "path"], "left")


def address(host: Column, path: Column, query: Column) -> Column:
    """Key of an address: scheme and fragment do not count."""
    return F.md5(F.concat(host, path, query))


def without_dots(path: Column) -> Column:
    """``path`` (which begins with ``/``) with its ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    last = F.element_at(parts, -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(out, F.lit("/"))).otherwise(out)


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``(url, target)`` for every canonical link and refresh of each page, targets made absolute as RFC 3986 says."""
    def found(mark: str, tag: str, inner: str) -> Column:
        near = F.contains(F.lower(F.col(html)), F.lit(mark))
        tags = F.transform(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0)), lambda x: F.replace(F.regexp_extract(x, inner, 1), F.lit("&amp;"), F.lit("&")))
        return F.when(near, tags).otherwise(F.array().cast("array<string>"))

    both = F.concat(found("canonical", CANONICAL, HREF), found("refresh", REFRESH, TARGET))
    out = pages.select(F.col(url).alias("url"), F.explode(both).alias("t")).where("t <> '' AND url LIKE '%://%'")
    scheme = F.regexp_extract("url", r"^[^:]*:", 0)
    origin = F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    own, rest = F.regexp_extract("t", r"^[^?#]*", 0), F.regexp_extract("t", r"[?#].*$", 0)
    target = (
        F.when(F.col("t").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.col("t")).when(F.startswith("t", F.lit("//")), F.concat(scheme, "t"))
        .when(F.startswith("t", F.lit("/")), F.concat(origin, without_dots(own), rest))
        .when(F.startswith("t", F.lit("?")), F.concat(origin, path, "t"))
        .when(F.startswith("t", F.lit("#")), F.col("url"))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, own)), rest))
    )
    return out.select("url", target.alias("target"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, by)`` for every row of ``pages``.

    ``redirects`` may add known redirects ``(url, target)``.  ``by`` says what decided: ``rule``, ``alias`` or
    ``default``.  A null URL or one without ``://`` has empty host and path, no rule and no alias, and is allowed; null
    pages have no links; repeated rows are judged alike; an empty table gives none; other columns are left out.
    """
    rules = [(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules]
    stash = Stash(pages.sparkSession)
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    linked = links(base, "url", "html")
    if redirects is not None:
        linked = linked.union(redirects.select("url", "target").where("url LIKE '%://%' AND target LIKE '%://%'"))

    def node(col: str) -> DataFrame:
        return judged(linked.select("url", "target"), col, rules).withColumn("key", address(F.col("host"), F.col("path"), F.col("query")))

    ends = node("url").select("target", F.struct("key", "verdict").alias("a"))
    ends = judged(ends, "target", rules).withColumn("b", F.struct(address(F.col("host"), F.col("path"), F.col("query")).alias("key"), "verdict"))
    ends = stash.keep(ends.select("a", "b").distinct(), "links")
    group = components(ends.select(F.col("a.key").alias("u"), F.col("b.key").alias("v"))).withColumnRenamed("v", "key")
    known = ends.select("a.*").union(ends.select("b.*")).distinct()
    said = known.join(group, "key").groupBy("comp").agg(F.max(F.col("verdict") == "allow").alias("ok"), F.max(F.col("verdict") == "block").alias("bad"))
    alias = group.join(said, "comp").select("key", F.when(F.col("ok"), "allow").when(F.col("bad"), "block").alias("alias")).where("alias IS NOT NULL")
    out = judged(base.select("page_id", "url"), "url", rules)
    out = out.withColumn("key", F.when(F.col("host") != "", address(F.col("host"), F.col("path"), F.col("query"))))
    out = out.join(alias, "key", "left")
    by = F.when(F.col("verdict").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"), by.alias("by"))
