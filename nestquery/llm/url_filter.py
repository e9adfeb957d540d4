"""Operator 2 [native]: URL rules, and redirect equivalence over aliases.

A rule (host, path, action) fits its host and all subdomains if the url's path starts with
the rule's; of those that fit the longest wins (by characters of host and path, then by
the rule's text, then block before allow).  URLs without a rule take the decision of their
aliases: redirects and canonical links are edges, connected components are found by
distributed star rounds, and a component that holds a blocked url is blocked, unless it
also holds an explicitly allowed one (allow takes precedence).  A url's own rule always
comes first.

An alias is host, path without dot segments, and query; scheme and fragment don't count.
Edges come from all <link rel=canonical> and <meta http-equiv=refresh> tags of the pages,
and from a table of redirects (src, dst) if one is given; targets count with their own
rules, crawled or not.  A link is resolved against its page: it is absolute only if it
begins with a scheme and "://"; `&amp;` stands for `&`; other schemes give no edge.

Decisions are made once per distinct url and come back to the pages by a join that spreads
urls which many pages share.  Nodes are numbered, not hashed, so no two aliases are taken
for one.

Defined cases: null url, or none with "://": host and path empty, no rule, no alias, allow;
null html: no edges; urls and pages of any length are read whole; repeated rows are judged
each; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
GOAL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""
AMPERSAND = r"(?i)&(amp|#38|#x26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def plain_path(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step)
    kept = F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.contains(path, F.lit("/.")), kept).otherwise(path)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path, and alias (host, plain path and query) of a url."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = url.substr(F.instr(url, "://") + 3, F.char_length(url))
    lower = lambda c: F.translate(c, UPPER, LOWER)
    host = lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    empty = F.lit("")
    return (
        F.when(has, host).otherwise(empty),
        F.when(has, path).otherwise(empty),
        F.when(has, F.concat(host, F.when(path == "", "/").otherwise(plain_path(path)), query)),
    )


def resolve(link: Column, host: Column, path: Column) -> Column:
    """An absolute url from a link on the page at host and path; null for none."""
    here = F.when(path == "", F.lit("/")).otherwise(path)
    at = lambda *c: F.concat(F.lit("http://"), host, *c)
    return (
        F.when((link == "") | link.rlike("^#"), None)
        .when(link.rlike(SCHEME + "//"), link)
        .when(link.rlike(SCHEME), None)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), at(link))
        .when(F.startswith(link, F.lit("?")), at(here, link))
        .otherwise(at(F.regexp_replace(here, r"[^/]*$", ""), link))
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for each distinct (host, path) that a rule fits."""
    u = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    u = u.select("host", "path", F.explode(tails).alias("tail"))
    r = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "action").distinct()
    fit = u.join(r, (F.col("tail") == F.col("rh")) & F.startswith("path", "rp"))
    text = F.concat("rh", "rp")
    best = F.max(F.struct(F.char_length(text).alias("n"), text.alias("rule"), "action")).alias("b")
    return fit.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias) for every page."""
    host, path, alias = split_url(F.col("url"))
    p = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"), alias.alias("alias"), "html")
    found = lambda tag, inner: F.transform(F.regexp_extract_all("html", F.lit(tag), 0), lambda t: F.regexp_extract(t, inner, 1))
    some = lambda tag, inner: F.when(F.col("html").rlike(tag), found(tag, inner)).otherwise(F.array().cast("array<string>"))
    links = F.transform(F.concat(some(CANONICAL, HREF), some(REFRESH, GOAL)), lambda t: resolve(F.regexp_replace(t, AMPERSAND, "&"), F.col("host"), F.col("path")))
    links = F.filter(F.array_distinct(links), lambda t: t.isNotNull())
    p = durable(p.select("key", "host", "path", "alias", F.when(F.col("alias").isNotNull(), links).alias("links")))

    def end(df: DataFrame, url: Column, prefix: str) -> DataFrame:
        h, q, a = split_url(url)
        return df.select("*", h.alias(f"{prefix}host"), F.when(q != "", plain_path(q)).otherwise(q).alias(f"{prefix}path"), a.alias(f"{prefix}alias"))

    pairs = end(p.select("host", "path", "alias", F.explode("links").alias("to")), F.col("to"), "t_").drop("to")
    if redirects is not None:
        other = end(end(redirects.select("src", "dst"), F.col("src"), ""), F.col("dst"), "t_").drop("src", "dst")
        pairs = pairs.unionByName(other.where("alias is not null"))
    pairs = durable(pairs.where("t_alias is not null").distinct())
    ends = pairs.select("host", "path", "alias").unionByName(pairs.select(*[F.col(f"t_{c}").alias(c) for c in ("host", "path", "alias")])).distinct()
    urls = durable(p.where("alias is not null").groupBy("host", "path", "alias").agg(F.count("*").alias("n")))
    ruled = durable(match_rules(urls.select("host", "path").unionByName(ends.select("host", "path")), rules))

    nodes = durable(ends.select("alias").distinct().withColumn("id", F.monotonically_increasing_id()))
    number = lambda df, c: df.join(nodes.select(F.col("alias").alias(c), F.col("id").alias(f"{c}_id")), c)
    edges = pairs.select("alias", "t_alias").where("alias <> t_alias").distinct()
    parts = connected_components(number(number(edges, "alias"), "t_alias").select(F.col("alias_id").alias("a"), F.col("t_alias_id").alias("b")), native=True)
    acted = number(ends.join(ruled, ["host", "path"]), "alias").select(F.col("alias_id").alias("node"), "action").distinct()
    decided = acted.join(parts, "node").groupBy("component").agg(
        F.max((F.col("action") == "block").cast("int")).alias("b"), F.max((F.col("action") == "allow").cast("int")).alias("a")
    )
    blocked = parts.join(decided.where("b = 1 and a = 0"), "component").join(nodes, F.col("node") == F.col("id")).select("alias", F.lit("block").alias("spread"))
    facts = urls.join(ruled, ["host", "path"], "left").join(blocked, "alias", "left")
    verdict = F.coalesce("action", "spread", F.lit("allow"))
    facts = durable(facts.select("host", "path", "alias", "n", "rule", verdict.alias("verdict")))
    given = spread_join(p.where("alias is not null").select("key", "host", "path", "alias"), facts, ["host", "path", "alias"], "n")
    null = F.lit(None).cast("string")
    none = p.where("alias is null").select("key", "host", "path", "alias", null.alias("rule"), F.lit("allow").alias("verdict"))
    return given.unionByName(none).select(F.col("key").alias(key), "host", "path", "rule", "verdict", "alias")
