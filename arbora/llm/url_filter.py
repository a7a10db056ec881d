"""URL filter with redirect equivalence, in DataFrame functions only.

A list of rules (host, path, verdict) decides the urls it fits: the rule's host or any
subdomain, a path that starts with the rule's; the longest rule wins. Redirects (meta
refresh) and canonical links tie urls together; connected components over these edges
carry a block decision from any url of a component to its aliases. Allow has precedence:
a url's own rule stands, and a component that holds an allowed url blocks no alias.
Urls that nothing decides are allowed.

Defined results: a null url, or one without `://`, has empty host and path and is allowed;
null html has no edges; very long urls and pages are read whole; repeated rows are judged one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The standing rules, as (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule that decides (as host and path together) and its verdict, else null. The
    rules are one expression: the longest first."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        name = F.when(_fits(host, path, r), F.lit(r[0] + r[1])).otherwise(name)
        verdict = F.when(_fits(host, path, r), F.lit(r[2])).otherwise(verdict)
    return name, verdict


def _node(url: Column) -> Column:
    """A url as the name of a node: no fragment, host in lower case, no scheme."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.regexp_extract(_after(url), r"^[^/?#]*([^#]*)", 1)))


def _target(base: Column, link: Column) -> Column:
    """A link as found on a page, made a whole url."""
    root = F.concat(F.lit("http://"), host_of(base))
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link == "", None)
        .when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.regexp_replace(path_of(base), r"[^/]*$", ""), link))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(u, v): nodes tied by a canonical link or a redirect."""
    url, html = F.col("url"), F.col("html")
    links = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1),
    )
    some = pages.where(F.instr(url, "://") > 0).where(html.rlike(CANONICAL) | html.rlike(REFRESH))
    out = some.select("url", F.explode(links).alias("link")).select(_node(url).alias("u"), _node(_target(url, F.col("link"))).alias("v"))
    return out.where("u is not null and v is not null and u <> v").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("own", verdict)
    tied = settle(edges(pages.select("url", "html")))
    if tied.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    comp = components(tied)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, said = rule_of(host_of(as_url), path_of(as_url), rules)
    flags = comp.withColumn("said", said).groupBy("component").agg(F.max((F.col("said") == "block").cast("int")).alias("b"), F.max((F.col("said") == "allow").cast("int")).alias("a"))
    blocked = comp.join(flags.where("b = 1 and coalesce(a, 0) = 0"), "component").select("node", F.lit("block").alias("carried"))
    out = rows.withColumn("node", F.when(F.col("own").isNull(), _node(F.col("url"))))
    ruled, open_ = out.where("node is null"), out.where("node is not null").join(blocked, "node", "left")
    done = ruled.withColumn("carried", F.lit(None).cast("string")).unionByName(open_)
    return done.select("page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"))
