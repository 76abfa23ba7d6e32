"""URL filters with redirect equivalence, in DataFrame functions only.

Rules (verdict, host, path) fit a host and its subdomains if the path starts
with the rule's; the longest rule wins.  Urls joined by redirect or canonical
links are aliases: connected components over those edges carry decisions.  A
url without a rule of its own takes the verdict of its class: allow if any
member is explicitly allowed, else block if any member is blocked, else allow.
A rule of its own always stands.

Edges come from the html: ``<link rel=canonical>`` and ``<meta http-equiv=
refresh>``; a table of redirects (src, dst) can be added.  Spellings of one url
(case of host, default port, dot segments, empty path, fragment) are one node.  Null urls and urls
without ``://`` have empty host and path, fit no rule and have no aliases.
Repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ, Scratch, connected_components

# The rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER_AZ, LOWER_AZ), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _undotted(p: Column) -> Column:
    """A path without . and .. segments."""
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    kept = F.aggregate(F.split(F.substr(p, F.lit(2)), "/", -1), none, step)
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$"), F.when(F.size(kept) > 0, "/").otherwise("")).otherwise(""))).otherwise(p)


def node(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, no default port, no dot segments, / for an empty path, no fragment; null if there is no ://."""
    bare = F.regexp_extract(url, r"^(?s)([^#]*)", 1)
    start = F.translate(F.regexp_extract(bare, r"^(?s)(.*?://[^/?]*)", 1), UPPER_AZ, LOWER_AZ)
    start = F.regexp_replace(F.regexp_replace(start, r"^(http://.*):(?:80)?$", "$1"), r"^(https://.*):(?:443)?$", "$1")
    p, query = path(bare), F.regexp_extract(bare, r"^(?s)[^?]*(\?.*)$", 1)
    return F.when(start != "", F.concat(start, F.when(p == "", "/").otherwise(_undotted(p)), query))


#: A link or meta tag that names an alias; rel may hold several words.
_CANONICAL, _REFRESH = r"""(?is)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical[\s/>])""", r"""(?is)[\s"'/]http-equiv\s*=\s*["']?refresh"""


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical and refresh links in the html."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    target = F.transform(tags, lambda t: F.replace(F.coalesce(F.nullif(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")), F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)), F.lit("&amp;"), F.lit("&")))
    rows = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select(F.col("url"), F.explode(target).alias("to")).where("to <> '' and url like '%://%'")
    site = F.regexp_extract("url", r"^(?s)(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path(F.col("url")), r"^(?s)(.*/)", 1), F.lit("")), F.lit("/")))
    to = F.col("to")
    whole = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to).when(to.startswith("//"), F.concat(F.regexp_extract("url", r"^(?s)(.*?:)//", 1), to)).when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path(F.col("url")), to)).when(to.startswith("#"), F.col("url")).otherwise(F.concat(folder, to))
    return rows.select(node(F.col("url")).alias("src"), node(whole).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and, if the page has aliases, the label of its class."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")).where("src is not null and dst is not null"))
    edges = scratch.write(edges.distinct())
    url = F.col("url")
    own = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), node(url).alias("node")).withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    rule, by_rule = F.col("own.rule").alias("rule"), F.col("own.verdict")
    if edges.isEmpty():
        return own.select("page_id", "host", "path", rule, F.coalesce(by_rule, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
    labels = connected_components(spark, edges, scratch)
    decided = labels.withColumn("own", rule_for(host(F.col("node")), path(F.col("node")), rules)["verdict"])
    classes = scratch.write(decided.groupBy("label").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")))
    passed = scratch.write(labels.join(classes, "label").select("node", F.col("label").alias("alias_class"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("passed")))
    scratch.keep_only(passed)
    return own.join(passed, "node", "left").select("page_id", "host", "path", rule, F.coalesce(by_rule, "passed", F.lit("allow")).alias("verdict"), "alias_class")
