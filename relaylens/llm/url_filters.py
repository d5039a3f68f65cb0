"""Operator 13: url filters with decisions carried over redirects and canonical links.

A rule list allows or blocks hosts with all their subdomains under a path prefix; the longest rule that
fits a url decides.  A url that no rule fits takes the decision of its aliases: redirects (``meta``
refreshes of the page, and any redirects given) and canonical links join urls to classes of equivalent
ones, found as connected components, and a class with a blocked url is blocked.  An explicit allow goes
before that: a url that an allow rule fits stays allowed whatever its aliases are, though it still
ties its class together.  Everything else is allowed.

Urls are compared without fragment, with scheme and host in lower case and an empty path as ``/``.
Links are resolved against the page's url, dot segments taken out; links inside comments, scripts and
styles don't count.

Cases: a url that is null or without ``://`` has an empty host and path, fits no rule, has no aliases
and is allowed; null or empty html has no links; repeated pages each get their row; chains of
redirects may be of any length and go in circles; of rules of equal length the one with the longer host
decides, of the same rule both ways allow; very long pages are read whole; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .components import components, join_unique

# (host, path, verdict), fixed by the contract of the query
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(_part(url, 2))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in order])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return let(F.get(fits, 0), lambda r: F.when(r.isNotNull(), F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))


def node_of(url: Column) -> Column:
    """The url as aliases are compared by; null if it has no ``://``."""
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(F.contains(url, F.lit("://")), F.concat(lower_ascii(_part(url, 1)), F.lit("://"), host_of(url), path, _part(url, 4)))


def _without_dots(path: Column) -> Column:
    def step(acc, x):
        return F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(F.get(parts, F.size(parts) - 1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), folder)


def resolve(base: Column, link: Column) -> Column:
    """The url that ``link`` means on the page at ``base``."""
    scheme, origin = _part(base, 1), F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    there = F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.when(path_of(base) == "", F.lit("/")).otherwise(F.regexp_replace(path_of(base), r"(?s)[^/]*$", ""))
    return (F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(there), rest))
            .when(there == "", F.concat(origin, path_of(base), F.when(F.startswith(rest, F.lit("?")), rest).otherwise(_part(base, 4))))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, there)), rest)))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}{_VALUE}", 1)
    return F.replace(F.trim(F.regexp_replace(value, r"""(?s)^["']|["']$""", "")), F.lit("&amp;"), F.lit("&"))


def aliases(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges u, v between nodes: canonical links and refreshes of the pages, and ``redirects`` (from_url, to_url)."""
    html = F.lower("html")
    mine = pages.select("url", "html").where(F.contains("url", F.lit("://")) & (F.contains(html, F.lit("canonical")) | F.contains(html, F.lit("refresh"))))
    tags = mine.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"))
    tag = F.col("tag")
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical") & tag.rlike(r"(?i)^<link")
    refresh = (F.lower(_attribute(tag, "http-equiv")) == "refresh") & tag.rlike(r"(?i)^<meta")
    to = F.trim(F.regexp_replace(F.regexp_extract(_attribute(tag, "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""))
    link = F.when(canonical, _attribute(tag, "href")).when(refresh, to)
    found = tags.select("url", link.alias("link")).where("link <> ''").select("url", resolve(F.col("url"), F.col("link")).alias("target"))
    if redirects is not None:
        found = found.unionByName(redirects.select(F.col("from_url").alias("url"), resolve(F.col("from_url"), F.col("to_url")).alias("target")))
    edges = found.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"))
    return edges.where("u IS NOT NULL AND v IS NOT NULL").distinct()


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """node and blocked_by (a rule that blocks an alias) of all nodes in a class with a blocked url."""
    members = stored(components(edges), "members")
    rule = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)
    found = members.select("component", rule.alias("r")).where("r.verdict = 'block'")
    blocked = found.groupBy("component").agg(F.min("r.rule").alias("blocked_by"))
    return join_unique(members, blocked, "component", members.count()).select("node", "blocked_by")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_by (the rule of an alias that decided, else null)."""
    url = F.col("url")
    ours = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    ours = ours.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    # urls with a rule of their own need no alias
    ours = ours.withColumn("node", F.when(F.col("r").isNull(), F.col("node")))
    ours = stored(ours, "urls")
    blocked = stored(blocked_aliases(aliases(pages, redirects), rules), "blocked")
    out = join_unique(ours, blocked, "node", ours.count(), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked_by").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "blocked_by")


def oracle_sql(rules=RULES) -> str:
    """The same in SQL, for canonical links and refreshes to absolute urls."""
    listed = ", ".join(f"('{h}', '{p}', '{v}', {len(h + p)}, {len(h)})" for h, p, v in rules)
    norm = ("CASE WHEN {u} LIKE '%://%' THEN translate(regexp_extract({u}, '^(.*?)://', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || "
            "translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || "
            "CASE WHEN regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) END || "
            "regexp_extract({u}, '://[^?#]*(\\?[^#]*)', 1) END")
    best = """(SELECT arg_max({{'rule': h || p, 'verdict': v}}, size * 1000 + hsize) FROM rules
        WHERE (translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = h
            OR ends_with(translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.' || h))
          AND starts_with(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), p))"""
    return f"""
WITH RECURSIVE rules(h, p, v, size, hsize) AS (VALUES {listed}),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '(?is)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'),
links AS (
  SELECT url, CASE WHEN tag ~ '(?is)^<link\\s.*rel\\s*=\\s*["'']?canonical.*' THEN regexp_extract(tag, '(?is)href\\s*=\\s*["'']?([^"''\\s>]*)', 1)
                   WHEN tag ~ '(?is)^<meta\\s.*http-equiv\\s*=\\s*["'']?refresh.*' THEN regexp_extract(tag, '(?is)url\\s*=\\s*([^"''\\s>]*)', 1) END AS target FROM tags),
edges AS (SELECT DISTINCT {norm.format(u='url')} AS a, {norm.format(u='target')} AS b FROM links WHERE target LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (SELECT DISTINCT a AS node FROM both_ways),
reach(node) AS (
  SELECT node FROM (SELECT node, {best.format(u='node')} AS r FROM nodes) WHERE r.verdict = 'block'
  UNION SELECT b FROM reach JOIN both_ways ON a = reach.node),
judged AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         {best.format(u='url')} AS r, {norm.format(u='url')} AS node FROM pages)
SELECT page_id, host, path, r.rule AS rule,
       COALESCE(r.verdict, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' END, 'allow') AS verdict
FROM judged"""
