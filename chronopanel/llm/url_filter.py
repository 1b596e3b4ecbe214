"""URL filters: host and path rules, and block decisions carried to aliases over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, stored
from .components import components

#: (verdict, host, path): the rule stands for the host and its subdomains, and for paths that start with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
#: What a page says where it belongs: a canonical link, or a refresh to another url.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
LINK = r"(?is)<link\b[^>]*>"
CANONICAL = r"(?is)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
HREF = r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
META = r"(?is)<meta\b[^>]*>"
REFRESH = r"(?is)http-equiv\s*=\s*[\"']?refresh\b"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def url_key(url: Column) -> Column:
    """Host, path and query: one name for a url whatever its scheme, fragment and case of the host. Null without ://."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), F.regexp_extract(url, QUERY, 1)))


def resolved(base: Column, href: Column) -> Column:
    """href seen from base, without folding of dots. Null for an empty one and for mere fragments."""
    site = F.concat(F.lit("http://"), host_of(base))
    href = F.replace(F.trim(href, F.lit(" \t\r\n\f\"'")), F.lit("&amp;"), F.lit("&"))
    other = F.concat(site, F.when(F.contains(path_of(base), F.lit("/")), F.regexp_replace(path_of(base), r"[^/]*$", "")).otherwise(F.lit("/")), href)
    return F.when((href == "") | href.startswith("#"), None).when(href.rlike(ABSOLUTE), href).when(href.startswith("//"), F.concat(F.lit("http:"), href)).when(
        href.startswith("/"), F.concat(site, href)).when(href.startswith("?"), F.concat(site, path_of(base), href)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(other)


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): the first canonical link and the first refresh of every page, outside comments and scripts,
    resolved against its url. Native, one scan; pages without the two words are not searched any further."""
    html = F.when(F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"), F.regexp_replace("html", HIDDEN, " "))
    rows = pages.select(F.col(url_col).alias("source"), F.col(html_col).alias("html")).where("source is not null").select("source", html.alias("html")).where("html is not null")

    def first(tag: str, wanted: str, value: str) -> Column:
        return F.regexp_extract(F.get(F.filter(F.regexp_extract_all("html", F.lit(tag), 0), lambda t: t.rlike(wanted)), F.lit(0)), value, 1)

    hrefs = F.filter(F.array(first(LINK, CANONICAL, HREF), first(META, REFRESH, TARGET)), lambda x: x.isNotNull())
    return rows.select("source", F.explode(hrefs).alias("href")).select("source", resolved(F.col("source"), F.col("href")).alias("target")).where("target is not null")


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """Rules as a table (verdict, rule_host, rule_path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def judged(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host, path, and rule and verdict of the longest fitting rule (host and path together; of equal ones an
    allow, then the least), or nulls. urls must not have columns of these four names.

    The distinct hosts are split into their suffixes and joined with the rules, so a long rule list is read by key and a
    hot host is one row there; the rules of each host come back to its urls in a join that AQE may split.
    """
    by_host = rules.groupBy(ascii_lower(F.col("rule_host")).alias("suffix")).agg(F.collect_set(F.struct(F.col("rule_path").alias("path"), F.col("verdict"))).alias("paths"))
    rows = urls.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    found = hosts.join(by_host, "suffix").select("host", F.explode(F.transform("paths", lambda p: F.struct(F.concat("suffix", p["path"]).alias("rule"), p["path"].alias("path"), p["verdict"].alias("verdict")))).alias("r"))
    found = stored(found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("r").alias("__rules")), "host-rules")  # so that AQE can split a hot host
    fits = F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"]))
    order = F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    best = rows.join(found, F.col("host") == F.col("__host"), "left").withColumn("__best", F.array_min(order)).drop("__host", "__rules")
    return best.withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.col("__best.verdict")).drop("__best")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, alias_of_blocked) of every page.

    Urls that redirect to each other (``redirects``: source, target) or that a page names as its canonical url or refreshes
    to are aliases. Their connected components are found in tables of the shared folder by hooking and pointer jumping. A
    page whose own url fits a rule has that rule's verdict, an allow first of all. Any other page is blocked if one of its
    aliases is blocked by a rule and none is allowed by one; the rest is allowed. Aliases need not be pages themselves.
    alias_of_blocked: whether an alias, or the url itself, is blocked by a rule.

    Only distinct links between different urls are grouped, and their endpoints judged once each. A hub that a third of
    all urls redirect to costs a combined minimum a task. Null urls and such without :// have an empty host and path, fit
    no rule, have no aliases and are allowed. Repeated pages are judged each; an empty table gives an empty one. Other
    columns are not read, so their names can't clash.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    links = spark.createDataFrame([], "source string, target string")
    if html_col is not None:
        links = links.unionByName(declared_links(pages, url_col, html_col))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = stored(links.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")).where("a != b").distinct(), "links")
    nodes = components(edges)
    ruled = judged(nodes.withColumn("at", F.concat(F.lit("http://"), F.col("node"))), rules, "at")
    has = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    groups = ruled.groupBy("root").agg(has("block").alias("blocks"), has("allow").alias("allows"))
    decided = stored(nodes.join(groups.where("blocks"), "root").select(F.col("node").alias("__node"), (~F.col("allows")).alias("__inherits")), "aliases")
    out = judged(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), rules, "__url").withColumn("__key", url_key(F.col("__url")))
    out = out.join(decided, F.col("__key") == F.col("__node"), "left")
    own = F.coalesce(F.col("verdict") == "block", F.lit(False))
    verdict = F.coalesce("verdict", F.when(F.col("__inherits"), "block"), F.lit("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), (own | F.col("__node").isNotNull()).alias("alias_of_blocked"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '{HOST}', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '{PATH}', 1)"
    key = lambda u: f"case when contains({u}, '://') then {host(u)} || {path(u)} || regexp_extract({u}, '{QUERY}', 1) end"
    first = lambda tag, wanted, value: f"regexp_extract(list_filter(regexp_extract_all(h, '{tag}'), lambda t: regexp_matches(t, '{q(wanted)}'))[1], '{q(value)}', 1)"
    cases = lambda col: " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v if col == 'verdict' else h + p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return rf"""
with recursive parts as (select page_id, url, {host("url")} as host, {path("url")} as path, {key("url")} as k from pages),
own as (select *, case {cases("rule")} end as rule, case {cases("verdict")} end as verdict from parts),
bare as (select url, regexp_replace(html, '{HIDDEN}', ' ', 'g') as h from pages where url is not null and regexp_matches(html, '(?i)\bcanonical\b|\brefresh\b')),
hrefs as (select url, unnest([{first(LINK, CANONICAL, HREF)}, {first(META, REFRESH, TARGET)}]) as href from bare),
clean as (select url, replace(trim(href, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || '"' || chr(39)), '&amp;', '&') as r, 'http://' || {host("url")} as site, {path("url")} as path from hrefs where href is not null),
links as (select url, case when r = '' or r[1] = '#' then null when regexp_matches(r, '{ABSOLUTE}') then r when r[1:2] = '//' then 'http:' || r when r[1] = '/' then site || r
  when r[1] = '?' then site || path || r when regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') then null else site || case when contains(path, '/') then regexp_replace(path, '[^/]*$', '') else '/' end || r end as target from clean),
edges as (select distinct a, b from (select {key("url")} as a, {key("target")} as b from links where target is not null) where a <> b),
both_ways as (select a, b from edges union select b, a from edges),
nodes as (select k, {host("'http://' || k")} as host, {path("'http://' || k")} as path from (select distinct a as k from both_ways)),
ruled as (select k, case {cases("verdict")} end as verdict from nodes),
reach as (select k, verdict from ruled where verdict is not null union select b, verdict from reach join both_ways on a = k),
met as (select k, bool_or(verdict = 'block') as blocks, bool_or(verdict = 'allow') as allows from reach group by k)
select page_id, host, path, rule, coalesce(verdict, case when blocks and not allows then 'block' end, 'allow') as verdict, coalesce(verdict = 'block', false) or coalesce(blocks, false) as alias_of_blocked
from own left join met using (k)
"""


SQL = _sql()
