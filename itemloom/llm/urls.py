"""URL filters with redirect equivalence.

A page's host and path are judged by block and allow rules, the longest that fits. Redirects (meta refresh) and canonical
links make URLs aliases of each other; connected components over these edges carry block decisions to aliases. Any
explicit allow inside a component wins over its blocks for members that no rule fits. The members' own rules always win.

Rules are a table of any length: a URL's host suffixes and path prefixes, as long as the rules' own, are joined with it.
Hosts and paths are judged once each, however many pages share them. Spark broadcasts the rules only if they are small.

Spellings that differ in scheme, in a fragment, in the host's case, in dot segments or in an empty path for "/" are one URL,
so each is an alias of the others. Targets that were never crawled are judged too: a page whose canonical URL is blocked
is blocked. Everything is DataFrame expressions.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule, has no aliases and is
allowed; null html has no links; relative links, "?" and dot segments included, are resolved against their page; of rules of
one length the first in the alphabet wins, and allow before block; rules and redirects with nulls are left out, repeated ones
count once; URLs of any length are read whole; repeated rows are judged alike; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?\s*([^\s"'>;]+)"""


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty where there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def with_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """The frame with {prefix}host, {prefix}path and {prefix}node of a URL column, in stages, so that no part is spelled out twice.

    node names a page: host, path without dot segments ("/" for an empty one) and query; null where there is no host.
    """
    p = prefix
    df = df.withColumn(f"{p}rest", F.coalesce(_rest(F.col(url)), F.lit("")))
    df = df.withColumns({f"{p}host": F.translate(F.regexp_extract(f"{p}rest", r"^([^/?#]*)", 1), _UPPER, _LOWER), f"{p}path": F.regexp_extract(f"{p}rest", r"^[^/?#]*([^?#]*)", 1), f"{p}query": F.regexp_extract(f"{p}rest", r"^[^/?#]*[^?#]*(\?[^#]*)?", 1)})
    return df.withColumn(f"{p}node", F.when(F.col(f"{p}host") != "", F.concat(f"{p}host", normal_path(F.col(f"{p}path")), f"{p}query")))


def normal_path(path: Column) -> Column:
    """The path without "." and ".." segments; "/" for an empty one."""
    steps = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    last = F.element_at(F.split(path, "/", -1), -1)
    walk = F.aggregate(steps, F.expr("cast(array() as array<string>)"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    plain = F.concat(F.lit("/"), F.array_join(walk, "/"), F.when(last.isin(".", "..") & (F.size(walk) > 0), "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), plain).otherwise(path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of rules as a table: host, path, verdict."""
    spell = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("select '' as host, '' as path, '' as verdict where false")
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(spell, r))})" for r in rules) + " as t(host, path, verdict)")


def rules_that_fit(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, own: for each distinct host and path that a rule fits, the longest one and its verdict.

    The driver sees the numbers of labels in the rules' hosts and the lengths of their paths, each once: a few numbers, which the
    form of URLs bounds, not the number of rules.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    labels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.", -1))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keys = f"flatten(transform(array({','.join(map(str, labels or [1]))}), c -> transform(array({','.join(map(str, lengths or [0]))}), l -> struct(substring_index(host, '.', -c) as h, substring(path, 1, l) as p))))"
    tried = places.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(F.array_distinct(F.expr(keys))).alias("key"))
    rules = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    fit = tried.select("host", "path", "key.h", "key.p").join(rules, ["h", "p"])
    best = fit.groupBy("host", "path").agg(F.min(F.struct((-F.length("h") - F.length("p")).alias("minus"), "h", "p", "verdict")).alias("best"))
    return best.select("host", "path", F.concat("best.h", "best.p").alias("rule"), F.col("best.verdict").alias("own"))


def _absolute(target: Column, url: Column, rest: Column) -> Column:
    """A link's URL, seen from its page. rest: what follows "://" in the page's URL."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, r"^([^/?#]*)", 1))
    folder = F.regexp_extract(rest, r"^[^/?#]*((?:/[^/?#]*)*/)?", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), target))
        .when(target.startswith("#") | (target == ""), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # mailto: and the like
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: normal URLs of pages and of what they redirect to or call canonical. pages: url, html."""
    linked = pages.where(F.col("html").rlike(r"(?i)canonical|refresh"))
    entities = lambda c: F.regexp_replace(c, "(?i)&amp;", "&")
    href = lambda tag: F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)])
    canonical = F.transform(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), lambda tag: entities(href(tag)))
    refresh = F.transform(F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)), lambda tag: entities(F.regexp_extract(tag, _TARGET, 1)))
    targets = linked.select("url", F.explode(F.concat(canonical, refresh)).alias("target")).where("target <> ''")
    targets = with_parts(targets.withColumn("target", F.trim("target")), "url", "a_")
    targets = with_parts(targets.withColumn("there", _absolute(F.col("target"), F.col("url"), F.col("a_rest"))), "there", "b_")
    edges = targets.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def judged_pages(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict.

    rules: host, path and verdict (allow or block), as a list or a table. redirects: further edges as URLs (source, target), e.g.
    from a crawl's log.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, RULES if rules is None else rules)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parts = with_parts(pages.select("page_id", "url"), "url").select("page_id", "host", "path", "node")
    of_node = {"host": F.regexp_extract("node", r"^([^/]*)", 1), "path": F.regexp_extract("node", r"^[^/]*([^?]*)", 1)}
    edges = alias_edges(pages)
    if redirects is not None:
        logged = with_parts(with_parts(redirects.select("source", "target"), "source", "a_"), "target", "b_")
        edges = edges.unionByName(logged.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).distinct()
    labels = materialize(components(edges))
    # spellings of one page, and pages that links join, decide together
    nodes = parts.where("node is not null").select("node", "host", "path").distinct()
    spelled = nodes.select("node", *[v.alias(k) for k, v in of_node.items()])
    linked = labels.select("node", *[v.alias(k) for k, v in of_node.items()])
    places = parts.select("host", "path").unionByName(spelled.select("host", "path")).unionByName(linked.select("host", "path"))
    fits = materialize(rules_that_fit(places, rules))
    votes = linked.join(fits, ["host", "path"]).join(labels, "node").groupBy("label").agg(F.max((F.col("own") == "allow").cast("int")).alias("allows"), F.max((F.col("own") == "block").cast("int")).alias("blocks"))
    passed_on = labels.join(votes, "label").select("node", F.when((F.col("blocks") == 1) & (F.col("allows") == 0), "block").otherwise("allow").alias("passed_on"))
    normal = fits.select(F.col("host").alias("n_host"), F.col("path").alias("n_path"), F.col("own").alias("n_own"))
    judged = parts.join(fits, ["host", "path"], "left").withColumns({"n_host": of_node["host"], "n_path": of_node["path"]})
    judged = judged.join(normal, ["n_host", "n_path"], "left").join(passed_on, "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "n_own", "passed_on", F.lit("allow")).alias("verdict"))


def op7(pages: DataFrame) -> DataFrame:
    return judged_pages(pages)


def op7_sql() -> str:
    """The same rows in DuckDB's SQL, for tables whose links are whole or start with "/", in double quotes, and have no dot segments."""
    host = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"((host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '{p}'))", h + p, v) for h, p, v in ordered]
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    own = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + " end"
    return f"""
with recursive split as (
  select page_id, url, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, html, coalesce({host}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         coalesce(regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1), '') as query from split),
named as (select *, case when host <> '' then host || case when path = '' then '/' else path end || query end as node, {rule} as rule, {own} as own, {own.replace("path", "case when path = '' then '/' else path end")} as normal_own from parts),
tags as (
  select node, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?\\s*canonical\\b[^>]*>')) as tag, 'href' as k from named
  union all
  select node, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b[^>]*>')), 'url' from named),
targets as (select node, regexp_extract(tag, case when k = 'href' then '(?is)\\bhref\\s*=\\s*"([^"]*)"' else '(?is)\\burl\\s*=\\s*([^\\s"'';>]+)' end, 1) as target from tags),
ends as (select node as a, case when instr(target, '://') > 0 then substr(target, instr(target, '://') + 3) else regexp_extract(node, '^([^/]*)', 1) || target end as rest from targets where target <> '' and node is not null),
edges as (select a, {host} || coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) as b from ends),
reach(x, y) as (select a, b from (select a, b from edges union select b, a from edges) union select r.x, e.b from reach r join (select a, b from edges union select b as a, a as b from edges) e on r.y = e.a),
nodes as (select distinct y as node, regexp_extract(y, '^([^/]*)', 1) as host, regexp_extract(y, '^[^/]*([^?]*)', 1) as path from reach),
votes as (select r.x, max(case when {own} = 'allow' then 1 else 0 end) as allows, max(case when {own} = 'block' then 1 else 0 end) as blocks from reach r join nodes on r.y = nodes.node group by r.x)
select page_id, n.host, n.path, n.rule, coalesce(n.own, n.normal_own, case when v.blocks = 1 and v.allows = 0 then 'block' end, 'allow') as verdict
from named n left join votes v on n.node = v.x"""
