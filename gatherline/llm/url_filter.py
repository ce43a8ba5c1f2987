"""URL filters: host and path rules, and block decisions that pass to aliases over redirect and canonical links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.shared import hot_join, min_labels, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, allow?)
RULES = (("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True))
#: Patterns for both engines: tags, what makes a tag a canonical link or a refresh, and where it points.
LINK_TAG, META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
REFRESH = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF = r"""(?is)[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TARGET = r"""(?is)[\s"'/]content\s*=.*?\burl\s*=\s*["']?([^"'\s>]+)"""
#: What one page's URLs often differ in, for ``forms``: a host's first label, and parameters.
HOST_FORM, EXTRA = r"^(?:www[0-9]*|m|mobile)\.([^.]+\..*)$", r"^(?:utm_[^=]*|ref|page|gclid|fbclid)?(?:=.*)?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as STRUCT<rule, allow>, or null. Of equal length the first by code point."""
    fits = []
    for h, p, allow in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(allow).alias("allow"))))
    return F.coalesce(*fits)


def node_of(url: Column) -> Column:
    """A URL's name as a node: without scheme, fragment and default port, A-Z of the host lower-cased."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[^/?#]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    return F.concat(F.regexp_replace(F.translate(host, UPPER, LOWER), r":(?:80|443)$", ""), F.substr(rest, F.length(host) + 1))


def form_of(node: Column) -> Column:
    """The form that many sites redirect a page's URLs to: also without ``www.`` or ``m.``, closing slashes, and
    parameters that count visits (``utm_*``, ``ref``, ``gclid``, ``fbclid``) or turn over the page's parts (``page``).
    No link says so, and other sites mean other pages by it. Null for null."""
    host = F.regexp_replace(F.regexp_extract(node, r"^[^/?]*", 0), HOST_FORM, "$1")
    path = F.regexp_replace(F.regexp_extract(node, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.array_join(F.filter(F.split(F.regexp_extract(node, r"\?([\s\S]*)$", 1), "&", -1), lambda x: ~x.rlike(EXTRA)), "&")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def resolved(link: Column, url: Column) -> Column:
    """``link`` as an absolute URL seen from ``url``; null if empty or not of the web."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract(url, r"^([^/?#]*:)//", 1), F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(url, r"[?#][\s\S]*$", ""), r"^([^/]*//[^/]*(?:/.*)?/)[^/]*$", 1)
    folder = F.when((folder == "") | folder.endswith("://"), F.concat(site, F.lit("/"))).otherwise(folder)
    full = F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, link))
    return F.when((link != "") & (site != "") & ~link.startswith("#"), full)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: nodes that a canonical link or a refresh redirect of a page makes aliases; all tags of a page count."""
    url = F.col(url_col)
    href = lambda tag: F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])
    canonical = F.transform(F.filter(F.regexp_extract_all(html_col, F.lit(LINK_TAG), 0), lambda t: t.rlike(CANONICAL)), lambda t: resolved(href(t), url))
    refresh = F.transform(F.filter(F.regexp_extract_all(html_col, F.lit(META_TAG), 0), lambda t: t.rlike(REFRESH)), lambda t: resolved(F.regexp_extract(t, TARGET, 1), url))
    found = pages.where(url.contains("://")).select(url.alias("from"), F.explode(F.array_compact(F.concat(canonical, refresh))).alias("to"))
    return found.select(node_of(F.col("from")).alias("a"), node_of(F.col("to")).alias("b")).where("a <> b").distinct()


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, forms: bool = False, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: canonical links, refresh redirects and given ``redirects(a, b)`` of URLs; with ``forms`` also that of each node.

    A form that one node alone has can pass nothing on and is left out, unless it is a node itself, with a form of its
    own: ``www.m.x`` has the form ``m.x``, and that has ``x``.
    """
    named = links(pages, url_col, html_col)
    if redirects is not None:
        named = named.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    if not forms:
        return named
    named = written(named, "url-links")
    nodes = pages.where(F.col(url_col).contains("://")).select(node_of(F.col(url_col)).alias("a")).unionByName(named.select(F.explode(F.array("a", "b")).alias("a"))).distinct()
    formed = written(nodes.select("a", form_of(F.col("a")).alias("b")), "url-forms")
    bearers = formed.select("b").unionByName(formed.where("a <> b").select(F.col("a").alias("b")))
    several = bearers.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    return named.unionByName(hot_join(formed, several, ["b"], "n", formed.count()).where("a <> b").select("a", "b"))


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, forms: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict, alias_of_blocked``.

    A page with a rule of its own has that rule's verdict: explicit rules, allow among them, go before anything
    passed on. Any other page is blocked if its URL is an alias of a blocked one: if its component over the edges
    (see ``alias_edges``) holds a node that a rule blocks. The rest is allowed. URLs are one node if they differ in
    scheme, fragment, default port and the host's case alone; other forms of a page are aliases only with ``forms``.

    Null URLs, and such without ``://``, have empty host and path, no rule, and are allowed; null html has no links.
    Whole texts of any length are searched for links. Repeated rows are judged alike; an empty table gives no rows;
    other columns are not read.
    """
    edges = written(alias_edges(pages, redirects, forms, url_col, html_col), "url-edges")
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.when(F.col(url_col).contains("://"), node_of(F.col(url_col))).alias("_node"))
    out = out.withColumn("_hit", rule_of(F.col("host"), F.col("path"), rules))
    bad = lambda node: F.coalesce(~rule_of(*host_and_path(F.concat(F.lit("://"), node)), rules)["allow"], F.lit(False))
    labels = written(min_labels(edges), "url-labels")
    blocked = labels.where(bad(F.col("id"))).select("component").distinct()
    names = labels.join(blocked, "component", "left_semi").select(F.col("id").alias("_name"), F.lit(True).alias("_alias"))
    out = out.join(names, F.col("_node") == F.col("_name"), "left")
    # a page's own node, and its form, belong to its component also without an edge
    alias = F.coalesce("_alias", F.lit(False)) | bad(F.col("_node"))
    if forms:
        alias = alias | bad(form_of(F.col("_node")))
    allow = F.coalesce(F.col("_hit.allow"), ~alias)
    return out.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), alias.alias("alias_of_blocked"))


def _rule_sql(host: str, path: str) -> tuple[str, str]:
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    test = lambda h, p: f"({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '{p}')"
    return tuple("CASE " + reduce(lambda s, r: f"{s} WHEN {test(r[0], r[1])} THEN {value(r)}", ranked, "") + " END" for value in (lambda r: f"'{r[0] + r[1]}'", lambda r: str(r[2]).lower()))


def _host_sql(url: str) -> tuple[str, str]:
    rest = f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '')"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _node_sql(url: str) -> str:
    rest = f"regexp_replace(regexp_replace({url}, '^[^/?#]*://', ''), '#[\\s\\S]*$', '')"
    host = f"regexp_extract({rest}, '^[^/?]*')"
    return f"(regexp_replace(translate({host}, '{UPPER}', '{LOWER}'), ':(?:80|443)$', '') || substr({rest}, length({host}) + 1))"


_LINK = """CASE WHEN l = '' OR l IS NULL OR starts_with(l, '#') THEN NULL WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '^([^/?#]*:)//', 1) || l
 WHEN starts_with(l, '/') THEN regexp_extract(url, '^[^/?#]*://[^/?#]*') || l ELSE regexp_extract(regexp_replace(url, '[?#][\\s\\S]*$', ''), '^([^/]*//[^/]*(?:/.*)?/)[^/]*$', 1) || l END"""
_HREF = " || ".join(f"regexp_extract(tag, {_sql(HREF)}, {i})" for i in (1, 2, 3))

ORACLE = f"""
WITH RECURSIVE own AS (SELECT DISTINCT url, html FROM pages WHERE contains(url, '://')),
tags AS (
  SELECT url, {_HREF} AS tag FROM (SELECT url, unnest(regexp_extract_all(html, {_sql(LINK_TAG)})) AS tag FROM own) WHERE regexp_matches(tag, {_sql(CANONICAL)})
  UNION ALL SELECT url, regexp_extract(tag, {_sql(TARGET)}, 1) FROM (SELECT url, unnest(regexp_extract_all(html, {_sql(META_TAG)})) AS tag FROM own) WHERE regexp_matches(tag, {_sql(REFRESH)})),
links AS (SELECT url, trim(replace(tag, '&amp;', '&')) AS l FROM tags),
named AS (SELECT {_node_sql("url")} AS a, {_node_sql("t")} AS b FROM (SELECT url, {_LINK} AS t FROM links) WHERE t IS NOT NULL),
nodes AS (SELECT {_node_sql("url")} AS a FROM own),
sides AS (SELECT a, b FROM named UNION SELECT b, a FROM named UNION SELECT a, a FROM nodes),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
blocked AS (SELECT DISTINCT a FROM reach WHERE {_rule_sql(*_host_sql("('://' || b)"))[1]} = false)
SELECT page_id, {_host_sql("url")[0]} AS host, {_host_sql("url")[1]} AS path, {_rule_sql(*_host_sql("url"))[0]} AS rule,
       CASE WHEN coalesce({_rule_sql(*_host_sql("url"))[1]}, blocked.a IS NULL) THEN 'allow' ELSE 'block' END AS verdict
FROM pages LEFT JOIN blocked ON contains(url, '://') AND blocked.a = {_node_sql("url")}
"""
