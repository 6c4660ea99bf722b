"""URL filtering with redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule (host and path together) wins. A url that no rule fits takes part in its alias group: urls joined by redirect and
canonical-link edges, found as distributed connected components. If a rule blocks a url of the group, the aliases that
no rule fits are blocked too; an explicit allow always holds for the url that it fits. Everything else is allowed.

Rules meet distinct hosts, not pages, so a host with a third of all pages costs one row there; the result is joined
back by host, broadcast only where its counted rows allow it. All of it is DataFrame work on the JVM.

Defined cases: null urls and urls without ``://`` have an empty host and path, no rule, no aliases and are allowed;
links count as elements only, not in comments, scripts or attribute values, and are completed from their page's base
address or url; fragments, a host's letter case, default ports and percent-encoding don't
tell urls apart as aliases; of two rules with the same host and path, block wins; repeated rows each get the verdict; other columns are ignored.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import resolve_url
from .common import stage
from .decontaminate import LOWER, UPPER, _small
from .graph import connected_components

#: The rules of the registered query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _rest(url: str) -> Column:
    return F.expr(f"if(contains({url}, '://'), substring({url}, locate('://', {url}) + 3), '')")


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(urls: DataFrame, rules: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``urls`` (with host and path) plus rule and explicit: the longest rule that fits, and its verdict, or nulls."""
    hosts = urls.where("host != ''").select("host").distinct()
    part = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), ".")))
    asked = hosts.select("host", suffix.alias("suffix"))
    rule = F.struct((F.length("rules.host") + F.length("rules.path")).alias("size"), (F.col("rules.verdict") == "block").alias("block"), F.col("rules.path").alias("path"), F.concat("rules.host", "rules.path").alias("rule"))
    fit = asked.join(rules.alias("rules").where("host is not null and path is not null"), F.col("suffix") == F.col("rules.host"))
    known = stage(fit.groupBy(asked["host"]).agg(F.sort_array(F.collect_set(rule), asc=False).alias("known")))
    out = urls.join(_small(known, broadcast_rows), "host", "left")
    best = F.get(F.filter("known", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return out.withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.when(F.col("best.block"), "block").when(~F.col("best.block"), "allow").alias("explicit"))


#: A tag's attributes; a quoted value may hold ``>``, and quotes elsewhere are letters like any other.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+(?:"|\z)|=\s*+'[^']*+(?:'|\z)|[="'])*+(?:>|\z)"""
#: One left-to-right pass over markup: comments, elements whose contents are no elements of the page, other tags, and bogus comments.
TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style|textarea|title|xmp|iframe|noembed|noframes|template)(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>])|\z)"
    rf"|</?[a-z]{_ATTRIBUTES}"
    r"|<[!?/][^>]*+(?:>|\z)"
)
ATTRIBUTE = r"""(?s)[^\s"'>/=][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?"""
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
REFRESH = r"""(?is)^\s*(?=[0-9.])[0-9.]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:'([^']*).*|"([^"]*).*|([^'"].*))$"""


def _unescaped(text: Column) -> Column:
    """``text`` with its character references decoded: numbers, and names of single letters up to U+00FF."""
    names = F.create_map(*(F.lit(part) for name, letter in html5.items() if name.endswith(";") and len(letter) == 1 and letter <= "\xff" for part in ("&" + name, letter)))

    def letter(ref: Column) -> Column:
        number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX](.*);$", 1), 16, 10)).when(ref.startswith("&#"), F.regexp_extract(ref, "^&#(.*);$", 1)).cast("bigint")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(ref.startswith("&#"), point).otherwise(F.try_element_at(names, ref)), ref)

    decoded = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), letter)
    return F.array_join(F.zip_with(F.split(text, REFERENCE), decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, decoded; null where it has none."""
    all_of_them = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]*", ""), F.lit(ATTRIBUTE), F.lit(0))
    first = F.get(F.filter(all_of_them, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name), F.lit(0))
    return _unescaped(F.regexp_replace(F.regexp_replace(first, r"(?s)^[^\s=]+\s*=?\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2"))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) from the canonical links and immediate or timed refreshes among the elements of pages' HTML.

    Comments, scripts, styles, templates (up to their first end tag), other elements of plain text and attribute values
    hold no elements. The page's first base element with an address completes relative targets. References count with
    their semicolon.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where("contains(url, '://')").where(F.col("html").rlike("(?i)<link|<meta"))
    wanted = r"(?is)^<base[\s/].*>$|^<(?:link|meta)[\s/].*(?:canonical|refresh|&).*>$"
    rows = rows.select("url", F.filter(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(wanted)).alias("tags"), F.xxhash64("html").alias("copy"))
    rows = stage(rows.select("url", "copy", F.posexplode("tags").alias("at", "tag")).distinct())
    if not rows.head(1):
        return pages.sparkSession.createDataFrame([], "src string, dst string")
    # each step is staged or a projection of its own, as every use of a column would repeat what it is made of
    names = {name: _attribute(F.col("tag"), name) for name in ("href", "rel", "http-equiv", "content")}
    rows = stage(rows.select("url", "copy", "at", F.lower(F.regexp_extract("tag", "^<([A-Za-z]+)", 1)).alias("kind"), *(value.alias(name) for name, value in names.items())))
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower("rel"), r"[\t\n\f\r ]+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.lower("http-equiv") == "refresh")
    to = F.when(canonical, F.col("href")).when(refresh, F.concat(*(F.regexp_extract("content", REFRESH, i) for i in (1, 2, 3))))
    bases = rows.where("kind = 'base' and href is not null").groupBy("url", "copy").agg(F.min_by("href", "at").alias("to"))
    trimmed = F.regexp_replace(F.regexp_replace("to", r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    completed = F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("to")).when(F.col("to") != "", resolve_url(F.col("to"), F.col("base")))
    bases = stage(bases.select("url", "copy", F.col("url").alias("base"), trimmed.alias("to")))
    bases = stage(bases.select("url", "copy", completed.alias("base")))
    rows = stage(rows.select("url", "copy", to.alias("to")))
    rows = stage(rows.where("to is not null").join(bases, ["url", "copy"], "left").select("url", F.coalesce("base", "url").alias("base"), trimmed.alias("to")))
    return stage(rows.select(F.col("url").alias("src"), completed.alias("dst"))).where("contains(dst, '://')")


def _same(url: str) -> Column:
    """What a url goes by as an alias."""
    return F.coalesce(resolve_url(F.lit(""), F.col(url)), F.regexp_replace(F.col(url), "(?s)#.*$", ""))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", broadcast_rows: int = 100_000) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every row. ``redirects`` has columns src and dst."""
    edges = alias_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select("src", "dst")
        edges = more if edges is None else edges.unionAll(more)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of("url"), "path": path_of("url")})
    out = apply_rules(rows, rules, broadcast_rows)
    if edges is not None:
        edges = stage(edges.where("src is not null and dst is not null").distinct())
        if edges.head(1):
            groups = stage(connected_components(edges.select(_same("src").alias("src"), _same("dst").alias("dst"))))
            nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
            ruled = apply_rules(nodes.withColumns({"host": host_of("node"), "path": path_of("node")}), rules, broadcast_rows)
            blocked = ruled.where("explicit = 'block'").select(_same("node").alias("node")).distinct().join(groups, "node").select("component").distinct()
            tainted = stage(groups.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("tainted")))
            out = out.withColumn("alias", _same("url")).join(_small(tainted, broadcast_rows), "alias", "left")
            return out.select("page_id", "url", "host", "path", "rule", F.coalesce("explicit", F.when(F.col("tainted"), "block").otherwise("allow")).alias("verdict"))
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("explicit", F.lit("allow")).alias("verdict"))


#: The same rows in SQL for DuckDB, for pages that hold no canonical links or refreshes.
ORACLE = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id, url, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), f AS (
  SELECT page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host) + length(r.path) DESC, r.verdict DESC) AS k
  FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
)
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN f ON q.page_id = f.page_id AND k = 1
"""
