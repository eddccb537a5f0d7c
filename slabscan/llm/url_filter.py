"""URL filter: host and path rules, and block decisions that follow redirects and canonical links.

A url's own rule decides; of several that fit the longest wins.  A url
without a rule takes the decision of its aliases: the connected component over
redirect edges (meta refresh), canonical-link edges and equal canonical forms
of urls.  An explicit allow anywhere in the component goes before any block
there; a component without either is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import stored
from slabscan.llm.components import connected_components

#: Rules up to this many are part of the expression; more become a join on the host's suffixes.
INLINE_RULES = 64

#: Query parameters that don't change the page.
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|ref)=[^&]*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """The url without scheme, www., fragment, tracking parameters and a slash at the end; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), rf"(^|&){TRACKING}", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``, null where none fits; ``pages`` has host and path."""
    if len(rules) <= INLINE_RULES:
        out = F.lit(None).cast("struct<rule:string,verdict:string>")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
            fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
            out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
        return pages.withColumn("_rule", out).select(*pages.columns, F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("rule_verdict"))
    table = pages.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    # Each distinct (host, path) meets its host's suffixes once.
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    targets = pages.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fit = targets.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("_best"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "_best.rule", "_best.rule_verdict")


#: The target of a canonical link and of a meta refresh, whatever the order of the tag's attributes.
CANONICAL_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)"


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute url, seen from the page ``url``; null for other schemes and fragments."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    head, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(head.startswith("/"), head).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), head))
    # Segments in order, without those that .. takes back.
    segments = F.split(F.regexp_replace(joined, r"/\.{1,2}$", "$0/"), "/")
    step = lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(s)))
    clean = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    near = F.concat(origin, F.when(head == "", path).otherwise(clean), tail)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(origin != "", near)
    )


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) urls of the page and the target of each of its canonical links and meta refreshes."""
    html = F.col(html_col)
    likely = pages.where(html.rlike("(?i)canonical|http-equiv"))
    found = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL_LINK), 1), F.regexp_extract_all(html, F.lit(META_REFRESH), 1))
    targets = likely.select(F.col(url_col).alias("_url"), F.explode(found).alias("_to"))
    to = F.regexp_replace("_to", "(?i)&(?:amp|#38|#x26);", "&")
    return targets.select(F.col("_url").alias("a"), resolved(to, F.col("_url")).alias("b")).where("a is not null and b is not null")


def node_of(form: Column) -> Column:
    return F.unhex(F.md5(form))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, by_alias.

    ``edges`` may add further (a, b) urls of known redirects.  The rules of all
    ends of edges count, whether or not they are pages.  A null url, or
    one without ``://``, has an empty host and path, no alias, and is allowed
    unless a rule fits.  Of fitting rules of equal length the one that is later
    in byte order decides.  Repeated rows and ids give a row each; null html
    has no links; very long html is searched whole; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    url = F.col(url_col)
    links = html_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    links = stored(links.where(canonical_form(F.col("a")).isNotNull() & canonical_form(F.col("b")).isNotNull()).distinct())
    groups = connected_components(links.select(node_of(canonical_form(F.col("a"))).alias("a"), node_of(canonical_form(F.col("b"))).alias("b")))
    base = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(canonical_form(url)).alias("_node"))
    judged = stored(match_rules(base, rules))
    # The ends of links count by their rules too, whether or not they are pages.
    ends = links.select(F.explode(F.array("a", "b")).alias("_end")).distinct()
    ends = ends.select(host_of(F.col("_end")).alias("host"), path_of(F.col("_end")).alias("path"), node_of(canonical_form(F.col("_end"))).alias("_node"))
    known = judged.select("_node", "rule_verdict").unionByName(match_rules(ends, rules).select("_node", "rule_verdict"))
    decided = known.where("rule_verdict is not null and _node is not null").groupBy("_node", "rule_verdict").agg(F.lit(1).alias("_one"))
    component = F.coalesce("component", "_node")
    votes = decided.join(groups, F.col("_node") == F.col("node"), "left").groupBy(component.alias("_group")).agg(F.max(F.col("rule_verdict") == "allow").alias("_allowed"))
    blocked = votes.where("not _allowed").select("_group")
    aliases = groups.join(blocked, F.col("component") == F.col("_group"), "left_semi").select(F.col("node").alias("_alias"))
    # A blocked component is its nodes; one of a single node is not in `groups`.
    aliases = aliases.unionByName(blocked.select(F.col("_group").alias("_alias"))).distinct()
    own = judged.where("rule is not null").select(id_col, "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(False).alias("by_alias"))
    rest = judged.where("rule is null").join(aliases, F.col("_node") == F.col("_alias"), "left")
    hit = F.col("_alias").isNotNull()
    return own.unionByName(rest.select(id_col, "host", "path", "rule", F.when(hit, "block").otherwise("allow").alias("verdict"), hit.alias("by_alias")))
