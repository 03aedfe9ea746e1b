"""URL filters with redirect equivalence.

A url is judged by the longest rule (host with its subdomains, and path prefix) that fits it. Where no rule fits, the
url's aliases decide: edges join a page to the target of its redirect (a refresh element), to its declared canonical
link, and to its url's canonical form (no scheme, fragment, www. or tracking parameters); connected components of
these edges are sets of aliases. If a rule blocks a url of the set, be it a page or only the end of a redirect or
canonical link, those without a rule are blocked too; a url that a rule allows stays allowed, whatever its aliases are. Rules are a parameter, a list of a length that was chosen by
whoever wrote it, and are evaluated in the row. Edges and components are tables throughout; urls stand in them as
128-bit hashes.

Edge cases: a null url, or one without "://", has the empty host and path, no rule and no aliases, and is allowed. A
null html declares nothing. Rows that repeat a page id or a url are judged each, alike for one url. An empty table gives an empty
result. Other columns of the input are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.llm.common import Scratch, ascii_lower
from foretable.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"), UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"), UrlRule("net", "/fr/", "block"),
)
#: Query parameters that tell where a visitor came from, not what the page is.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits; null if none does."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    found = F.array(*(F.when(fits(r), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules))
    return F.array_max(F.array_compact(found))


def canonical_form(url: Column) -> Column:
    """host and path without www. and a final slash, and what the query holds besides tracking parameters, in its order."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~F.rlike(x, F.lit(f"^(({TRACKING})=.*)?$"))), "&")
    return F.concat(F.lit("//"), F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """target as an absolute url, taken from a page at base (which has a scheme); null where it is empty, a fragment, or of
    a scheme without a host. Segments . and .. of relative targets are worked out."""
    at = lambda i: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)", i)
    cut = F.regexp_extract(target, r"^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 2)
    whole = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(at(3), r"^(.*/)", 1), F.lit("")), F.lit("/")), cut))
    steps = F.split(F.concat(whole, F.when(F.rlike(whole, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))), "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x))
    clean = F.when(F.contains(whole, F.lit("/.")), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")).otherwise(whole)
    return (
        F.when(F.rlike(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.rlike(target, F.lit("^([A-Za-z][A-Za-z0-9+.-]*:|#|$)")), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(at(1), target))
        .when(target.startswith("?"), F.concat(at(1), at(2), at(3), target))
        .otherwise(F.concat(at(1), at(2), clean, rest))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute (in either quotes, or in none), '' if it has none. Attributes are read from left to
    right, so that nothing within another one's value counts."""
    parts = F.regexp_extract_all(tag, F.lit(r"""((?<![^\s"'/])[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))"""), 1)
    held = F.filter(parts, lambda x: F.rlike(x, F.lit(rf"(?i)^{name}\s*=")))
    value = F.regexp_extract(F.coalesce(F.try_element_at(held, F.lit(1)), F.lit("")), r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.trim(F.when(F.rlike(value, F.lit("""^["']""")), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


#: The target in the content of a refresh: after the seconds, with url= or without it, in quotes of its own or in none.
_REFRESH = r"""(?is)^(?:\s*[0-9.]*+[\s;,]++(?:url\s*+=\s*+)?+|.*?\burl\s*=\s*)(?:"([^"]*)|'([^']*)|([^\s"']\S*))"""


def declared_targets(html: Column, url: Column) -> Column:
    """Absolute urls that a page at url names as its canonical link or redirects to. Relative ones start from its base element, if it has one."""
    tags = F.regexp_extract_all(html, F.lit("(?i)(<(?:link|meta|base)\\b[^>]*>)"), 1)
    of = lambda start: F.filter(tags, lambda t: F.rlike(t, F.lit(start)))
    canonical = F.filter(of(r"(?is)^<link\b.*canonical"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(of(r"(?is)^<meta\b.*refresh"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    content = F.transform(refresh, lambda t: _attribute(t, "content"))
    targets = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(content, lambda c: F.trim(F.concat(*(F.regexp_extract(c, _REFRESH, i) for i in (1, 2, 3))))))
    base = F.coalesce(resolved(_attribute(F.try_element_at(of(r"(?is)^<base\b.*href"), F.lit(1)), "href"), url), url)
    return F.filter(F.transform(targets, lambda t: resolved(t, base)), lambda u: u.isNotNull())


def alias_edges(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, bad): 128-bit hashes of a page's url and of an alias, for urls that have a host; bad where b stands for a
    declared target that a rule blocks, as it is written (a canonical form has lost its www. and is never judged)."""
    url = F.col(url_col)
    targets = F.transform(F.coalesce(declared_targets(F.col(html_col), url), F.array().cast("array<string>")), lambda t: F.struct(canonical_form(t).alias("form"), _blocked(t, rules).alias("bad")))
    aliases = F.concat(F.array(F.struct(canonical_form(url).alias("form"), F.lit(False).alias("bad"))), targets)
    return pages.where(F.contains(url, F.lit("://"))).select(_key(url).alias("a"), F.explode(aliases).alias("alias")).select("a", _key(F.col("alias.form")).alias("b"), "alias.bad").distinct()


def _blocked(url: Column, rules: tuple[UrlRule, ...]) -> Column:
    return F.coalesce(longest_rule(host(url), path(url), rules)["verdict"] == "block", F.lit(False))


def _key(url: Column) -> Column:
    return F.unhex(F.md5(url))


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict. redirects: (from, to), more edges between urls;
    to may be relative to from, which has a scheme."""
    edges = alias_edges(pages, rules, url_col, html_col)
    if redirects is not None:
        start, end = (F.col(c) for c in redirects.columns[:2])
        more = redirects.select(start.alias("f"), resolved(F.trim(end), start).alias("t")).where("contains(f, '://') AND t IS NOT NULL")
        f, t = F.col("f"), F.col("t")
        # the judged end of each pair stands in b
        pairs = F.array(*(F.struct(_key(x).alias("a"), _key(y).alias("b"), bad.alias("bad")) for x, y, bad in ((f, t, _blocked(t, rules)), (canonical_form(f), f, _blocked(f, rules)), (t, canonical_form(t), F.lit(False)))))
        edges = edges.unionByName(more.select(F.inline(pairs)))
    scratch = Scratch(pages.sparkSession, "urls")
    edges = scratch.store(edges, "links")
    component = connected_components(edges.select("a", "b"), scratch, "aliases")
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), F.when(F.contains(url, F.lit("://")), _key(url)).alias("node"))
    judged = judged.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.join(component, "node", "left")
    named = edges.where("bad").select(F.col("b").alias("node")).distinct().join(component, "node").select("component")
    blocked = judged.where("own.verdict = 'block' AND component IS NOT NULL").select("component").unionByName(named)
    blocked = scratch.store(blocked.distinct(), "blocked").select(F.col("component").alias("bad"))
    scratch.drop("links")
    judged = judged.join(blocked, F.col("component") == F.col("bad"), "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("bad").isNotNull(), F.lit("block")), F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
