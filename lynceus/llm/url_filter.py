"""URL filter with redirect equivalence, in DataFrame functions only.

Rules name a host with its subdomains and a path prefix; the longest fitting rule
decides a url. Urls without a rule take the decision of their aliases: canonical
links and redirects are edges, connected components are the sets of aliases, a
component with an allowed member is allowed, else one with a blocked member is
blocked. An explicit rule always decides its own urls, whatever the aliases say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, broadcast_if, connected_components, materialize

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
IS_CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
IS_REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
#: What is no markup: comments (an open one reaches to the end), scripts and styles.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: An attribute's value in double, in single or without quotes; and the target in the value of a refresh.
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
CONTENT = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*))"
SPACES = " \t\n\f\r"
ABSOLUTE = r"(?i)^[a-z][a-z0-9+.-]*://"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
#: With more rules than this, urls are joined with the rules instead of testing each rule in place.
RULES_IN_PLACE = 256
#: Rows that a set of alias verdicts may have to be broadcast.
BROADCAST_ROWS = 500_000


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node(url: Column) -> Column:
    """A url as a node of the alias graph: without fragment, scheme and host in lower case."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(_lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def _without_dots(url: Column) -> Column:
    """An absolute url with the segments . and .. of its path resolved."""
    head, own = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path(url)
    rest = F.substring(url, F.length(head) + F.length(own) + 1, F.length(url))
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    segments = F.aggregate(F.split(F.substring(own, 2, F.length(own)), "/"), F.array().cast("array<string>"), step)
    end = F.when(own.rlike(r"/\.\.?$") & (F.size(segments) > 0), "/").otherwise("")
    return F.when(own.rlike(r"/\.\.?(?:/|$)"), F.concat(head, F.lit("/"), F.array_join(segments, "/"), end, rest)).otherwise(url)


def resolved(page: Column, link: Column) -> Column:
    """The absolute url that ``link``, as written in an attribute, has on ``page``; null where it names no place (mailto: and the like)."""
    to = F.regexp_replace(link, AMPERSAND, "&")
    head = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.regexp_replace(page, r"(?s)#.*$", "")
    bare = F.concat(head, F.when(path(page) == "", "/").otherwise(path(page)))
    found = (
        F.when(to.rlike(ABSOLUTE), to)
        .when(to.rlike(SCHEME), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(head, to))
        .when(to.startswith("?"), F.concat(bare, to))
        .when(to.startswith("#"), F.concat(whole, to))
        .otherwise(F.concat(F.regexp_extract(bare, r"(?s)^(.*/)", 1), to))
    )
    return _without_dots(found)


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length the longer host, then the text."""
    return sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))


def _rule_in_place(rules: Sequence[tuple[str, str, str]]) -> Column:
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    found = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
            F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in _ordered(rules)
    ]
    return F.coalesce(*found)


def _rule_by_join(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """As _rule_in_place for many rules: the host's suffixes meet the rules' hosts."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(_ordered(rules))], "rank int, rule_verdict string, rule_host string, rule_path string")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.select("uid", "path", F.explode(suffixes).alias("rule_host")).join(broadcast_if(table, 100_000), "rule_host")
    best = met.where(F.col("path").startswith(F.col("rule_path"))).groupBy("uid").agg(
        F.min_by(F.struct(F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule")), "rank").alias("own")
    )
    return urls.join(best, "uid", "left")


def _with_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    if len(rules) > RULES_IN_PLACE:
        return _rule_by_join(materialize(urls, "urls"), rules)
    return urls.withColumn("own", _rule_in_place(rules))


def _value(pattern: str, text: Column) -> Column:
    """The group of ``pattern`` that matched, without white space around."""
    return F.btrim(F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3))), F.lit(SPACES))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from pages to their canonical and refresh targets; relative targets are resolved on the page's url.

    Quoted targets may hold blanks and the other quote. Links in comments, scripts and styles don't count.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), NO_MARKUP, " "), F.lit(TAG), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(IS_CANONICAL)), lambda t: _value(HREF, t))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(IS_REFRESH)), lambda t: _value(REFRESH_URL, _value(CONTENT, t)))
    links = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("from"), F.explode(F.concat(canonical, refresh)).alias("to"))
    to = resolved(F.col("from"), F.col("to"))
    return links.where(F.col("from").contains("://") & (F.col("to") != "")).select(
        node(F.col("from")).alias("a"), node(to).alias("b")
    ).where("a is not null and b is not null and a <> b").distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", html: str | None = "html",
    key: str = "page_id", redirects: DataFrame | None = None,
) -> DataFrame:
    """key, host, path, rule, verdict and alias_of_rule for each row of ``pages``.

    ``rules``: (allow or block, host, path). ``redirects``: further edges, columns a
    and b, as urls. A null url, or one without ``://``, has empty host and path and
    no aliases; no rule fits it and it is allowed. Null html has no links. Repeated
    rows are judged each for itself. An empty table gives an empty result; other
    columns are ignored.
    """
    target = F.col(url).cast("string")
    urls = pages.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), host(target).alias("host"), path(target).alias("path"),
                        F.when(target.contains("://"), node(target)).alias("node"))
    judged = _with_rules(urls, rules)
    edges = page_links(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(node(F.col("a").cast("string")).alias("a"), node(F.col("b").cast("string")).alias("b")).where("a <> b").distinct()
        edges = more if edges is None else edges.union(more).distinct()
    no_rule = F.lit("allow")
    if edges is not None:
        edges = materialize(edges, "links")
        if edges.isEmpty():
            edges = None
    if edges is None:
        verdict = F.coalesce("own.verdict", no_rule)
    else:
        parts = materialize(connected_components(edges), "aliases")
        named = parts.select("node", "component", F.monotonically_increasing_id().alias("uid"), host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
        said = _with_rules(named, rules).where("own is not null").groupBy("component").agg(
            F.min("own.verdict").alias("alias_verdict")  # allow sorts before block
        )
        said = materialize(said, "said")
        aliases = materialize(parts.join(broadcast_if(said, BROADCAST_ROWS), "component").select("node", "alias_verdict"), "verdicts")
        judged = judged.join(broadcast_if(aliases, BROADCAST_ROWS), "node", "left")
        verdict = F.coalesce("own.verdict", "alias_verdict", no_rule)
    return judged.select(F.col("key").alias(key), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
