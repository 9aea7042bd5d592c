"""URL filter over equivalent addresses.

Allow and block rules name a host with its subdomains and a beginning of the path; the longest that fits decides, and of
an allow and a block rule for the same place the allow rule. An address that no rule names takes the block decision of its
aliases: pages point to other addresses by canonical links and refresh redirects, and a table of redirects may add
more. The connected components over these edges are the classes of aliases. Allow precedence: an address that a rule
allows stays allowed whatever its aliases are; allowing does not spread.

A node is an address without scheme and fragment, its host in lower case (A-Z). Rules are found by equality alone: for
each distinct node the endings of its host meet the hosts of rules, and the beginnings of its path, cut to the lengths
that rules of that host have, meet their paths. So any number of rules and addresses is a join, which Spark broadcasts
or shuffles by size. Pages with one address are folded before that; a class of any size is never gathered.

Defined results: an address that is NULL or has no ``://`` has empty host and path, is no node, and is allowed. Comments
and scripts of a page hold no links; a link without target or to the page itself is none; relative targets start from
the page's address, their dot segments stay as they are. NULL or empty html has no links, rules with a NULL are left
out. Repeated rows are judged each, also those with one ``page_id`` or none. Very long addresses are compared whole.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; NULL where there is none."""
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def _path(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Address without scheme and fragment; NULL without ``://``."""
    rest = _rest(url)
    return F.concat(_host(rest), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.btrim(found, F.lit("\"' \t\r\n")), F.lit("&amp;"), F.lit("&"))


def _targets(html: Column) -> Column:
    """Canonical links and refresh targets of a page, as they are written."""
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    links = F.filter(F.regexp_extract_all(clean, F.lit(r"(?i)(<link\s[^>]*>)"), F.lit(1)), lambda t: F.array_contains(
        F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(clean, F.lit(r"(?i)(<meta\s[^>]*>)"), F.lit(1)), lambda t: F.lower(
        _attribute(t, "http-equiv")) == "refresh")
    refresh = F.transform(metas, lambda t: F.regexp_extract(
        _attribute(t, "content"), r"""(?i)^[0-9.\s]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1))
    found = F.concat(F.transform(links, lambda t: _attribute(t, "href")), refresh)
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(found, lambda t: t != ""))


def _absolute(target: Column, url: Column) -> Column:
    """The target's address, seen from the page's."""
    scheme = F.substring(url, F.lit(1), F.instr(url, "://") - 1)
    rest = _rest(url)
    root = F.concat(scheme, F.lit("://"), _host(rest))
    folder = F.regexp_extract(_path(rest), "(?s)^.*/", 0)
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(
        F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target)).when(
        F.startswith(target, F.lit("/")), F.concat(root, target)).when(
        F.startswith(target, F.lit("?")), F.concat(root, _path(rest), target)).when(
        F.startswith(target, F.lit("#")) | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(
        F.concat(root, F.when(folder == "", "/").otherwise(folder), target))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: nodes of pages and of the addresses they say they stand for."""
    # Inside the array, so that no filter on the nodes repeats what makes them.
    nodes = F.transform(_targets(F.col(html)), lambda t: F.struct(
        node_of(F.col(url)).alias("a"), node_of(_absolute(t, F.col(url))).alias("b")))
    return pages.select(F.explode(nodes).alias("link")).select("link.a", "link.b")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _decided(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``(node, rule, action)`` of the nodes that a rule names."""
    rules = rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), "path").dropna()
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    by_host = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    placed = nodes.select("node", _host(F.col("node")).alias("whole"), _path(F.col("node")).alias("all"))
    # Of a long host only what a rule could equal is cut up.
    short = F.when(F.length("whole") > longest, F.substring("whole", F.length("whole") - longest, F.lit(longest + 1))).otherwise(F.col("whole"))
    labels = F.split(short, r"\.")
    endings = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    named = placed.withColumn("host", F.explode(endings)).join(by_host, "host")
    cut = named.withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("all")))).withColumn(
        "path", F.substring("all", F.lit(1), F.col("length")))
    best = cut.join(rules, ["host", "path"]).groupBy("node").agg(F.max(F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("action") == ALLOW).alias("allows"),
        F.concat("host", "path").alias("rule"), "action")).alias("best"))
    return best.select("node", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
          redirects: DataFrame | None = None) -> DataFrame:
    """``(key, host, path, rule, verdict, component)`` for every page; ``component`` is the smallest alias, NULL without aliases.

    ``redirects`` holds addresses ``(source, target)``.
    """
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    tied = components(edges.filter("a <> b").distinct())
    rest = _rest(F.col(url))
    narrow = pages.select(
        F.col(key), F.coalesce(_host(rest), F.lit("")).alias("host"), F.coalesce(_path(rest), F.lit("")).alias("path"), node_of(F.col(url)).alias("node"))
    nodes = narrow.select("node").dropna().unionAll(tied.select(F.col("id").alias("node"))).distinct()
    decided = _decided(nodes, rules)
    aliases = tied.withColumnRenamed("id", "node").join(decided.filter(F.col("action") == BLOCK).select("node", F.lit(True).alias("bad")), "node", "left")
    classes = aliases.groupBy("component").agg(F.coalesce(F.max("bad"), F.lit(False)).alias("blocked"))
    known = nodes.join(decided, "node", "left").join(
        tied.withColumnRenamed("id", "node").join(classes, "component"), "node", "left").select("node", "rule", "action", "blocked", "component")
    # Pages without an address meet nothing; a key of their own each lets them spread.
    spread = narrow.withColumn("node", F.coalesce("node", F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))))
    verdict = F.coalesce("action", F.when(F.col("blocked"), BLOCK), F.lit(ALLOW))
    return spread.join(known, "node", "left").select(key, "host", "path", "rule", verdict.alias("verdict"), "component")
