"""Operator 3 [native]: URL rules over classes of redirect-equivalent addresses.

A page's address, the canonical address that it names and the target of a meta
refresh are the same resource; so are pairs of a given redirect table.  Connected
components over these edges make classes.  A rule that fits an address decides
for it (the longest rule wins); an address without a rule takes its class's
decision: allow if a rule allows any address of the class, else block if a rule
blocks one, else allow.  Addresses that are only targets of links count as well.

An address is a node without its fragment, with its host in lower case.  All of
it is DataFrame functions; rules are a short list and become part of the
expressions.

Results for odd input: a null url or one without ``://`` has empty host and path,
no rule, and is allowed; null html has no links; relative targets are resolved
against the page; rows that repeat a page_id or url are judged each; an empty
table gives no rows; columns other than ``page_id``, ``url``, ``html`` are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import Stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"

#: (host, path, verdict) of the registered query. FIXED VALUES of its contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3)


def address(url: Column) -> Column:
    """The node of a url: its scheme and host in lower case, path (at least /) and query; no fragment."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.translate(site, _UPPER, _LOWER), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(host, path, verdict) of the longest rule that fits, else null."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in longest_first])
    return F.get(F.filter(table, lambda r: ((host_ == r["host"]) | host_.endswith(F.concat(F.lit("."), r["host"]))) & path_.startswith(r["path"])), 0)


def _resolved(links: DataFrame) -> DataFrame:
    """(src, dst) of (src, target): the absolute address of each link target on its page."""
    parts = links.select("src", F.regexp_replace(F.trim("target"), "&amp;", "&").alias("target"), *[F.regexp_extract("src", _PARTS, k).alias(f"p{k}") for k in (1, 2, 3)])
    parts = parts.select("src", "target", "p1", F.concat("p1", F.lit("://"), "p2").alias("site"), F.regexp_replace("p3", "[^/]*$", "").alias("folder"))
    target = F.col("target")
    dst = (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
           .when(target.startswith("//"), F.concat("p1", F.lit(":"), target))
           .when(target.startswith("/"), F.concat("site", target))
           .when((target != "") & ~target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat("site", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), target)))
    return parts.select("src", dst.alias("dst")).where("dst is not null")


def html_links(pages: DataFrame) -> DataFrame:
    """(src, dst) urls: canonical links and meta refreshes of (url, html)."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    # a look for the words first: most pages have neither
    marked = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    each = marked.select("url", F.explode(tags).alias("tag"))
    attribute = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def value(name):
        return F.concat(*[F.regexp_extract("tag", rf"(?is)\b{name}{attribute}", k) for k in (1, 2, 3)])
    each = each.select(F.col("url").alias("src"), F.col("tag").rlike("(?i)^<link").alias("is_link"), F.lower(value("rel")).alias("rel"), value("href").alias("href"),
                       F.lower(F.trim(value("http-equiv"))).alias("equiv"), value("content").alias("content"))
    target = (F.when(F.col("is_link") & F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href"))
              .when(~F.col("is_link") & (F.col("equiv") == "refresh"), F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)))
    return _resolved(each.select("src", target.alias("target")).where("target is not null"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page of (page_id, url, html).

    redirects: further (src, dst) pairs of urls that lead to the same resource."""
    stage = Stage(pages.sparkSession, "urls")
    edges = html_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = edges.where("contains(src, '://') and contains(dst, '://')").select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst"))
    edges = stage.keep(edges.select("src", "dst", F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d")).distinct(), "edges")
    component = stage.keep(connected_components(edges.select(F.col("s").alias("src"), F.col("d").alias("dst")), stage), "component")
    nodes = edges.select(F.col("src").alias("node"), F.col("s").alias("id")).union(edges.select("dst", "d")).distinct()
    own = nodes.select("id", rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"].alias("verdict")).where("verdict is not null")
    decided = (own.join(component, "id").groupBy("component")
               .agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed")).select("component", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("spread")))
    spread = component.join(decided, "component").select("id", "spread").distinct()
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.when(F.contains(F.col("url"), F.lit("://")), F.xxhash64(address(F.col("url")))).alias("id"))
    judged = judged.select("page_id", F.col("host"), F.col("path"), "id", rule_of(F.col("host"), F.col("path"), rules).alias("own"))
    return judged.join(spread, "id", "left").select(
        "page_id", judged["host"], judged["path"], F.concat("own.host", "own.path").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"))
