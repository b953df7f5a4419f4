"""URL filter: block and allow rules that reach aliases over redirects and canonical links.

Rules match hosts with their subdomains and a start of the path. URLs that a
redirect or a canonical link joins are one resource: its component over these
edges is blocked if a rule blocks a member and no rule allows one. A URL that
a rule matches itself keeps that rule's verdict; all else is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage
from .components import connected_components
from .words import unused_name

#: More rules than this do not belong in one expression.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str  # in lower case; subdomains are meant too
    path: str  # start of the path

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

# Comments and scripts hold no links.
_UNSEEN = r"(?s)<!--.*?-->|(?i)<script\b.*?</script\s*>"
_LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
_REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_TARGET = r"(?i)url\s*=\s*['\"]?([^'\">\s]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, in lower case; empty for null or no `://`."""
    return lower_ascii(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def resource_of(url: Column) -> Column:
    """What is asked for: host, path and query, without scheme and fragment; null without `://`."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...], give: str) -> Column:
    """`name` or `verdict` of the longest rule that fits, else null; among equals a blocking rule wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda rule: (-len(rule.name), rule.verdict != "block", rule.name))
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, give))).otherwise(found)
    return found


def _resolved(link: Column, url: Column) -> Column:
    """An absolute URL for a link on the page `url`."""
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    origin = F.regexp_extract(url, r"^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", F.lit(None))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """`source` and `target` URLs: canonical links and refresh redirects in the whole html of `pages`.

    A page without url or html, or without such a tag, gives no row.
    """
    named = pages.select(F.col("url").alias("_url"), F.col("html").alias("_html"))
    wanted = named.filter("_url is not null and _html rlike '(?i)canonical|http-equiv'")
    seen = wanted.withColumn("_html", F.regexp_replace("_html", _UNSEEN, " "))
    tags = seen.select(
        "_url",
        F.concat(
            F.transform(
                F.regexp_extract_all("_html", F.lit(_LINK_TAG), F.lit(0)),
                lambda tag: F.concat(*(F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3))),
            ),
            F.transform(
                F.regexp_extract_all("_html", F.lit(_REFRESH_TAG), F.lit(0)),
                lambda tag: F.regexp_extract(tag, _TARGET, 1),
            ),
        ).alias("_links"),
    )
    link = F.trim(F.replace(F.col("_link"), F.lit("&amp;"), F.lit("&")))
    return (
        tags.select("_url", F.explode("_links").alias("_link"))
        .select(F.col("_url").alias("source"), _resolved(link, F.col("_url")).alias("target"))
        .filter("target is not null")
    )


def alias_verdicts(links: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`resource` and `alias_verdict` (block or allow) of every end of a link between two resources.

    `links` has the URLs `source` and `target`; rows without `://` are left out.
    """
    ends = links.select(F.col("source").alias("url")).unionByName(links.select(F.col("target").alias("url")))
    known = ends.select(
        resource_of(F.col("url")).alias("node"),
        matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules, "verdict").alias("own"),
    ).filter("node is not null")
    edges = links.select(
        resource_of(F.col("source")).alias("source"), resource_of(F.col("target")).alias("target")
    ).filter("source <> target")
    labels = connected_components(edges, "source", "target")
    verdicts = (
        known.distinct()
        .join(labels, "node")
        .groupBy("component")
        .agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
        .select(
            "component",
            F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block")
            .otherwise("allow")
            .alias("alias_verdict"),
        )
    )
    return labels.join(verdicts, "component").select(F.col("node").alias("resource"), "alias_verdict")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """`pages` with `host`, `path`, `rule` and `verdict`, one row for each row.

    `redirects` (`source`, `target` URLs) adds links to those in the pages. A
    null url, or one without `://`, has an empty host and path and no alias.
    Repeated rows are judged alike; other columns stay, but for those of the
    four names, which are replaced.
    """
    links = stage(page_links(pages), "links")
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own, resource, alias, alias_verdict = (unused_name(pages.columns, n) for n in ("own", "resource", "alias", "alias_verdict"))
    judged = pages.withColumns(
        {
            "host": host,
            "path": path,
            "rule": matching_rule(host, path, rules, "name"),
            own: matching_rule(host, path, rules, "verdict"),
            resource: resource_of(F.col("url")),
        }
    )
    aliases = alias_verdicts(links, rules).toDF(alias, alias_verdict)
    joined = judged.join(aliases, F.col(resource) == F.col(alias), "left")
    verdict = F.coalesce(own, alias_verdict, F.lit("allow"))
    return joined.withColumn("verdict", verdict).drop(own, resource, alias, alias_verdict)
