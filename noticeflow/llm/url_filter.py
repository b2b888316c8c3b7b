"""URL filter with redirect equivalence (DataFrame functions only).

Own rules decide first: host and path-prefix rules, the longest wins.  Block
decisions then spread to aliases: addresses that redirect or canonical links
connect, in any number of steps, share a component, and a component that holds
a blocked address blocks every member that no allow rule names itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.graph import connected_components
from noticeflow.llm.shared import Scratch, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"

#: (verdict, host, path prefix) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

LINK = r"(?i)<link\b[^>]*>"
META = r"(?i)<meta\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
TARGET = r"(?i)\burl\s*=\s*['\"]?([^\"'>\s]+)"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, address): empty for a null url or one without ://.

    The address is host, path and query string: what scheme and fragment leave
    of the url.
    """
    host = F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))
    rest = F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    return host, path, F.concat(host, path, rest)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null.

    `rules` is a list that the caller holds in memory; it becomes one literal
    array.  Of equally long rules an allow rule wins.
    """
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(int(v == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,allow:int,rule:string,verdict:string>")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): canonical links and meta refreshes of the pages, targets made absolute."""
    tags = F.concat(
        F.filter(F.regexp_extract_all(html_col, F.lit(LINK), 0), lambda t: t.rlike(CANONICAL)),
        F.filter(F.regexp_extract_all(html_col, F.lit(META), 0), lambda t: t.rlike(REFRESH)),
    )
    marked = F.contains(F.lower(F.col(html_col)), F.lit("canonical")) | F.contains(F.lower(F.col(html_col)), F.lit("refresh"))
    found = pages.where(marked & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    raw = F.when(F.col("tag").rlike(META), F.regexp_extract("tag", TARGET, 1)).otherwise(F.regexp_extract("tag", HREF, 1))
    scheme, host = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", PARTS, 1)
    folder = F.regexp_replace(F.regexp_extract("url", PARTS, 2), r"[^/]*$", "")
    to = F.col("raw")
    target = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host, to))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return found.withColumn("raw", F.replace(raw, F.lit("&amp;"), F.lit("&"))).where("raw <> ''").select("url", target.alias("target"))


def judge_urls(pages: DataFrame, rules=RULES, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, component.

    rule is null when no rule fits; the verdict is the rule's, else block when
    the address has a blocked alias, else allow.  A blocked alias may be any
    linked address, also one that is no page.  `links` (url, target) adds
    redirects seen elsewhere.  Null urls and urls without :// have empty host
    and path, no alias, and are allowed; repeated rows are judged alike; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    host, path, address = url_parts(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), address.alias("address"))
    own = own.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))

    edges = page_links(pages, url_col, html_col) if html_col else None
    if links is not None:
        extra = links.toDF("url", "target")
        edges = extra if edges is None else edges.unionByName(extra)
    if edges is None:
        edges = spark.createDataFrame([], "url string, target string")
    ends = edges.select(url_parts(F.col("url"))[2].alias("a"), url_parts(F.col("target"))[2].alias("b")).where("a <> '' AND b <> ''")
    groups = connected_components(ends, scratch)

    # decisions of linked addresses, pages or not: the address holds all that the rules look at
    at = F.concat(F.lit("x://"), F.col("node"))
    fit = longest_rule(url_parts(at)[0], url_parts(at)[1], rules)
    blocked = groups.withColumn("v", fit["verdict"]).groupBy("component").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("alias_blocked"))
    known = spread_join(groups, blocked, "component").select(F.col("node").alias("address"), "component", "alias_blocked")
    judged = spread_join(own, scratch.save(known, "aliases"), "address", "left")
    by_alias = F.when(F.coalesce("alias_blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_alias).alias("verdict"), "component"
    )
