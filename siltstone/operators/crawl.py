"""The crawl as batches over tables: links of pages, sitemaps, robots rules and the frontier by level."""

from __future__ import annotations

import itertools
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from siltstone.functions.urls import canonical_url, link_kept, resolve_url, url_reason
from siltstone.session import bound_batches, spread, stage
from siltstone.sources import http_source
from siltstone.sources.html import parse
from siltstone.sources.registry import registry


@F.pandas_udf(ArrayType(StringType()))
def hrefs(body: pd.Series) -> pd.Series:
    """The href of each link of a page, in order."""
    return body.map(lambda b: [] if b is None else [e.attrs["href"] for e in parse(b).elements() if e.name == "a" and "href" in e.attrs])


@F.pandas_udf(StructType([StructField("ok", BooleanType()), StructField("reason", StringType()), StructField("is_index", BooleanType()), StructField("urls", ArrayType(StringType()))]))
def parse_sitemap(xml: pd.Series) -> pd.DataFrame:
    """A sitemap or sitemap index, whatever its namespace; another root counts only if it holds addresses. Malformed XML is a value, not an error."""

    def one(x: str | bytes | None) -> tuple:
        text = x.decode("utf-8", "replace") if isinstance(x, bytes) else x
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return False, "malformed_sitemap", False, []
        local = lambda e: e.tag.rpartition("}")[2].lower()
        urls = [e.text.strip() for e in root.iter() if local(e) == "loc" and e.text and e.text.strip()]
        known = local(root) in ("sitemapindex", "urlset")
        return (True, "ok", local(root) == "sitemapindex", urls) if known or urls else (False, "malformed_sitemap", False, [])

    return pd.DataFrame([one(x) for x in xml], columns=["ok", "reason", "is_index", "urls"])


def page_links(pages: DataFrame) -> DataFrame:
    """(source_id, page_url, link, position) of pages(source_id, page_url, body): links to follow, absolute, each once per page."""
    bound_batches(pages.sparkSession)
    found = spread(pages).select("source_id", "page_url", F.posexplode(hrefs("body")).alias("position", "href")).withColumn("link", resolve_url("page_url", "href"))
    return found.where(link_kept(F.col("href"), F.col("link"))).groupBy("source_id", "page_url", "link").agg(F.min("position").alias("position"))


def expand_sitemaps(roots: DataFrame, bodies: DataFrame, children: int = 20) -> DataFrame:
    """(source_id, root, sitemap, url) of the pages that sitemaps list: roots(source_id, url), bodies(url, xml). An index leads to at most `children` other
    sitemaps of its root, first listed first, none of them twice, so the rounds end by themselves; one level of indexes per round."""
    parsed = stage(bodies.select(F.col("url").alias("sitemap"), parse_sitemap("xml").alias("s")).where("s.ok").select("sitemap", "s.is_index", "s.urls"), "sitemaps")
    level = roots.select("source_id", F.col("url").alias("root"), F.col("url").alias("sitemap")).distinct()
    seen, pages = level, None
    for n in itertools.count():
        hit = level.join(parsed, "sitemap")
        found = hit.where("not is_index").select("source_id", "root", "sitemap", F.explode("urls").alias("url")).distinct()
        pages = found if pages is None else pages.unionByName(found)
        listed = hit.where("is_index").select("source_id", "root", F.posexplode("urls").alias("at", "child")).groupBy("source_id", "root", "child").agg(F.min("at").alias("at"))
        fresh = listed.select("source_id", "root", F.col("child").alias("sitemap"), "at").join(seen, ["source_id", "root", "sitemap"], "left_anti")
        used = seen.groupBy("source_id", "root").agg((F.count("*") - 1).alias("used"))
        ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("source_id", "root").orderBy("at", "sitemap"))).join(used, ["source_id", "root"])
        level = stage(ranked.where(F.col("rank") + F.col("used") <= children).select("source_id", "root", "sitemap"), f"level{n}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return pages


#: A robots file that is longer counts as one that can't be had.
MAX_ROBOTS = 256 * 1024
RULES = ArrayType(StructType([StructField("allow", BooleanType()), StructField("path", StringType())]))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, verdict, rules) of robots(host, status, body): verdict true where all is allowed (missing files, 404), false where nothing is (other errors, too long files,
    no answer), null where the rules decide: those of the agent's group, in order, with decoded paths. Files are parsed here, once each."""

    @F.pandas_udf(RULES)
    def parsed(body: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            parser = RobotFileParser()
            parser.parse((text or "").splitlines())
            group = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
            return [{"allow": bool(r.allowance), "path": unquote(r.path)} for r in group.rulelines] if group else []

        return body.map(one)

    status = F.col("status")
    verdict = F.when(status.isNull(), False).when(status == 404, True).when((status >= 400) | (F.octet_length(F.coalesce("body", F.lit(""))) > MAX_ROBOTS), False)
    some = robots.withColumn("verdict", verdict).withColumn("body", F.when(F.col("verdict").isNull(), F.col("body")))
    return some.select("host", "verdict", parsed("body").alias("rules"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls(host, url) with allowed by robots(host, status, body): the first rule that the path begins with decides. Hosts without a row in robots allow nothing.

    Only parsed rules are joined to the addresses, and they are judged natively; a host with most of the addresses can be split like any join.
    """
    plain = F.coalesce(F.try_url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))), F.col("url"))
    rest = F.regexp_extract(plain, r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?(.*)$", 1)
    path = F.when(rest == "", "/").otherwise(rest)
    both = urls.select("host", "url").withColumn("_path", path).join(robots_rules(robots, agent), "host", "left")
    hit = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(0))
    return both.select("host", "url", F.coalesce("verdict", F.when(F.col("rules").isNull(), False).otherwise(F.coalesce(hit["allow"], F.lit(True)))).alias("allowed"))


#: Pages of a source that a crawl takes at most (a fixed value).
MAX_PAGES = 10_000


def capped(found: DataFrame, cap: int = MAX_PAGES) -> DataFrame:
    """found(source_id, canonical_url, first_at, ...) up to `cap` pages of each source, those found first, by address at equal times."""
    order = Window.partitionBy("source_id").orderBy(F.col("first_at").asc_nulls_first(), "canonical_url")
    return found.withColumn("page_no", F.row_number().over(order)).where(F.col("page_no") <= cap)


def discoveries(*found: DataFrame) -> DataFrame:
    """Union of found(source_id, url, discovered_from, at): each canonical address once, with its first discoverer."""
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    rows = whole.withColumn("canonical_url", canonical_url(F.col("url"))).where("canonical_url is not null")
    return rows.groupBy("source_id", "canonical_url").agg(F.min_by("discovered_from", F.struct("at", "discovered_from")).alias("discovered_from"), F.min("at").alias("first_at"))


def frontier(edges: DataFrame, seeds: DataFrame, levels: int = 100_000) -> DataFrame:
    """(node, level) of the nodes that seeds(node) reach over edges(src, dst), by breadth-first levels until one is empty; an error if there are more than `levels`.

    Each level is one join of the last level with the edges and one anti-join with the visited nodes; it is written to the shared
    folder, so the plan stays short and lost executors cost one level.
    """
    visited = stage(seeds.select("node").distinct().withColumn("level", F.lit(0)), "level0")
    last = visited
    for level in range(1, levels + 1):
        reached = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        last = stage(reached.join(visited, "node", "left_anti").withColumn("level", F.lit(level)), f"level{level}")
        if last.isEmpty():
            return visited
        visited = visited.unionByName(last)
        if level % 16 == 0:  # else the plan grows with the levels
            visited = stage(visited, f"visited{level}")
    raise ValueError(f"more than {levels} levels")


def crawl(seeds: DataFrame, sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], cap: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(pages, found): what a breadth-first crawl from seeds(source_id, url) fetches and finds, by the rules of sources(source_id, allowed_hosts, allowed_path_prefixes).

    fetch gives (source_id, canonical_url, body, ...) for a level's (source_id, canonical_url), body null for failures. found has each page once, with level and the page it
    was first found on. A source has at most `cap` pages, those of earlier levels and by address within one. Each level is written to the shared folder before the next.
    """
    rules = registry(sources).where("invalid is null").select("source_id", "allowed_hosts", "allowed_path_prefixes")

    def fresh(links: DataFrame, level: int) -> DataFrame:
        ok = links.join(rules, "source_id").where(url_reason(F.col("url"), F.col("allowed_hosts"), F.col("allowed_path_prefixes")) == "ok")
        named = ok.withColumn("canonical_url", canonical_url(F.col("url"))).where("canonical_url is not null")
        return named.groupBy("source_id", "canonical_url").agg(F.min("discovered_from").alias("discovered_from")).withColumn("level", F.lit(level))

    def within(new: DataFrame, have: DataFrame | None) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("source_id").orderBy("canonical_url"))
        if have is None:
            return new.withColumn("_n", order).where(F.col("_n") <= cap).drop("_n")
        counts = have.groupBy("source_id").agg(F.count("*").alias("_have"))
        new = new.join(have.select("source_id", "canonical_url"), ["source_id", "canonical_url"], "left_anti").join(counts, "source_id", "left")
        return new.withColumn("_n", order + F.coalesce("_have", F.lit(0))).where(F.col("_n") <= cap).drop("_n", "_have")

    last = found = stage(within(fresh(seeds.withColumn("discovered_from", F.lit("seed")), 0), None), "found0")
    pages = None
    for level in itertools.count(1):
        got = stage(fetch(last.select("source_id", "canonical_url")), f"pages{level}")
        pages = got if pages is None else pages.unionByName(got)
        links = page_links(got.where("body is not null").select("source_id", F.col("canonical_url").alias("page_url"), "body"))
        last = stage(within(fresh(links.select("source_id", F.col("link").alias("url"), F.col("page_url").alias("discovered_from")), level), found), f"found{level}")
        if last.isEmpty():
            return pages, found
        found = found.unionByName(last)
        if level % 16 == 0:  # else the plan grows with the levels
            found = stage(found, f"all{level}")


def http_fetcher(**options: str) -> Callable[[DataFrame], DataFrame]:
    """A fetch for crawl() over the HTTP source. A level's addresses, at most `cap` of each source, are the options of one read."""

    def fetch(level: DataFrame) -> DataFrame:
        spark = level.sparkSession
        http_source.register(spark)
        urls = [r[0] for r in level.select("canonical_url").distinct().collect()]
        read = spark.read.format("siltstone_http").options(**options, urls=json.dumps(urls)).load().withColumnRenamed("url", "canonical_url")
        good = (F.col("http_status") == 200) & F.col("error_type").isNull()
        return level.join(read, "canonical_url", "left").withColumn("body", F.when(good, F.col("body")))

    return fetch
