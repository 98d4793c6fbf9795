"""The core queries by name, with the SQL that gives the same rows. Every query runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import http, ids, urls
from siltstone.functions import text as T
from siltstone.functions.vectors import norm
from siltstone.operators import catalog, chunking, crawl, html_extract, incremental, index, pipeline, retrieval
from siltstone.session import bound_batches, deal, shared_dir, spread, stage
from siltstone.sources.registry import registry
from siltstone.sources.tables import table
from siltstone.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL that several queries share

CLEAN = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
HOST = r"'^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)(?::(.*))?$'"
WORDS = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\f\r]'"


def url_parts(source: str) -> str:
    """A chain of SQL tables that ends in `u`: the parts of the column url of `source`."""
    return rf"""a as (select *, regexp_extract(trim(url), {PARTS}, 1) as sch, regexp_extract(trim(url), {PARTS}, 2) as auth, regexp_extract(trim(url), {PARTS}, 3) as pth from {source}),
      b as (select *, lower(sch) as scheme, lower(regexp_extract(auth, {HOST}, 1)) as host, regexp_extract(auth, {HOST}, 2) as port,
            regexp_replace(regexp_replace(pth, ';[^/]*$', ''), '/{{2,}}', '/', 'g') as p1 from a),
      u as (select *, case when p1 in ('', '/') then '/' else regexp_replace(p1, '/+$', '') end as path from b)"""


CANONICAL = "case when scheme <> '' and host <> '' then scheme || '://' || host || case when port = '' or (scheme = 'https' and port = '443') or (scheme = 'http' and port = '80') then '' else ':' || port end || path end"
REASON = """case when url is null or trim(url) = '' or scheme = '' then 'malformed_url' when scheme = 'http' then 'https_required' when scheme <> 'https' then 'unsupported_scheme'
    when contains(auth, '@') then 'credentials_rejected' when host = '' then 'malformed_url' when not coalesce(list_contains(allowed_hosts, host), false) then 'invalid_host'
    when len(list_filter(allowed_path_prefixes, lambda p: path = p or starts_with(path, p || '/'))) = 0 then 'invalid_path' else 'ok' end"""
NEWEST = "(select * from catalog_urls where source_id is not null and canonical_url is not null qualify row_number() over (partition by source_id, canonical_url order by updated_at desc nulls last) = 1)"
CHUNKS = "(select distinct chunk_id, document_id, source_id, canonical_url, title, headings, breadcrumb, text, primary_text, content_hash, chunk_index from document_chunks)"
POINTS = "(select * from vector_points where point_id is not null qualify row_number() over (partition by point_id order by created_at desc nulls last) = 1)"
RANKED = """select q.vec_id as query_id, d.vec_id as point_id, q.label as query_label, d.label as label, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as score
    from embeddings q, embeddings d where q.vec_id % 20 = 0"""


BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
OPENS = "'^(`{3,}|~{3,})'"


def fence_lines(source: str, key: str) -> str:
    """A chain of recursive SQL tables that ends in `k`: the lines of the column `text` of `source`, n counted from 0, mark the fence that is open before the line, inside whether the line belongs to one."""
    return rf"""l as materialized (select {key}, i - 1 as n, ls[i] as line from (select {key}, string_split(text, chr(10)) as ls from {source}), unnest(range(1, len(ls) + 1)) t(i)),
      f({key}, n, mark) as (select {key}, n, '' from l where n = 0 union all
        select f.{key}, f.n + 1, case when f.mark = '' then regexp_extract(l.line, {OPENS}, 1)
          when regexp_full_match(regexp_replace(l.line, '{BLANK}+$', ''), case when left(f.mark, 1) = '~' then '~+' else '`+' end) and length(regexp_replace(l.line, '{BLANK}+$', '')) >= length(f.mark) then '' else f.mark end
        from f join l on l.{key} = f.{key} and l.n = f.n),
      k as (select {key}, n, line, mark, mark <> '' or regexp_matches(line, {OPENS}) as inside from l join f using ({key}, n))"""


SEGMENTS = """s as (select *, sum(case when mark = '' and (inside or coalesce(before, false) or n = 0) then 1 else 0 end) over (partition by extract_id order by n) as seg
    from (select *, lag(inside) over (partition by extract_id order by n) as before from k))"""


def own_folder(spark: SparkSession) -> str:
    """A folder of this call's own among the shared ones."""
    return f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"


def newest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(table(spark, d, "catalog_urls").where("source_id is not null and canonical_url is not null"), catalog.KEY, "updated_at")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """document_chunks with each chunk once, whatever its token counts."""
    return table(spark, d, "document_chunks").select("chunk_id", "document_id", "source_id", "canonical_url", "title", "headings", "breadcrumb", "text", "primary_text", "content_hash", "chunk_index").distinct()


# --- identity


@query("select distinct source_id, canonical_url, document_id, sha256(source_id || chr(10) || canonical_url) as expected from catalog_urls")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_urls").select("source_id", "canonical_url", "document_id", ids.document_id(F.col("source_id"), F.col("canonical_url")).alias("expected")).distinct()


@query("select distinct chunk_id, sha256(source_id || canonical_url || 'heading-v1' || chunk_index::varchar) as expected from document_chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunks").select("chunk_id", ids.chunk_id(F.col("source_id"), F.col("canonical_url"), F.col("chunk_index")).alias("expected")).distinct()


@query("""with h as (select distinct point_id, lower(chunk_id) as h from vector_points)
  select point_id, case when regexp_full_match(h, '[0-9a-f]{64}') then substr(h,1,8) || '-' || substr(h,9,4) || '-8' || substr(h,14,3) || '-' ||
    substr('89ab', ((instr('0123456789abcdef', substr(h,17,1)) - 1) & 3) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) end as expected from h""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_points").select("point_id", "chunk_id").distinct().select("point_id", ids.point_id(F.col("chunk_id")).alias("expected")).distinct()


@query("select distinct chunk_id, content_hash, sha256(primary_text) as expected from document_chunks")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunks").select("chunk_id", "content_hash", ids.sha256_text(F.col("primary_text")).alias("expected")).distinct()


@query("select fetch_id, sha256(body) as body_sha256, octet_length(body) as n_bytes from fetch_results where body is not null")
def body_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("body is not null").select("fetch_id", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").cast("bigint").alias("n_bytes"))


# --- addresses and exchanges


@query(f"with r as (select fetch_id, requested_url as url from fetch_results), {url_parts('r')} select fetch_id, {CANONICAL} as canonical from u")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").select("fetch_id", urls.canonical_url(F.col("requested_url")).alias("canonical"))


@query("""select source_id, list_transform(allowed_hosts, lambda h: lower(h)) as hosts, list_transform(allowed_path_prefixes, lambda p: case when p = '/' then p else regexp_replace(p, '/+$', '') end) as paths,
  case when coalesce(len(allowed_hosts), 0) = 0 then 'no_hosts' when len(list_filter(allowed_path_prefixes, lambda p: not starts_with(p, '/'))) > 0 then 'relative_path' end as invalid from sources""")
def registry_rules(spark: SparkSession, d: str) -> DataFrame:
    return registry(table(spark, d, "sources")).select("source_id", F.col("allowed_hosts").alias("hosts"), F.col("allowed_path_prefixes").alias("paths"), "invalid")


@query(f"with r as (select fetch_id, source_id, requested_url as url, allowed_hosts, allowed_path_prefixes from fetch_results left join sources using (source_id)), {url_parts('r')} select fetch_id, {REASON} as reason from u")
def url_validation(spark: SparkSession, d: str) -> DataFrame:
    known = registry(table(spark, d, "sources")).select("source_id", "allowed_hosts", "allowed_path_prefixes")
    rows = table(spark, d, "fetch_results").select("fetch_id", "source_id", "requested_url").join(known, "source_id", "left")
    return rows.select("fetch_id", urls.url_reason(F.col("requested_url"), F.col("allowed_hosts"), F.coalesce("allowed_path_prefixes", F.array().cast("array<string>"))).alias("reason"))


@query(f"""with r as (select source_id, discovered_from as url, allowed_hosts, allowed_path_prefixes from catalog_urls left join sources using (source_id)), {url_parts('r')}
  select source_id, {REASON} as reason, count(*) as n from u group by all""")
def validation_reasons_count(spark: SparkSession, d: str) -> DataFrame:
    known = registry(table(spark, d, "sources")).select("source_id", "allowed_hosts", "allowed_path_prefixes")
    rows = table(spark, d, "catalog_urls").select("source_id", "discovered_from").join(known, "source_id", "left")
    reason = urls.url_reason(F.col("discovered_from"), F.col("allowed_hosts"), F.coalesce("allowed_path_prefixes", F.array().cast("array<string>")))
    return rows.groupBy("source_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"with r as (select fetch_id, source_id, case when trim(final_url) <> '' then trim(final_url) end as url, allowed_hosts, allowed_path_prefixes from fetch_results left join sources using (source_id)), {url_parts('r')} select fetch_id, url as target, {REASON} as reason from u")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    """Redirects resolved against the requested address and validated again."""
    known = registry(table(spark, d, "sources")).select("source_id", "allowed_hosts", "allowed_path_prefixes")
    rows = table(spark, d, "fetch_results").select("fetch_id", "source_id", urls.resolve_url("requested_url", "final_url").alias("target")).join(known, "source_id", "left")
    return rows.select("fetch_id", "target", urls.url_reason(F.col("target"), F.col("allowed_hosts"), F.coalesce("allowed_path_prefixes", F.array().cast("array<string>"))).alias("reason"))


@query("select lower(trim(split_part(coalesce(content_type, ''), ';', 1))) as media_type, count(*) as n, count(*) filter (where lower(trim(split_part(coalesce(content_type, ''), ';', 1))) in ('text/html', 'application/xhtml+xml')) as n_html from fetch_results group by 1")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetch_results").select("content_type")
    return rows.groupBy(http.media_type(F.col("content_type")).alias("media_type")).agg(F.count("*").alias("n"), F.count_if(http.is_html(F.col("content_type"))).alias("n_html"))


OUTCOME = """select *, case when size_bytes > 5242880 then 'skipped' when http_status is null or http_status = 0 then 'failed' when http_status in (301,302,303,307,308) then 'redirect' when http_status in (404,410) then 'gone'
    when http_status >= 400 then 'failed' when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) not in ('text/html', 'application/xhtml+xml') then 'skipped' else 'fetched' end as outcome,
  case when size_bytes > 5242880 then 'size_exceeded' when http_status is null or http_status = 0 then case when attempts >= 3 then 'retry_exhausted' else coalesce(error_type, 'failed') end
    when http_status in (301,302,303,307,308) then 'redirect' when http_status = 429 or http_status >= 500 then 'retry_exhausted' when http_status >= 400 then 'http_' || http_status::varchar
    when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) not in ('text/html', 'application/xhtml+xml') then 'non_html' else 'ok' end as why from fetch_results"""


@query(f"select outcome, why, count(*) as n from ({OUTCOME}) group by all")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "fetch_results").select(http.fetch_outcome(c("http_status"), c("content_type"), c("size_bytes"), c("error_type"), c("attempts")).alias("o"))
    return rows.groupBy(c("o.status").alias("outcome"), c("o.reason").alias("why")).agg(F.count("*").alias("n"))


@query("""select fetch_id, coalesce(attempts < 3 and (coalesce(error_type in ('timeout','connection_failure','http_error'), false) or coalesce(http_status in (429,500,502,503,504), false)), false) as retry,
  least(0.5 * pow(2.0, attempts - 1), 60.0) as delay from fetch_results""")
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "fetch_results").select("fetch_id", http.should_retry(c("http_status"), c("error_type"), c("attempts")).alias("retry"), http.backoff_seconds(c("attempts")).alias("delay"))


@query("select source_id, case when rate_limit_rps > 0 then 1.0 / rate_limit_rps else 0.0 end as seconds, 'siltstone (' || display_name || '; +https://siltstone.example)' as agent from sources")
def rate_intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", http.rate_interval(F.col("rate_limit_rps")).alias("seconds"), http.user_agent("siltstone", F.col("display_name"), "https://siltstone.example").alias("agent"))


# --- pages, links, sitemaps, robots, frontier


@query(r"""with b as (select source_id, canonical_url as page_url, decode(body) as t from fetch_results where body is not null),
  a as (select source_id, page_url, regexp_extract_all(regexp_replace(regexp_replace(t, '<!--.*?-->', '', 'gs'), '<script.*?</script>', '', 'gs'), '<a\s[^<>]*?href=("[^"]*"|''[^'']*''|[^\s<>"'']+)', 1) as h from b),
  x as (select source_id, page_url, i - 1 as position, trim(h[i], '"''') as href from a, unnest(range(1, len(h) + 1)) u(i)),
  l as (select *, case when starts_with(href, '/') then regexp_extract(page_url, '^https?://[^/]+') || href else href end as link from x where href <> '' and not starts_with(href, '#') and not regexp_matches(lower(href), '^(mailto|javascript|data|tel):'))
  select source_id, page_url, link, min(position)::int as position from l where not regexp_matches(lower(regexp_extract(link, '^[^?#]*')), '[.](pdf|zip|png|jpg|jpeg|gif|svg|css|js|woff|woff2|ico)$') group by all""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetch_results").where("body is not null").select("source_id", F.col("canonical_url").alias("page_url"), "body")
    return crawl.page_links(pages)


@query()
def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetch_results").select(F.col("fetch_id").alias("record_id"), "source_id", "canonical_url", "body")
    found = html_extract.extract_pages(pages).join(table(spark, d, "sources").select("source_id", "display_name"), "source_id", "left")
    return found.select("record_id", "document_id", "reason", T.document_title(F.col("extracted_text"), T.page_title(F.col("raw_title"), F.coalesce("display_name", F.lit("")))).alias("title"), "extracted_text", "extracted_sha256", F.size("heading_outline").alias("n_headings"))


PART_LANGUAGE = "case p_partkey % 3 when 0 then 'language-python' when 1 then 'BASH' else 'plain' end"


@query(f"""with c as (select *, p_partkey % 11 = 3 as short, p_partkey % 11 = 4 as bare, p_partkey % 11 = 5 as blank, p_partkey % 4 = 1 as ticks,
    chr(10) as nl, case p_partkey % 3 when 0 then 'python' when 1 then 'bash' else '' end as lang, p_partkey::varchar as k, p_size::varchar as size from part),
  t as (select *, '# ' || p_name || nl || nl || 'Part `' || k || '` of ' || p_brand || ' has the size ' || size || ', see [its page](/parts/' || k || ') or above.' as head,
    nl || nl || '- type ' || p_type || nl || '  - size ' || size || nl || '- brand ' || p_brand || nl || nl || '1. one' || nl || '2. two' || nl || nl || case when ticks then '````' else '```' end || lang || nl || 'print(' || k || ')' || nl ||
    case when ticks then '```' else '  x = 1' end || nl || case when ticks then '````' else '```' end || nl || nl || 'Key | Value' || nl || 'size | ' || size || nl || nl || '> ' || p_name || ' & more' || nl || '>' || nl || '> <b>' || nl || nl || '---' || nl || nl || 'photo of ' || p_name as rest from c)
  select p_partkey::bigint as record_id, case when blank then 'empty' when bare then 'extract_failed' when short then 'too_short' else 'ok' end as reason, case when blank then '' else p_name end as title,
    case when blank or bare then null when short then head else head || rest end as extracted_text, case when blank or bare then 0 else 1 end as n_headings from t""")
def part_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every part written as a page, with chrome around, in several layouts, and read again: the main element, what is stripped, headings, lines, lists in lists, code and its
    language, tables, quotes, links and images."""
    c, lit = F.col, F.lit
    k, size = c("p_partkey").cast("string"), c("p_size").cast("string")
    kind, layout = c("p_partkey") % 11, c("p_partkey") % 3
    opened = F.when(layout == 0, "<article>").when(layout == 1, "<main>").otherwise("<div id=content>")
    closed = F.when(layout == 0, "</article>").when(layout == 1, "</main>").otherwise("</div>")
    head = F.concat(lit("<h1>"), c("p_name"), lit(" <a class=headerlink href='#x'>#</a></h1><p>Part <code>"), k, lit("</code> of <b>"), c("p_brand"), lit("</b> has\tthe   size "), size, lit(", see <a href='/parts/"), k, lit("'>its page</a> or <a href='#top'>above</a>.</p>"))
    code = F.when(c("p_partkey") % 4 == 1, "```").otherwise("  x = 1")
    rest = F.concat(
        lit("<ul><li>type "), c("p_type"), lit("<ul><li>size "), size, lit("</li></ul></li><li> </li><li>brand "), c("p_brand"), lit("</li></ul><ol><li>one</li><li>two</li></ol><pre class='"),
        F.expr(PART_LANGUAGE), lit("'><code>\nprint("), k, lit(")\n"), code, lit("\n</code><button>Copy</button></pre><table><tr><th>Key</th><th>Value</th></tr><tr><td>size</td><td>"), size,
        lit("</td></tr></table><blockquote><p>"), c("p_name"), lit(" &amp;amp; more</p><p>&amp;lt;b&gt;</p></blockquote><hr><!-- gone --><script>var a = 1;</script><form>ask</form><img src=x.png alt='photo of "), c("p_name"), lit("'>"),
    )
    whole = F.concat(lit("<html><head><title>"), c("p_name"), lit(" - Parts</title></head><body><nav>menu</nav>"), opened, head, F.when(kind == 3, "").otherwise(rest), closed, lit("<footer>end</footer></body></html>"))
    body = F.when(kind == 5, "  ").when(kind == 4, F.concat(lit("<title>"), c("p_name"), lit(" - Parts</title><p>no main element</p>"))).otherwise(whole)
    parts = deal(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    pages = parts.select(c("p_partkey").cast("bigint").alias("record_id"), lit("parts").alias("source_id"), F.concat(lit("https://parts.example/"), k).alias("canonical_url"), F.encode(body, "UTF-8").alias("body"))
    found = html_extract.extract_pages(pages, dealt=True)
    title = T.document_title(c("extracted_text"), T.page_title(c("raw_title"), lit("Parts")))
    return found.select("record_id", "reason", title.alias("title"), "extracted_text", F.size("heading_outline").alias("n_headings"))


@query(f"select source_id, true as ok, false as is_index, canonical_url as url from {NEWEST}")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """The catalog written as one sitemap per source and read again."""
    pages = newest(spark, d).groupBy("source_id").agg(F.array_sort(F.collect_set("canonical_url")).alias("locs"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform("locs", lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    return pages.select("source_id", crawl.parse_sitemap(xml).alias("s")).select("source_id", "s.ok", "s.is_index", F.explode("s.urls").alias("url"))


@query(f"""with r as (select canonical_url as url from {NEWEST}), {url_parts('r')}
  select u.host, u.url, coalesce(not starts_with(regexp_replace(regexp_extract(u.url, '^https?://[^/]*(.*)$', 1), '#.*$', ''), allowed_path_prefixes[1] || '/'), false) as allowed from u left join sources on u.host = allowed_hosts[1]""")
def robots_permissions(spark: SparkSession, d: str) -> DataFrame:
    """Each page against rules that close its source's first listed path."""
    known = table(spark, d, "sources").select(F.get("allowed_hosts", F.lit(0)).alias("host"), F.lit(200).alias("status"), F.concat(F.lit("User-agent: *\nDisallow: "), F.get("allowed_path_prefixes", F.lit(0)), F.lit("/")).alias("body"))
    pages = newest(spark, d).select(urls.Url(F.col("canonical_url")).host.alias("host"), F.col("canonical_url").alias("url"))
    return crawl.robots_allowed(pages, known, "siltstone")


@query("""with recursive edges as (select distinct discovered_from as src, canonical_url as dst from catalog_urls where discovered_from is not null and canonical_url is not null),
  seeds as (select distinct unnest(seed_urls) as node from sources union select distinct discovered_from from catalog_urls where ends_with(discovered_from, '/sitemap.xml')),
  walk(node, level) using key (node) as (select node, 0 from seeds union select e.dst, min(w.level) + 1 from walk w join edges e on e.src = w.node left join recurring.walk k on k.node = e.dst where k.node is null group by e.dst)
  select node, level::int as level from walk""")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalog_urls").where("discovered_from is not null and canonical_url is not null").select(F.col("discovered_from").alias("src"), F.col("canonical_url").alias("dst")).distinct()
    edges = stage(rows, "edges")
    seeds = table(spark, d, "sources").select(F.explode("seed_urls").alias("node")).union(edges.where(F.col("src").endswith("/sitemap.xml")).select("src"))
    return crawl.frontier(edges, seeds).select("node", "level")


@query("""select source_id, canonical_url, min_by(discovered_from, (created_at, discovered_from)) as discovered_from from catalog_urls where discovered_from is not null and canonical_url is not null group by all""")
def first_discoverers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalog_urls").where("discovered_from is not null and canonical_url is not null").select("source_id", F.col("canonical_url").alias("url"), "discovered_from", F.col("created_at").alias("at"))
    return crawl.discoveries(rows).select("source_id", "canonical_url", "discovered_from")


@query(f"""with f as (select source_id, canonical_url as url, created_at from catalog_urls where canonical_url is not null), {url_parts('f')},
  p as (select source_id, {CANONICAL} as canonical_url, min(created_at) as first_at from u where {CANONICAL} is not null group by all)
  select source_id, canonical_url, (row_number() over (partition by source_id order by first_at nulls first, canonical_url))::int as page_no from p qualify page_no <= 10000""")
def capped_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a crawl takes of each source, in the order in which they were found."""
    rows = table(spark, d, "catalog_urls").where("canonical_url is not null").select("source_id", F.col("canonical_url").alias("url"), "discovered_from", F.col("created_at").alias("at"))
    return crawl.capped(crawl.discoveries(rows)).select("source_id", "canonical_url", "page_no")


# --- text


@query(f"""with recursive t as (select extract_id, nfc_normalize(extracted_text) as text from extract_results where extracted_text is not null), {fence_lines('t', 'extract_id')}, {SEGMENTS},
  b as (select extract_id, n, seg, inside, case when inside then line else regexp_replace(line, '{BLANK}+$', '') end as line from s),
  r as (select *, sum(case when line = '' then 0 else 1 end) over (partition by extract_id, seg order by n) as run from b),
  x as (select extract_id, n, line from r qualify inside or line <> '' or row_number() over (partition by extract_id, seg, run, line = '' order by n) <= 2),
  j as (select extract_id, regexp_replace(string_agg(line, chr(10) order by n), '^{BLANK}+|{BLANK}+$', '', 'g') as text from x group by extract_id)
  select e.extract_id, j.text, sha256(j.text) as sha256 from extract_results e left join j on j.extract_id = e.extract_id""")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    rows = spread(table(spark, d, "extract_results").select("extract_id", "extracted_text"))
    return rows.select("extract_id", T.normalize_text("extracted_text").alias("text")).withColumn("sha256", ids.sha256_text(F.col("text")))


@query(f"""with recursive t as (select extract_id, extracted_text as text from extract_results where extracted_text is not null), {fence_lines('t', 'extract_id')},
  h as (select extract_id, n, regexp_replace(regexp_extract(line, '^#{{1,6}}([^#].*)?$', 1, 's'), '^{BLANK}+|{BLANK}+$', '', 'g') as heading from k where not inside and regexp_matches(line, '^#{{1,6}}([^#].*)?$', 's'))
  select extract_id, (row_number() over (partition by extract_id order by n) - 1)::int as position, heading from h where heading <> ''""")
def heading_outlines(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    rows = spread(table(spark, d, "extract_results").select("extract_id", "extracted_text"))
    return rows.select("extract_id", F.posexplode(T.outline("extracted_text")).alias("position", "heading"))


@query(f"""with recursive t as (select extract_id, extracted_text as text from extract_results where extracted_text is not null), {fence_lines('t', 'extract_id')}, {SEGMENTS}
  select extract_id, (seg - 1)::int as position, bool_or(inside) as is_fence, (sum(length(line)) + count(*) - 1)::int as n_chars from s group by extract_id, seg""")
def fence_segments(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    rows = spread(table(spark, d, "extract_results").where("extracted_text is not null").select("extract_id", "extracted_text"))
    return rows.select("extract_id", F.posexplode(T.split_fences("extracted_text")).alias("position", "s")).select("extract_id", "position", "s.is_fence", F.length("s.segment").alias("n_chars"))


@query("select doc_id, length(text) as n from documents where length(text) < 200")
def short_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") < html_extract.MIN_CHARS).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("""select extract_id, nullif(first_value(extract_id) over (partition by source_id, sha256(extracted_text) order by extract_id), extract_id) as duplicate_of from extract_results where length(extracted_text) > 0""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extract_results").where(F.length("extracted_text") > 0).select("extract_id", "source_id", F.sha2("extracted_text", 256).alias("sum"))
    return catalog.exact_duplicates(rows, ["source_id", "sum"], ["extract_id"]).select("extract_id", "duplicate_of")


@query(f"select doc_id, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::int as n_tokens from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).cast("int").alias("n_tokens"))


@query(r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda x: x <> '') as parts
    from documents where text is not null) select doc_id, len(parts)::int as n_sentences, sha256(array_to_string(parts, chr(1))) as parts_sha256 from s""")
def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("n_sentences"), F.sha2(F.array_join("parts", "\x01"), 256).alias("parts_sha256"))


@query(r"""select chunk_id, array_to_string(list_filter(n, lambda x, i: i = 1 or x <> n[i - 1]), ' > ') as crumb from (select chunk_id, list_filter(list_transform(list_concat([display_name, title], headings), lambda x: trim(coalesce(x, ''))), lambda x: x <> '') as n
   from (select distinct chunk_id, source_id, title, headings from document_chunks) left join sources using (source_id))""")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_chunks").select("chunk_id", "source_id", "title", "headings").distinct().join(table(spark, d, "sources").select("source_id", "display_name"), "source_id", "left")
    return rows.select("chunk_id", T.breadcrumb(F.col("display_name"), F.col("title"), F.col("headings")).alias("crumb"))


@query(rf"""with t as (select chunk_id, regexp_extract_all(lag(primary_text) over (partition by document_id order by chunk_index, chunk_id), {WORDS}) as w from {CHUNKS})
  select chunk_id, array_to_string(w[greatest(len(w) - 49, 1):], ' ') as overlap from t""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("primary_text").over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    return chunk_rows(spark, d).select("chunk_id", before.alias("before")).select("chunk_id", T.overlap_text(F.col("before"), chunking.OVERLAP).alias("overlap"))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The newest good extraction of each page in chunks."""
    good = table(spark, d, "extract_results").where("ok and document_id is not null and source_id is not null").select("document_id", "source_id", "canonical_url", F.coalesce("title", F.lit("")).alias("title"), "extracted_text", "extracted_sha256", "extracted_at", "extract_id")
    newest_ids = good.groupBy("document_id").agg(F.max(F.struct("extracted_at", "extract_id")).alias("r")).select("r.extract_id")
    rows = good.join(newest_ids, "extract_id", "left_semi").join(table(spark, d, "sources").select("source_id", "display_name"), "source_id")
    return chunking.chunk_documents(rows.drop("extracted_at", "extract_id"))


@query(rf"""with recursive c as (select n_nationkey as k, n_name, c_custkey, 'Customer ' || c_name || ' of the ' || c_mktsegment || ' segment, number ' || c_custkey::varchar || ', buys here. Ask at the desk.' as para,
    row_number() over (partition by n_nationkey order by c_custkey) - 1 as rn from customer join nation on c_nationkey = n_nationkey),
  u as (select k, n_name, rn // 40 as b, rn % 40 as j, case when rn % 40 = 0 then '## Block ' || (rn // 40)::varchar || chr(10) || chr(10) else '' end || para as unit from c),
  t as (select *, len(regexp_extract_all(unit, {WORDS})) as t from u),
  w(k, b, j, chunk, total) as (select k, b, j, 0, t from t where j = 0 union all select w.k, w.b, t.j, w.chunk + case when w.total + t.t > 400 then 1 else 0 end, case when w.total + t.t > 400 then t.t else w.total + t.t end from w join t on t.k = w.k and t.b = w.b and t.j = w.j + 1),
  x as (select k, n_name, [n_name, 'Block ' || b::varchar] as headings, b, chunk, string_agg(unit, chr(10) || chr(10) order by j) as primary_text from w join u using (k, b, j) group by all
    union all select k, n_name, [n_name], -1, 0, '# ' || n_name from c where rn = 0
    union all select k, n_name, [n_name, 'Long'], 1000000, i, case i when 0 then '## Long' || chr(10) || chr(10) || array_to_string(list_transform(range(1, 398), lambda n: 'w' || n::varchar), ' ')
      when 1 then array_to_string(list_transform(range(398, 798), lambda n: 'w' || n::varchar), ' ') else array_to_string(list_transform(range(798, 901), lambda n: 'w' || n::varchar), ' ') end from c, unnest([0, 1, 2]) r(i) where rn = 0),
  o as (select *, row_number() over (partition by k order by b, chunk) - 1 as chunk_index, lag(primary_text) over (partition by k order by b, chunk) as before from x),
  p as (select *, 'Nations > ' || n_name || case when len(headings) > 1 then ' > ' || headings[2] else '' end as crumb, case when before is null then '' else array_to_string(regexp_extract_all(before, {WORDS})[greatest(len(regexp_extract_all(before, {WORDS})) - 49, 1):], ' ') || chr(10) end as back from o)
  select sha256('nations' || 'https://nations.example/' || k::varchar || 'heading-v1' || chunk_index::varchar) as chunk_id, chunk_index::int as chunk_index, array_to_string(headings, '/') as headings, crumb as breadcrumb, primary_text, crumb || chr(10) || back || primary_text as text,
    len(regexp_extract_all(crumb || chr(10) || back || primary_text, {WORDS}))::int as token_count, sha256(primary_text) as content_hash from p""")
def nation_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every nation as a document of its customers, a paragraph each, 40 to a section, and one sentence over the limit, cut into chunks: headings, packing, cuts by tokens, overlaps, ids."""
    c, lit = F.col, F.lit
    para = F.concat(lit("Customer "), c("c_name"), lit(" of the "), c("c_mktsegment"), lit(" segment, number "), c("c_custkey").cast("string"), lit(", buys here. Ask at the desk."))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", para.alias("para")))).alias("paras"))
    block = F.transform("paras", lambda x, i: F.concat(F.when(i % 40 == 0, F.concat(lit("## Block "), F.floor(i / 40).cast("string"), lit("\n\n"))).otherwise(""), x["para"]))
    long = F.concat(lit("## Long\n\n"), F.array_join(F.transform(F.sequence(lit(1), lit(900)), lambda i: F.concat(lit("w"), i.cast("string"))), " "))
    text = F.concat(lit("# "), c("n_name"), lit("\n\n"), F.array_join(block, "\n\n"), lit("\n\n"), long)
    documents = rows.select(F.concat(lit("d"), c("n_nationkey").cast("string")).alias("document_id"), lit("nations").alias("source_id"), lit("Nations").alias("display_name"), F.concat(lit("https://nations.example/"), c("n_nationkey").cast("string")).alias("canonical_url"), c("n_name").alias("title"), text.alias("extracted_text"), lit("h").alias("extracted_sha256"))
    return chunking.chunk_documents(documents).select("chunk_id", "chunk_index", F.array_join("headings", "/").alias("headings"), "breadcrumb", "primary_text", "text", "token_count", "content_hash")


@query(r"select doc_id, regexp_replace(case when length(x) > 2000 then substr(x, 1, 2000) || ' [query truncated]' else x end, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') as question from (select doc_id, regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g') as x from documents where title is not null)")
def query_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("doc_id", T.sanitize_query(F.col("title")).alias("question"))


@query(rf"""with c as (select *, row_number() over (partition by document_id order by chunk_index, chunk_id) as n from {CHUNKS})
  select document_id, sha256(string_agg('--- Source ' || n::varchar || ' ---' || chr(10) || 'URL: ' || canonical_url || chr(10) || 'Title: ' || title || chr(10) || 'Breadcrumb: ' || coalesce(breadcrumb, '') || chr(10) || chr(10) ||
    replace(replace(text, '<<<BEGIN_DOCUMENTATION>>>', '[BEGIN_DOC]'), '<<<END_DOCUMENTATION>>>', '[END_DOC]'), chr(10) || chr(10) order by n)) as block_sha256 from c where title is not null group by document_id""")
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(spark, d).where("title is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "canonical_url", "title", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), "text"))).alias("c"))
    return rows.select("document_id", ids.sha256_text(T.context_block(F.col("c"))).alias("block_sha256"))


@query(r"""with a as (select fetch_id, canonical_url as known, list_distinct(list_transform(regexp_extract_all('See ' || canonical_url || ', or (' || requested_url || ').', 'https://[^\s)\]>"'']+'), lambda x: regexp_replace(x, '[.,;:!?)]+$', ''))) as m from fetch_results)
  select fetch_id, len(list_filter(m, lambda x: x = known))::int as n_cited, len(list_filter(m, lambda x: x <> known))::int as n_fabricated from a where known is not null""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("See "), F.col("canonical_url"), F.lit(", or ("), F.col("requested_url"), F.lit(")."))
    cited, fabricated = retrieval.citations(answer, F.array("canonical_url"))
    return table(spark, d, "fetch_results").where("canonical_url is not null").select("fetch_id", F.size(cited).alias("n_cited"), fabricated.alias("n_fabricated"))


@query(r"""with m as (select fetch_id, coalesce(error_message, '') || ' at ' || requested_url || '?token=' || fetch_id::varchar || '&x=1 bearer ' || coalesce(etag, 'none') || chr(10) || 'cookie: a=' || fetch_id::varchar as x from fetch_results),
  r as (select fetch_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\b(authorization|proxy-authorization|cookie|set-cookie)[ \t\n\f\r]*[:=][ \t\n\f\r]*[^ \t\n\f\r]+(?:[ \t\n\f\r]+[^ \t\n\f\r]+)*', '\1=<redacted>', 'g'),
    '(?i)\bbearer[ \t\n\f\r]+[^ \t\n\f\r]+', 'Bearer <redacted>', 'g'), '(?i)\b(api[_-]?key|access_token|token|password|secret)=([^& \t\n\f\r]+)', '\1=<redacted>', 'g'), chr(10), ' ')) as t from m)
  select fetch_id, 'Error: ' || case when length(t) > 180 then substr(t, 1, 180) || '...' else t end as message from r""")
def error_redaction(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("fetch_id").cast("string")
    message = F.concat(F.coalesce("error_message", F.lit("")), F.lit(" at "), F.col("requested_url"), F.lit("?token="), number, F.lit("&x=1 bearer "), F.coalesce("etag", F.lit("none")), F.lit("\ncookie: a="), number)
    return table(spark, d, "fetch_results").select("fetch_id", T.sanitize_error(message).alias("message"))


@query("""with r as (select doc_id, case doc_id % 5 when 0 then 429 when 1 then 500 else 200 end as status, case when doc_id % 5 = 2 then '{"choices":[]}' else to_json({'choices': [{'message': {'content': title}}]})::varchar end as body from documents),
  t as (select doc_id, status, case when json_valid(body) then json_extract_string(body, '$.choices[0].message.content') end as x from r),
  e as (select *, case when status = 429 then 'rate_limited' when status >= 400 then 'provider_error' when x is null or trim(regexp_replace(x, '[ \\t\\n\\f\\r\\x0b]', ' ', 'g')) = '' then 'malformed_response' end as error from t)
  select doc_id, error, case when error is null then x end as text from e""")
def provider_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a chat provider, made of the documents' titles."""
    c = F.col
    status = F.when(c("doc_id") % 5 == 0, 429).when(c("doc_id") % 5 == 1, 500).otherwise(200)
    body = F.when(c("doc_id") % 5 == 2, '{"choices":[]}').otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(c("title").alias("content")).alias("message"))).alias("choices"))))
    text, error = T.reply_text(status, body)
    return table(spark, d, "documents").select("doc_id", error.alias("error"), text.alias("text"))


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


@query("select fetch_id, strftime(fetched_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') as stamp from fetch_results")
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").select("fetch_id", T.utc_stamp(F.col("fetched_at")).alias("stamp"))


# --- catalog, runs, index


PENDING = rf"""is_in_corpus = 1 and {CLEAN.format('duplicate_of')} is null and {CLEAN.format('extracted_sha256')} is not null
  and not coalesce({CLEAN.format('indexed_sha256')} = {CLEAN.format('extracted_sha256')} and {CLEAN.format('indexed_chunker_version')} = {CLEAN.format('chunker_version')}, false)"""


@query(f"select source_id, canonical_url from {NEWEST} where {PENDING}")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages to be processed now, through partition fingerprints; the state starts empty in a folder of this call's own."""
    return incremental.pending_since(table(spark, d, "catalog_urls"), f"{own_folder(spark)}/state")


def pending_at(run: int, quarters: int) -> str:
    """SQL: the pages that run `run` hands on, when the table holds the rows of that many quarters of its time."""
    return f"""select {run} as run_no, source_id, canonical_url from (select c.* from catalog_urls c, t where source_id is not null and canonical_url is not null and (updated_at is null or epoch_us(updated_at) <= lo + (hi - lo) * {quarters} // 4)
      qualify row_number() over (partition by source_id, canonical_url order by updated_at desc nulls last) = 1) where {PENDING}"""


@query(f"with t as (select min(epoch_us(updated_at)) as lo, max(epoch_us(updated_at)) as hi from catalog_urls) {pending_at(1, 2)} union all {pending_at(3, 2)} union all {pending_at(4, 3)} union all {pending_at(5, 4)}")
def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Successive runs over one state: half of the table's time; a run over three quarters that fails after its result was written and before it was recorded;
    half again, as if the rows since had been lost; three quarters; all. Each hands on what the table then holds."""
    rows = table(spark, d, "catalog_urls")
    at = F.unix_micros("updated_at")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    until = lambda quarters: rows if quarters == 4 or lo is None else rows.where(at.isNull() | (at <= lo + (hi - lo) * quarters // 4))
    state, partitions = f"{own_folder(spark)}/state", incremental.partitions_for(rows.count())
    found = None
    for run, quarters in ((1, 2), (2, 3), (3, 2), (4, 3), (5, 4)):
        if run == 2:
            lost = incremental.changes(until(quarters), incremental.PAGE_KEY, incremental.PAGE_COLUMNS, state, partitions, incremental.PAGE_KEY[:1])
            if lost.parts:
                incremental.replace(until(quarters), lost, incremental.pending_pages, state)
            continue
        handed = stage(incremental.pending_since(until(quarters), state, partitions).select(F.lit(run).alias("run_no"), *incremental.PAGE_KEY), f"run{run}")
        found = handed if found is None else found.unionByName(handed)
    return found


@query("select count(*) as n, count(distinct (source_id, canonical_url)) as pages from catalog_urls")
def p3_fingerprint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints added up again: rows, and pages by partition."""
    rows = table(spark, d, "catalog_urls")
    part = incremental.bucket(incremental.PAGE_KEY, incremental.FEWEST, incremental.PAGE_KEY[:1])
    prints = incremental.fingerprints(rows, part, incremental.PAGE_COLUMNS, incremental.FEWEST).agg(F.sum("n").alias("n"))
    pages = rows.select(*incremental.PAGE_KEY).distinct().agg(F.count("*").alias("pages"))
    return prints.join(pages, F.lit(True))


@query(f"select fetch_status, count(*) as n, sum(coalesce(attempt_count, 0))::bigint as attempts from {NEWEST} group by 1")
def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d).groupBy("fetch_status").agg(F.count("*").alias("n"), F.sum(F.coalesce("attempt_count", F.lit(0)).cast("bigint")).alias("attempts"))


@query(f"""with b as (select source_id, canonical_url, max(run_id) as run_id, min_by('extract', extracted_at) as new_from from extract_results where source_id is not null and run_id is not null group by all)
  select coalesce(c.source_id, b.source_id) as source_id, coalesce(c.canonical_url, b.canonical_url) as canonical_url, coalesce(discovered_from, new_from) as discovered_from, coalesce(fetch_status, 'pending') as fetch_status,
    case when run_id is not null then run_id else last_seen_run_id end as last_seen_run_id, case when run_id is not null then 0 else consecutive_missing_success_runs end as misses, case when run_id is not null then 1 else is_in_corpus end as is_in_corpus
  from {NEWEST} c full join b on c.source_id = b.source_id and c.canonical_url = b.canonical_url""")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "extract_results").where("source_id is not null and run_id is not null").select("source_id", "canonical_url", "run_id", F.lit("extract").alias("discovered_from"), F.col("extracted_at").alias("at"))
    merged = catalog.register(newest(spark, d), found)
    return merged.select("source_id", "canonical_url", "discovered_from", "fetch_status", "last_seen_run_id", F.col("consecutive_missing_success_runs").alias("misses"), "is_in_corpus")


@query(f"""with f as (select *, row_number() over (partition by source_id, canonical_url order by fetched_at desc nulls last, fetch_id desc) as r, count(*) over (partition by source_id, canonical_url) as n from fetch_results),
  b as (select * from f where r = 1), s as (select * from f where coalesce(ok, false) qualify row_number() over (partition by source_id, canonical_url order by r) = 1),
  h as (select * from f where coalesce(ok, false) or http_status is not null qualify row_number() over (partition by source_id, canonical_url order by r) = 1)
  select c.source_id, c.canonical_url, (coalesce(c.attempt_count, 0) + coalesce(b.n, 0))::int as attempt_count, case when b.r is null then c.fetch_status when coalesce(b.ok, false) then 'fetched' else coalesce(b.status, 'failed') end as fetch_status,
    case when h.r is not null then h.http_status else c.http_status end as http_status, case when s.r is not null then s.etag else c.etag end as etag, case when s.r is not null then s.size_bytes else c.size_bytes end as size_bytes,
    case when s.r is not null then sha256(s.body) else c.content_sha256 end as content_sha256, case when b.r is null then c.error_type when coalesce(b.ok, false) then null else b.error_type end as error_type,
    strftime(coalesce(s.fetched_at, c.last_success_at), '%Y-%m-%d %H:%M:%S') as last_success, case when b.r is null then c.last_touched_run_id else b.run_id end as last_touched_run_id
  from {NEWEST} c left join b using (source_id, canonical_url) left join s using (source_id, canonical_url) left join h using (source_id, canonical_url)""")
def catalog_fetches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetch_results").select(*catalog.KEY, "run_id", "ok", "status", "http_status", "etag", "last_modified", "content_type", "size_bytes", F.sha2("body", 256).alias("content_sha256"), "error_type", "error_message", F.struct("fetched_at", "fetch_id").alias("at"))
    done = catalog.record_fetches(newest(spark, d), rows)
    return done.select(*catalog.KEY, "attempt_count", "fetch_status", "http_status", "etag", "size_bytes", "content_sha256", "error_type", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "last_touched_run_id")


@query(f"""with e as (select *, sha256(extracted_text) as h from extract_results where ok and source_id is not null and canonical_url is not null),
  m as (select source_id, h, min(document_id) as first from e group by all),
  x as (select e.*, nullif(m.first, e.document_id) as dup from e join m using (source_id, h)),
  b as (select * from x qualify row_number() over (partition by source_id, canonical_url order by extracted_at desc nulls last, run_id desc nulls last, h desc, dup desc nulls last) = 1)
  select c.source_id, c.canonical_url, case when b.h is null then c.extracted_sha256 else b.h end as extracted_sha256, case when b.h is null then c.chunker_version else 'heading-v1' end as chunker_version,
    case when b.h is null then c.duplicate_of else b.dup end as duplicate_of, case when b.h is null then c.last_touched_run_id else b.run_id end as last_touched_run_id from {NEWEST} c left join b using (source_id, canonical_url)""")
def catalog_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Good extractions recorded, with the first document of the same text in their source."""
    good = table(spark, d, "extract_results").where("ok and source_id is not null and canonical_url is not null").select(*catalog.KEY, "document_id", "run_id", "extracted_at", ids.sha256_text(F.col("extracted_text")).alias("extracted_sha256"))
    same = catalog.exact_duplicates(good, ["source_id", "extracted_sha256"], ["document_id"])
    done = catalog.record_extractions(newest(spark, d), same.withColumn("chunker_version", F.lit(ids.CHUNKER_VERSION)).withColumn("at", F.col("extracted_at")))
    return done.select(*catalog.KEY, "extracted_sha256", "chunker_version", "duplicate_of", "last_touched_run_id")


@query(f"""with b as (select source_id, canonical_url, max((extracted_sha256, chunker_version)) as r from document_chunks where extracted_sha256 is not null and chunker_version is not null group by all)
  select c.source_id, c.canonical_url, case when b.r is null then c.indexed_sha256 else r[1] end as indexed_sha256, case when b.r is null then c.indexed_chunker_version else r[2] end as indexed_chunker_version
  from {NEWEST} c left join b using (source_id, canonical_url)""")
def catalog_indexing(spark: SparkSession, d: str) -> DataFrame:
    """The pages whose chunks there are, recorded as indexed."""
    rows = table(spark, d, "document_chunks").where("extracted_sha256 is not null and chunker_version is not null").select(*catalog.KEY, "extracted_sha256", "chunker_version").distinct()
    done = catalog.record_indexing(newest(spark, d), rows.withColumn("run_id", F.lit("run")).withColumn("at", F.lit(None).cast("timestamp")))
    return done.select(*catalog.KEY, "indexed_sha256", "indexed_chunker_version")


@query(rf"""with f as (select {CLEAN.format('extracted_sha256')} as e, {CLEAN.format('chunker_version')} as v, {CLEAN.format('indexed_sha256')} as i, {CLEAN.format('indexed_chunker_version')} as w from {NEWEST})
  select e is null or v is null as needs_processing, not (e is not null and i is not distinct from e and w is not distinct from v) as needs_indexing, count(*) as n from f group by all""")
def needs_indexing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.needs_processing(newest(spark, d)).groupBy("needs_processing", "needs_indexing").agg(F.count("*").alias("n"))


RUN = "(select source_id, arg_max(id, (finished_at, id)) as run_id from ingestion_runs where status = 'succeeded' and finished_at is not null group by 1)"
MISSED = f"""(select c.*, coalesce(run_id is not null and is_in_corpus = 1 and last_seen_run_id is distinct from run_id, false) as missed, coalesce(consecutive_missing_success_runs, 0) + coalesce(run_id is not null and is_in_corpus = 1 and last_seen_run_id is distinct from run_id, false)::int as misses
  from {NEWEST} c left join {RUN} r on c.source_id = r.source_id)"""


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """The last successful run of each source."""
    return table(spark, d, "ingestion_runs").where("status = 'succeeded' and finished_at is not null").groupBy("source_id").agg(F.max_by("id", F.struct("finished_at", "id")).alias("run_id"))


@query(f"select source_id, canonical_url, missed, misses from {MISSED}")
def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.count_missing(newest(spark, d), last_runs(spark, d)).select("source_id", "canonical_url", "missed", "misses")


@query(f"select source_id, count(*) filter (where misses >= 2 and is_in_corpus = 1) as newly_deleted, count(*) filter (where misses >= 2 or coalesce(is_in_corpus, 0) = 0) as deleted from {MISSED} group by 1")
def soft_deletes(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.soft_delete(catalog.count_missing(newest(spark, d), last_runs(spark, d)))
    return rows.groupBy("source_id").agg(F.count_if("newly_deleted").alias("newly_deleted"), F.count_if("deleted").alias("deleted"))


STATUS_RANK = "case status when 'started' then 0 when 'failed' then 1 else 2 end"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """The runs, opened once for each id and ended by its rows that tell an end; a success outweighs a failure."""
    rows = table(spark, d, "ingestion_runs").where("id is not null")
    starts = rows.groupBy("id").agg(F.min("source_id").alias("source_id"), F.min("started_at").alias("started_at"))
    ends = rows.where("status != 'started'").groupBy("id").agg(F.bool_or(F.col("status") == "succeeded").alias("succeeded"), F.max("finished_at").alias("finished_at"), F.max("error_message").alias("error_message"))
    none = spark.createDataFrame([], "id string, source_id string, status string, started_at timestamp, finished_at timestamp, error_message string")
    return catalog.finish_runs(catalog.open_runs(none, starts), ends)


@query(f"select id, min(source_id) as source_id, max_by(status, ({STATUS_RANK})) as status, strftime(max(finished_at) filter (where status <> 'started'), '%Y-%m-%d %H:%M:%S') as finished from ingestion_runs where id is not null group by id")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("id", "source_id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished"))


@query(f"""with r as (select id, max_by(status, ({STATUS_RANK})) as status from ingestion_runs where id is not null group by id),
  f as (select run_id, count(distinct canonical_url) as urls, count(*) filter (where ok) as fetched, count(*) filter (where not coalesce(ok, false)) as failures from fetch_results group by 1)
  select id, status, coalesce(urls, 0) as urls, coalesce(fetched, 0) as fetched, coalesce(failures, 0) as failures, round(coalesce(failures / nullif(fetched + failures, 0), 0.0), 6) as failure_ratio, coalesce(failures / nullif(fetched + failures, 0), 0.0) > 0.1 as over_limit,
    case when status = 'succeeded' then 0 else 1 end as exit_code from r left join f on run_id = id""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    done = catalog.run_report(ledger(spark, d), table(spark, d, "fetch_results").select("run_id", "canonical_url", "ok"))
    return done.select("id", "status", "urls", "fetched", "failures", "failure_ratio", "over_limit", "exit_code")


@query("""select source_id, count(distinct canonical_url) as urls, count(*) filter (where ok) as fetched, count(*) filter (where not ok) as failures, round(avg(case when ok then 0.0 else 1.0 end), 6) as failure_ratio,
  avg(case when ok then 0.0 else 1.0 end) > 0.1 as over_limit from fetch_results group by 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    bad = F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0))
    rows = table(spark, d, "fetch_results").groupBy("source_id")
    return rows.agg(F.count_distinct("canonical_url").alias("urls"), F.count_if("ok").alias("fetched"), F.count_if(~F.col("ok")).alias("failures"), F.round(bad, 6).alias("failure_ratio"), (bad > 0.1).alias("over_limit"))


@query("select distinct source_id, document_id from catalog_urls where document_id is not null")
def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_urls").where("document_id is not null").select("source_id", "document_id").distinct()


@query(f"select document_id, count(*) as points, count(*) filter (where is_active) as active, count(*) filter (where coalesce(len(vector), -1) = 384) as right_size from {POINTS} group by 1")
def points_by_document(spark: SparkSession, d: str) -> DataFrame:
    rows = index.check_dimension(index.current_points(table(spark, d, "vector_points").select("point_id", "document_id", "is_active", "vector", "created_at")))
    return rows.groupBy("document_id").agg(F.count("*").alias("points"), F.count_if("is_active").alias("active"), F.count_if("dimension_ok").alias("right_size"))


@query(rf"""with w as (select distinct sha256(source_id || canonical_url || 'heading-v1' || chunk_index::varchar) as h from document_chunks where chunker_version = 'heading-v1'),
  ids as (select substr(h,1,8) || '-' || substr(h,9,4) || '-8' || substr(h,14,3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h,17,1)) - 1) & 3) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as point_id from w)
  select point_id, document_id from {POINTS} where is_active and point_id not in (select point_id from ids)""")
def stale_points(spark: SparkSession, d: str) -> DataFrame:
    points = index.current_points(table(spark, d, "vector_points").select("point_id", "document_id", "is_active", "created_at"))
    return index.stale_points(points, table(spark, d, "document_chunks").where("chunker_version = 'heading-v1'")).select("point_id", "document_id")


@query(f"select p.source_id, count(*) as points, count(*) filter (where is_active) as before, count(*) filter (where is_active and g.document_id is null) as after from {POINTS} p left join (select distinct document_id from {NEWEST} where is_in_corpus = 0 and document_id is not null) g using (document_id) group by 1")
def deactivated_points(spark: SparkSession, d: str) -> DataFrame:
    points = index.current_points(table(spark, d, "vector_points").select("point_id", "document_id", "source_id", "is_active", "created_at"))
    rows = index.deactivate(points, newest(spark, d).where("is_in_corpus = 0 and document_id is not null"))
    return rows.groupBy("source_id").agg(F.count("*").alias("points"), F.count_if("was_active").alias("before"), F.count_if("is_active").alias("after"))


@query(f"select point_id, round(sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))), 4) as length from {POINTS} where len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = index.current_points(table(spark, d, "vector_points").select("point_id", "vector", "created_at")).where(F.size("vector") == index.DIM)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine).select("point_id", F.round(norm(F.col("vector")), 4).alias("length"))


# --- retrieval


def usable_vector(dim: int) -> Column:
    """Finite numbers, as many as there must be, and not all zero."""
    return (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)


def ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k nearest embeddings of every 20th one, with labels."""
    rows = table(spark, d, "embeddings")
    labels = rows.select("vec_id", "label")
    hits = retrieval.search(rows.where("vec_id % 20 = 0"), rows, k)
    return hits.join(labels.select(F.col("vec_id").alias("point_id"), "label"), "point_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"select query_id, point_id, score, row_number() over (partition by query_id order by score desc, point_id)::int as rank from ({RANKED}) qualify rank <= 10")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return retrieval.search(rows.where("vec_id % 20 = 0"), rows, 10)


@query(f"select query_id, point_id, score, row_number() over (partition by query_id order by score desc, point_id)::int as rank from ({RANKED}) where label in (0, 1, 2) qualify rank <= 10")
def retrieve_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the search, so that k hits are left."""
    rows = table(spark, d, "embeddings")
    return retrieval.search(rows.where("vec_id % 20 = 0"), rows.where("label in (0, 1, 2)"), 10)


USABLE = "len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0"


@query(f"""with p as (select * from {POINTS} where is_active and source_id is not null and {USABLE}),
  s as (select q.point_id as query_id, p.point_id, p.source_id, p.document_id, p.chunk_id, p.title, p.breadcrumb, p.headings, p.chunk_index, round(list_cosine_similarity(q.vector::double[], p.vector::double[]), 6) as score
    from p q join p on q.source_id = p.source_id where ('0x' || substr(q.point_id, 1, 8))::bigint % 20 = 0 qualify row_number() over (partition by query_id order by score desc, p.source_id, p.document_id, p.chunk_id, p.point_id) <= 10),
  o as (select * from s where score >= 0.0 qualify row_number() over (partition by query_id, coalesce(chunk_id, point_id) order by score desc, source_id, document_id, chunk_id, point_id) = 1)
  select query_id, point_id, score, coalesce(document_id, '') as document_id, coalesce(chunk_id, point_id) as chunk_id, coalesce(title, '') as title, coalesce(breadcrumb, '') as breadcrumb, coalesce(len(headings), 0)::int as n_headings, coalesce(chunk_index, 0) as chunk_index,
    (row_number() over (partition by query_id order by score desc, source_id, document_id, chunk_id, point_id))::int as rank from o""")
def retrieve_points(spark: SparkSession, d: str) -> DataFrame:
    """The points most like every 20th one (by its id) in its own source: active ones only, a total order, a threshold after the search, each chunk once, defaults for what a
    payload lacks."""
    points = index.current_points(table(spark, d, "vector_points").drop("text")).where("is_active and source_id is not null").where(usable_vector(index.DIM))
    order = ["source_id", "document_id", "chunk_id", "point_id"]
    rows = stage(points.sort(*order).withColumn("no", F.monotonically_increasing_id()), "points")  # numbered in the total order, so that ties fall by it
    hits = retrieval.search(rows.where(F.conv(F.substring("point_id", 1, 8), 16, 10).cast("bigint") % 20 == 0), rows, 10, "no", "vector", group="source_id").where("score >= 0.0")
    names = rows.select(F.col("no").alias("query_id"), F.col("point_id").alias("query"))
    whole = hits.withColumnRenamed("point_id", "no").join(rows.drop("vector"), "no").join(names, "query_id")
    best = [F.desc("score"), F.col("no")]
    once = retrieval.with_defaults(retrieval.first_of(whole.withColumn("chunk", F.coalesce("chunk_id", "point_id")), ["query", "chunk"], best))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*best))
    return once.select(F.col("query").alias("query_id"), "point_id", "score", "document_id", "chunk_id", "title", "breadcrumb", F.size("headings").alias("n_headings"), "chunk_index", rank.alias("rank"))


@query(f"select query_id, point_id, score from (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from ({RANKED})) where rank <= 10 and score >= 0.5")
def retrieve_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold comes after the top k, so that fewer than k may be left."""
    return retrieve_topk(spark, d).where("score >= 0.5").select("query_id", "point_id", "score")


@query(f"""with t as (select * from ({RANKED}) qualify row_number() over (partition by query_id order by score desc, point_id) <= 10)
  select query_id, label, point_id from t qualify row_number() over (partition by query_id, label order by score desc, point_id) = 1""")
def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.first_of(ranked(spark, d, 10), ["query_id", "label"], [F.desc("score"), F.col("point_id")]).select("query_id", "label", "point_id")


@query(rf"""with c as (select *, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') as form from {CHUNKS})
  select chunk_id, document_id, chunk_index from c qualify length(form) < 256 or row_number() over (partition by source_id, document_id, canonical_url, form order by chunk_index, chunk_id) = 1""")
def redundant_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document without later ones of the same text."""
    bound_batches(spark)
    rows = chunk_rows(spark, d)
    return retrieval.without_redundant(rows, "document_id", [F.col("chunk_index"), F.col("chunk_id")]).select("chunk_id", "document_id", "chunk_index")


@query("""with recursive c as (select document_id, chunk_id, coalesce(max(token_count), 0)::bigint as t, row_number() over (partition by document_id order by min(chunk_index), chunk_id) as n from document_chunks group by document_id, chunk_id),
  w(document_id, n, kept, total, skipped) as (select document_id, 0::bigint, 0, 0::bigint, 0 from (select distinct document_id from c)
    union all select w.document_id, c.n, w.kept + case when w.kept < 5 and w.total + c.t <= 800 then 1 else 0 end, w.total + case when w.kept < 5 and w.total + c.t <= 800 then c.t else 0 end, w.skipped + case when w.kept < 5 and w.total + c.t <= 800 then 0 else 1 end
    from w join c on c.document_id = w.document_id and c.n = w.n + 1)
  select document_id, kept as n_kept, total as total_tokens, skipped as n_truncated from w qualify row_number() over (partition by document_id order by n desc) = 1""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "document_chunks").groupBy("document_id", "chunk_id").agg(F.max("token_count").alias("tokens"), F.min("chunk_index").alias("at"))
    rows = once.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "tokens"))).alias("hits"))
    packed = rows.select("document_id", retrieval.pack_context(F.col("hits"), 5, 800).alias("p"))
    return packed.select("document_id", F.size("p.kept").alias("n_kept"), F.col("p.total").alias("total_tokens"), F.size("p.truncated").alias("n_truncated"))


@query(f"""with t as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from ({RANKED}) where point_id <> query_id),
  f as (select query_id, query_label, min(rank) filter (where label = query_label and rank <= 20) as r from t group by all)
  select query_label, round(avg(case when r <= 1 then 1.0 else 0.0 end), 6) as recall_at_1, round(avg(case when r <= 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(case when r <= 10 then 1.0 else 0.0 end), 6) as recall_at_10,
    round(avg(coalesce(1.0 / r, 0.0)), 6) as mrr, count(*) as questions from f group by rollup (query_label)""")
def recall_and_mrr(spark: SparkSession, d: str) -> DataFrame:
    """A hit is relevant if it has the query's label; the query itself is no hit."""
    hits = ranked(spark, d, 21).where("point_id != query_id")
    again = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))).where("rank <= 20")
    return retrieval.quality(again, F.col("label") == F.col("query_label"), "query_label")


@query("""select doc_id, case when title is null or trim(title) = '' then 'blank_query' when length(title) > 2000 then 'long_query' when n_chars is null or not (n_chars % 120 between 1 and 100) then 'top_k' when not (doc_id % 12 / 10.0 between 0.0 and 1.0) then 'score_threshold'
  when not (doc_id % 23 between 1 and 20) then 'max_chunks' when not (doc_id % 8500 between 1 and 8000) then 'token_budget' end as error from documents""")
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "documents").select("doc_id", retrieval.request_error(c("title"), c("n_chars") % 120, c("doc_id") % 12 / 10.0, c("doc_id") % 23, c("doc_id") % 8500).alias("error"))


@query()
def page_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pages to chunks to points: extraction, change detection, cutting, embedding, upserts and stale points, per document."""
    latest = catalog.latest(table(spark, d, "fetch_results").where("ok and body is not null and source_id is not null").select("source_id", "canonical_url", "fetch_id", "body", "fetched_at"), catalog.KEY, "fetched_at")
    pages = latest.select(F.col("fetch_id").alias("record_id"), "source_id", "canonical_url", "body")
    cut = stage(pipeline.pages_to_chunks(pages, table(spark, d, "sources"), newest(spark, d)), "chunks")
    points = index.current_points(table(spark, d, "vector_points"))
    _, counts = pipeline.refresh_index(points, cut, pipeline.hash_embedder(), "run", "hash", F.to_timestamp(F.lit("2026-08-29 12:00:00")))
    return counts


LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_SQL = "list_transform(string_split('{0}', ''), lambda ch: (length(lower({1})) - length(replace(lower({1}), ch, '')))::double)"


def letter_counts(text: Column) -> Column:
    """An embedding that SQL can give too: how often each letter stands in a text."""
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in LETTERS))


@query(rf"""with recursive a as (select doc_id as r, title as q, case when title is null or trim(title) = '' then 'blank_query' when length(title) > 2000 then 'long_query' end as error from documents where doc_id % 20 = 0),
  c as (select *, row_number() over (order by source_id, document_id, chunk_id) as no, {LETTER_SQL.format(LETTERS, 'text')} as v, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') as form, len(regexp_extract_all(text, {WORDS})) as t from {CHUNKS}),
  e as (select r, {LETTER_SQL.format(LETTERS, "('" + T.QUERY_PREFIX + "' || q)")} as v from a where error is null),
  h as (select r, c.*, round(list_cosine_similarity(e.v, c.v), 6) as score from e, c where list_sum(c.v) > 0 qualify row_number() over (partition by r order by score desc, no) <= 10),
  f as (select * from h where score >= 0.2 qualify length(form) < 256 or row_number() over (partition by r, source_id, document_id, canonical_url, form order by score desc, no) = 1),
  o as (select *, row_number() over (partition by r order by score desc, no) as n from f),
  w(r, n, urls, total, cut) as (select r, 0::bigint, []::varchar[], 0::bigint, 0 from a union all select w.r, o.n, case when len(urls) < 5 and total + t <= 800 then list_append(urls, o.canonical_url) else urls end,
    total + case when len(urls) < 5 and total + t <= 800 then t else 0 end, cut + case when len(urls) < 5 and total + t <= 800 then 0 else 1 end from w join o on o.r = w.r and o.n = w.n + 1),
  l as (select * from w qualify row_number() over (partition by r order by n desc) = 1),
  z as (select a.r, error, len(urls) = 0 as empty, case when error is null and len(urls) > 0 then 'See ' || urls[1] || ' and https://elsewhere.example/x.' end as answer, urls, total, cut from a join l using (r))
  select r as request_id, error as error_type, empty as context_was_empty, answer, case when answer is null then '' else urls[1] end as citations, case when answer is null then 0 else 1 end as n_fabricated, total as context_tokens, len(urls)::int as n_chunks, cut as n_truncated,
    (error is null)::varchar as ok, answer as said from z""")
def question_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th document's title asked of all chunks by their letters, packed, prompted, answered by quoting the first source, and checked for citations."""
    asked = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("request_id"), F.col("title").alias("query"), F.lit(10).alias("top_k"), F.lit(0.2).alias("score_threshold"), F.lit(5).alias("max_chunks"), F.lit(800).alias("token_budget"))
    # numbered in the total order, so that ties fall by it
    rows = stage(chunk_rows(spark, d).sort("source_id", "document_id", "chunk_id").withColumn("no", F.monotonically_increasing_id()).withColumn("embedding", letter_counts(F.col("text"))), "points")
    queries = asked.where("query is not null").select(F.col("request_id").alias("vec_id"), letter_counts(F.concat(F.lit(T.QUERY_PREFIX), F.col("query"))).alias("embedding"))
    hits = retrieval.search(queries, rows.select(F.col("no").alias("vec_id"), "embedding"), 10).withColumnRenamed("query_id", "request_id")
    whole = hits.join(rows.drop("embedding"), F.col("point_id") == F.col("no"))
    said = pipeline.answers(asked, whole, lambda prompt, context: F.concat(F.lit("See "), F.get(context, F.lit(0))["canonical_url"], F.lit(" and https://elsewhere.example/x.")))
    shown = said.withColumn("citations", F.array_join("citations", " ")).withColumn("ok", F.get_json_object("response", "$.ok")).withColumn("said", F.get_json_object("response", "$.answer"))
    return shown.drop("response")


# --- streams


@query("select event_type, count(distinct event_id) as n from events group by 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    once = streams.run_to_table(streams.deduplicated(streams.event_stream(spark, f"{d}/events.parquet"), delay="7 days"), "append", own_folder(spark))
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as fresh from events),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n, round(sum(value), 2) as total from s group by user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    done = streams.run_to_table(streams.sessions(streams.event_stream(spark, f"{d}/events.parquet")), "complete", own_folder(spark))
    return done.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", F.round("total", 2).alias("total"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    done = streams.run_to_table(streams.windows(streams.event_stream(spark, f"{d}/events.parquet")), "complete", own_folder(spark))
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.event_stream(spark, f"{d}/events.parquet").select("user_id", "event_id")
    return streams.upserts(rows.withColumn("order", F.col("event_id")), ["user_id"], "order", own_folder(spark)).select("user_id", "event_id")


# --- relational smoke over the star schema


@query("""select o_orderpriority, n_name, count(*) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by rollup (o_orderpriority, n_name)""")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    line, order, customer, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("o_orderpriority", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
