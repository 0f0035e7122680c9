"""Named queries of the engine's own operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import engine
from factloom.functions import signature as sg, text as tx, web
from factloom.operators import chain, extract, measures, resolve
from factloom.plans import fixtures
from factloom.session import shared_folder
from factloom.sources import acquire, store
from factloom.sources.tables import table
from factloom.streaming import streams

PRODUCT_SCHEMA = {"fields": {"name": "string", "title": "string", "price": "number", "currency": "string", "brand": "string", "availability": {"type": "string", "optional": True}, "source": "string", "category": "string"}}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_documents").select("page_id", "url", "content_type", "encoding", "ttfb_ms", "body_bytes", F.coalesce("text", F.lit("")).alias("html"))


def stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts, each once, as candidates of their run: canonical field, method label, valid confidence."""
    alias = table(spark, d, "field_aliases").select("field", F.col("canonical_field").alias("_c"))
    f = table(spark, d, "facts").select("run_id", "fact_id", "field", "value", "confidence", "extraction_method").distinct().join(alias, "field")
    ok = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.0)
    method = F.regexp_replace(F.replace(F.lower(F.coalesce("extraction_method", F.lit(""))), F.lit("-"), F.lit("_")), "^l3_", "")
    method = F.when(method == "css", "css_selector").otherwise(method)
    return f.filter(tx.clean_text(F.col("value")) != "").select("run_id", F.col("_c").alias("field"), "value", method.alias("method"), ok.alias("confidence"), F.col("fact_id").alias("seq"))


# -- pages -----------------------------------------------------------------------------------------------------------

_DOC = "(SELECT page_id, url, content_type, coalesce(text, '') AS html FROM fetched_documents)"


@query("title_guess", f"SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)', 1)) AS title FROM {_DOC}")
def title_guess(spark, d):
    return pages(spark, d).select("page_id", sg.title_guess(F.col("html")).alias("title"))


_H = "html"


def _count(tag: str) -> str:
    return f"len(regexp_extract_all(html, '(?i)<{tag}[\\s>]'))"


@query(
    "page_signature",
    f"""SELECT page_id, CASE WHEN contains({_H}, '<') THEN round(length(regexp_replace({_H}, '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]', '', 'g')) / (length({_H}) - length(replace({_H}, '<', ''))), 2) ELSE 1.0 END AS text_ratio,
 {_count("h2")} AS h2, {_count("code")} + {_count("pre")} AS code, len(regexp_extract_all(html, '(?i)<script\\b[^>]*>')) AS scripts,
 contains(lower({_H}), 'ld+json') AS has_jsonld, regexp_matches({_H}, '(?i)<time[\\s>]') OR contains(lower({_H}), 'article:published_time') AS has_time FROM {_DOC}""",
)
def page_signature(spark, d):
    h = F.col("html")
    return pages(spark, d).select("page_id", F.round(sg.text_ratio(h), 2).alias("text_ratio"), sg.tag_count(h, "h2").alias("h2"), (sg.tag_count(h, "code") + sg.tag_count(h, "pre")).alias("code"), sg.scripts(h)["total"].alias("scripts"), F.lower(sg.head_of(h)).contains("ld+json").alias("has_jsonld"), sg.has_time(h).alias("has_time"))


def _any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


_LOW = "lower(html)"
_SCRIPT = "regexp_extract_all(html, '(?i)<script\\b[^>]*>')"
_MARKED = _any("html", [m for _, m in sg.STATE_MARKERS])
_SHELL = _any(_LOW, [n for n, name in sg.FRAMEWORKS if name in ("next.js", "nuxt.js", "gatsby", "svelte", "react", "shopify")])
_GEN = """coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+name=["'']generator["'']', 1), ''))"""
_RATIO = "CASE WHEN contains(html, '<') THEN length(regexp_replace(html, '[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]', '', 'g')) / (length(html) - length(replace(html, '<', ''))) ELSE 1.0 END"
_SPA = f"({_MARKED} OR {_any(f'lower(coalesce({_GEN}, {chr(39)*2}))', ['next.js', 'nuxt', 'gatsby'])} OR ({_SHELL} AND {_RATIO} < 8) OR ({_RATIO} < 4 AND len({_SCRIPT}) >= 5))"
_CHUNKS = f"len(list_filter({_SCRIPT}, lambda x: regexp_matches(x, '(?i)(chunk|bundle|/static/js/|webpack|runtime)')))"
_SPA_SCORE = f"CASE WHEN {_MARKED} THEN 0.35 ELSE 0 END + CASE WHEN {_SHELL} THEN 0.25 ELSE 0 END + CASE WHEN {_CHUNKS} >= 2 THEN 0.15 ELSE 0 END + CASE WHEN {_RATIO} < 5 THEN 0.15 ELSE 0 END"
_CLASS = f"""CASE
 WHEN (CASE WHEN contains({_LOW}, 'product:price') OR contains({_LOW}, 'og:type" content="product') OR contains({_LOW}, 'og:type' || chr(39) || ' content=' || chr(39) || 'product') THEN 2 ELSE 0 END) + (CASE WHEN contains({_LOW}, 'itemprop="price"') OR contains({_LOW}, 'itemprop=' || chr(39) || 'price' || chr(39)) THEN 2 ELSE 0 END)
    + (CASE WHEN contains({_LOW}, 'application/ld+json') AND (contains({_LOW}, 'product') OR contains({_LOW}, 'aggregateoffer') OR contains({_LOW}, '"offer"')) THEN 1 ELSE 0 END)
    + (CASE WHEN regexp_matches({_LOW}, 'class=["''][^"'']*price[^"'']*["'']') THEN 1 ELSE 0 END) >= 2 THEN 'product'
 WHEN {_count("h2")} >= 4 AND {_count("code")} + {_count("pre")} >= 2 THEN 'docs'
 WHEN (contains({_LOW}, 'docs.') OR contains({_LOW}, '/docs/') OR contains({_LOW}, 'documentation')) AND ({_count("h2")} >= 2 OR {_count("code")} + {_count("pre")} >= 1) THEN 'docs'
 WHEN contains({_LOW}, '<article') AND (regexp_matches(html, '(?i)<time[\\s>]') OR contains({_LOW}, 'article:published_time') OR contains({_LOW}, 'itemprop="author"') OR contains({_LOW}, 'name="author"') OR contains({_LOW}, 'article:author')) THEN 'article'
 WHEN contains({_LOW}, 'og:type') AND contains({_LOW}, 'article') THEN 'article'
 WHEN (contains({_LOW}, 'wikipedia.org') OR contains({_LOW}, 'infobox')) AND ({_count("table")} >= 2 OR contains({_LOW}, 'infobox')) THEN 'reference'
 WHEN {_SPA} THEN 'spa' ELSE 'generic' END"""
_SEEN = "lower(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'))"
_WALL = f"{_any(_SEEN, sg.WALL_MARKERS)} OR " + _any("lower(regexp_extract(html, '(?i)<title[^>]*>([^<]+)', 1))", sg.WALL_TITLES)
#: Stored pages, product pages and pages with odd heads under one key.
_ALL_PAGES = f"(SELECT page_id, url, html, ttfb_ms, body_bytes FROM (SELECT page_id, url, coalesce(text, '') AS html, ttfb_ms, body_bytes FROM fetched_documents) UNION ALL SELECT -page_id, url, html, NULL, NULL FROM ({fixtures.PRODUCT_PAGES}) UNION ALL SELECT -1000000000 - page_id, url, html, 120.0, 5000 FROM ({fixtures.HEAD_PAGES}))"


def all_pages(spark: SparkSession, d: str) -> DataFrame:
    none = [F.lit(None).cast("double").alias("ttfb_ms"), F.lit(None).cast("bigint").alias("body_bytes")]
    a = pages(spark, d).select("page_id", "url", "html", "ttfb_ms", "body_bytes")
    b = fixtures.product_pages(spark, d).select(-F.col("page_id").cast("bigint"), "url", "html", *none)
    c = fixtures.head_pages(spark, d).select(-1000000000 - F.col("page_id").cast("bigint"), "url", "html", F.lit(120.0), F.lit(5000).cast("bigint"))
    return a.unionAll(b).unionAll(c)


def _list(needles: list, text: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({text}, '{n}') THEN '{name}' END" for name, n in needles) + "], lambda x: x IS NOT NULL), ',')"


_FRAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(_LOW, [n for n, x in sg.FRAMEWORKS if x == name])} THEN '{name}' END" for name in dict.fromkeys(x for _, x in sg.FRAMEWORKS)) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "signature_struct",
    f"""SELECT page_id, round({_RATIO}, 2) AS text_ratio, coalesce({_GEN}, nullif(regexp_extract(html, '(?i)<!--\\s*(WordPress|Drupal|Joomla|Shopify|Wix|Squarespace|Ghost|Hugo|Jekyll|TYPO3)[^>]*>', 1), '')) AS generator, {_SPA} AS likely_spa,
 CAST(round(least(1.0, {_SPA_SCORE} + CASE WHEN body_bytes < 8000 AND ttfb_ms < 400 THEN 0.2 ELSE 0 END), 2) AS DOUBLE) AS spa_score, regexp_matches(html, '(?i)<time[\\s>]') OR contains({_LOW}, 'article:published_time') AS has_time, contains({_LOW}, 'ld+json') AS has_jsonld, {_CLASS} AS page_class, {_FRAMES} AS frameworks,
 {_list(sg.STATE_MARKERS, "html")} AS embedded_blobs, len({_SCRIPT}) AS scripts_total, len(list_filter({_SCRIPT}, lambda x: regexp_matches(x, '(?i)\\bsrc='))) AS scripts_external, {_CHUNKS} AS scripts_chunks, {_list([(t, t) for t in sg.TRACKERS], _LOW)} AS trackers, {_WALL} AS bot_wall FROM {_ALL_PAGES}""",
)
def signature_struct(spark, d):
    """All of the signature, with the fast-shell term, for all page tables."""
    s = all_pages(spark, d).select("page_id", sg.signature(F.col("html"), F.col("ttfb_ms"), F.col("body_bytes")).alias("s"))
    lists = [F.array_join(f"s.{c}", ",").alias(c) for c in ("frameworks", "embedded_blobs", "trackers")]
    plain = [f"s.{c}" for c in ("text_ratio", "generator", "likely_spa", "spa_score", "has_time", "has_jsonld", "page_class", "bot_wall")]
    return s.select("page_id", *plain, *lists, *[F.col(f"s.scripts.{c}").alias(f"scripts_{c}") for c in ("total", "external", "chunks")])


@query("page_class", f"SELECT page_id, {_CLASS} AS page_class FROM {_ALL_PAGES}")
def page_class(spark, d):
    return all_pages(spark, d).select("page_id", sg.page_class(F.col("html"), sg.single_page_app(F.col("html"))[0]).alias("page_class"))


@query("bot_wall", f"SELECT page_id, {_WALL} AS bot_wall FROM {_DOC}")
def bot_wall(spark, d):
    return pages(spark, d).select("page_id", sg.bot_wall(F.col("html")).alias("bot_wall"))


@query("content_ids", f"SELECT page_id, 'sha256:' || sha256(html) AS content_hash, 'src_meta_' || left(sha256(url), 12) AS source_id FROM {_DOC}")
def content_ids(spark, d):
    return pages(spark, d).select("page_id", web.content_ids(F.col("html"))[0].alias("content_hash"), web.source_id("src_meta_", F.col("url")).alias("source_id"))


@query(
    "mime_charset",
    f"""SELECT page_id, content_type IS NULL OR starts_with(lower(trim(split_part(content_type, ';', 1))), 'text/html') OR starts_with(lower(trim(split_part(content_type, ';', 1))), 'application/xhtml+xml')
 OR starts_with(lower(trim(split_part(content_type, ';', 1))), 'application/json') OR starts_with(lower(trim(split_part(content_type, ';', 1))), 'application/ld+json') AS allowed,
 coalesce(nullif(lower(regexp_extract(content_type, '(?i)charset=["'']?([\\w-]+)', 1)), ''), nullif(lower(regexp_extract(html, '(?i)<meta[^>]+charset=["'']?([\\w-]+)', 1)), ''), 'utf-8') AS charset FROM {_DOC}""",
)
def mime_charset(spark, d):
    return pages(spark, d).select("page_id", web.mime_allowed(F.col("content_type")).alias("allowed"), web.charset(F.col("content_type"), F.col("html")).alias("charset"))


_TAGS = "regexp_extract_all(html, '(?is)<link\\b[^>]*>')"


def _attr(x: str, a: str) -> str:
    return f"""regexp_replace(regexp_extract({x}, '(?is)\\b{a}\\s*=\\s*("[^"]*"|''[^'']*'')', 1), '^["'']|["'']$', '', 'g')"""


def _rel(name: str, more: str = "true") -> str:
    return f"list_filter(l, lambda x: list_contains(string_split(lower({_attr('x', 'rel')}), ' '), '{name}') AND {_attr('x', 'href')} <> '' AND {more})"


_FULL = f"CASE WHEN starts_with({_attr('x', 'href')}, '/') THEN 'https://h.example' || {_attr('x', 'href')} WHEN starts_with({_attr('x', 'href')}, '../') THEN 'https://h.example/' || substr({_attr('x', 'href')}, 4) ELSE {_attr('x', 'href')} END"
_LANGS = _rel("alternate", f"{_attr('x', 'hreflang')} <> ''")
_FEEDS = _rel("alternate", f"lower({_attr('x', 'type')}) IN ('application/rss+xml', 'application/atom+xml')")


@query(
    "head_links",
    f"""SELECT page_id, list_transform({_rel("canonical")}, lambda x: {_FULL})[1] AS canonical, len({_LANGS}) AS hreflang_count, array_to_string(list_transform({_LANGS}, lambda x: {_attr("x", "hreflang")} || ' ' || {_FULL}), ',') AS hreflangs,
 array_to_string(list_transform({_FEEDS}, lambda x: {_FULL}), ',') AS rss, len({_rel("preload")}) AS preload_count, list_transform({_rel("next")}, lambda x: {_FULL})[1] AS rel_next, list_transform({_rel("prev")}, lambda x: {_FULL})[1] AS rel_prev,
 nullif(regexp_extract(html, '(?is)<meta name="theme-color" content="([^"]*)"', 1), '') AS theme_color FROM (SELECT page_id, html, {_TAGS} AS l FROM ({fixtures.HEAD_PAGES}))""",
)
def head_links(spark, d):
    p = fixtures.head_pages(spark, d).select("page_id", sg.head_links(F.col("html"), F.col("url")).alias("h"))
    langs = F.array_join(F.transform("h.hreflangs", lambda x: F.concat_ws(" ", x["lang"], x["href"])), ",").alias("hreflangs")
    return p.select("page_id", "h.canonical", "h.hreflang_count", langs, F.array_join("h.rss", ",").alias("rss"), "h.preload_count", "h.rel_next", "h.rel_prev", "h.theme_color")


_LINK_HEADER = "CASE page_id % 3 WHEN 0 THEN '<https://h.example/n>; rel=\"next\"; type=\"text/html\", </p,q>; rel=prev; title=\"a, b\"' END"


@query(
    "all_links",
    f"""WITH h AS (SELECT page_id, list_filter({_TAGS}, lambda x: {_attr("x", "rel")} <> '' AND {_attr("x", "href")} <> '') AS l FROM ({fixtures.HEAD_PAGES})),
 u AS (SELECT page_id, len(l) AS n, unnest(l) AS x, unnest(range(len(l))) AS pos FROM h)
 SELECT page_id, CAST(pos AS INT) AS pos, {_FULL} AS url, lower({_attr("x", "rel")}) AS rel, nullif({_attr("x", "type")}, '') AS type, nullif({_attr("x", "hreflang")}, '') AS hreflang, 'html' AS source FROM u
 UNION ALL SELECT page_id, CAST(len(l) AS INT), 'https://h.example/n', 'next', 'text/html', NULL, 'http_header' FROM h WHERE page_id % 3 = 0 UNION ALL SELECT page_id, CAST(len(l) + 1 AS INT), 'https://h.example/p,q', 'prev', NULL, NULL, 'http_header' FROM h WHERE page_id % 3 = 0""",
)
def all_links(spark, d):
    """Link elements of the pages, then the links of their Link headers."""
    p = fixtures.head_pages(spark, d).withColumn("link", F.expr(_LINK_HEADER))
    return extract.links(p, header="link").select("page_id", "pos", "url", F.array_join("rel", " ").alias("rel"), "type", "hreflang", "source")


_BLOB = "lower(concat_ws(' ', coalesce(powered, ''), server))"
_COOKIES = "list_filter(list_transform(string_split(coalesce(cookie, ''), ','), lambda x: lower(trim(split_part(x, '=', 1)))), lambda x: " + " OR ".join(f"contains(x, '{w}')" for w in ("ab_", "experiment", "variant", "optimize", "split", "flag")) + ")"


@query(
    "header_profiles",
    f"""SELECT k, CASE WHEN contains(lower(server), 'cloudflare') OR cfs IS NOT NULL THEN 'cloudflare' WHEN contains(lower(server), 'amazon') OR coalesce(contains(lower(via), 'cloudfront'), false) THEN 'cloudfront' WHEN contains(lower(server), 'fastly') OR coalesce(contains(lower(via), 'fastly'), false) THEN 'fastly'
  WHEN contains(lower(server), 'akamai') THEN 'akamai' WHEN contains(lower(server), 'vercel') THEN 'vercel' WHEN contains(lower(server), 'netlify') THEN 'netlify' END AS cdn,
 coalesce(cfs = 'HIT', false) OR coalesce(contains(lower(xcache), 'hit'), false) OR (NOT contains(coalesce(cc, ''), 'no-cache') AND coalesce(CAST(nullif(regexp_extract(cc, 'max-age=([0-9]+)', 1), '') AS BIGINT) >= 300, false)) OR coalesce(TRY_CAST(age AS BIGINT) >= 60, false) AS static_hint,
 CASE WHEN contains({_BLOB}, 'next.js') THEN 'next.js' WHEN contains({_BLOB}, 'express') THEN 'express' WHEN contains({_BLOB}, 'php') THEN 'php' WHEN contains({_BLOB}, 'asp.net') THEN 'asp.net' END AS framework,
 TRY_CAST(age AS BIGINT) AS age_s, array_to_string({_COOKIES}, ',') AS ab_cookies, hsts IS NOT NULL AS hsts, etag FROM ({fixtures.HEADER_ROWS})""",
)
def header_profiles(spark, d):
    h = fixtures.header_rows(spark, d).select("k", web.header_profile(F.col("h")).alias("p"))
    return h.select("k", "p.cdn", "p.static_hint", "p.framework", "p.age_s", F.array_join("p.ab_cookies", ",").alias("ab_cookies"), "p.hsts", "p.etag")


# -- addresses -------------------------------------------------------------------------------------------------------

_HOST = "nullif(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1), '[\\[\\]]', '', 'g')), '')"
_PARTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> '')"
_SKIP = ", ".join(f"'{x}'" for x in web.NO_CATEGORY)


@query(
    "url_facts",
    f"""SELECT DISTINCT url, regexp_replace({_HOST}, '^www\\.', '') AS source,
 regexp_replace(list_filter({_PARTS}, lambda x: lower(x) NOT IN ({_SKIP}) AND NOT regexp_matches(x, '^\\d+$') AND length(x) > 1)[1], '[-_]', ' ', 'g') AS category,
 list_filter({_PARTS}, lambda x: regexp_matches(x, '(?i)^v?\\d+(\\.\\d+)*(\\.x)?$'))[1] AS version FROM ({fixtures.URLS})""",
)
def url_facts(spark, d):
    u = F.col("url")
    return fixtures.urls(spark, d).select("url", web.site(u).alias("source"), web.url_category(u).alias("category"), web.url_version(u).alias("version")).distinct()


_N = "CAST(split_part(h, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(h, '.', 2) AS BIGINT) * 65536 + CAST(split_part(h, '.', 3) AS BIGINT) * 256 + CAST(split_part(h, '.', 4) AS BIGINT)"


@query(
    "url_policy",
    f"""WITH u AS (SELECT DISTINCT url, {_HOST} AS h, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme FROM ({fixtures.URLS})),
 n AS (SELECT * REPLACE (CASE WHEN starts_with(h, '::ffff:') THEN substr(h, 8) ELSE h END AS h), CASE WHEN regexp_matches(h, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN {_N} END AS ip FROM (SELECT * REPLACE (CASE WHEN starts_with(h, '::ffff:') THEN substr(h, 8) ELSE h END AS h) FROM u))
 SELECT url, CASE WHEN scheme NOT IN ('http', 'https') OR h IS NULL THEN 'unsupported' WHEN h IN ({", ".join(f"'{x}'" for x in web.BLOCKED_HOSTS)}) OR ends_with(h, '.local') THEN 'blocked_host'
 WHEN ip BETWEEN 0 AND 16777215 OR ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 2130706432 AND 2147483647 OR ip BETWEEN 2851995648 AND 2852061183 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3232235520 AND 3232301055 OR (contains(h, ':') AND (left(h, 2) IN ('fc', 'fd') OR left(h, 3) IN ('fe8', 'fe9', 'fea', 'feb') OR h = '0:0:0:0:0:0:0:1')) THEN 'private_ip' ELSE 'ok' END AS verdict FROM n""",
)
def url_policy(spark, d):
    return fixtures.urls(spark, d).distinct().select("url", web.url_verdict(F.col("url")).alias("verdict"))


_KINDS = " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{n}')" for n in needles) + f" THEN '{k}'" for needles, k in web.SITE_KINDS)


@query("url_tactic", f"SELECT DISTINCT url, CASE {_KINDS} WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')) || '/', '://[^/]*.*/(docs|doc|api|reference)/') THEN 'docs' ELSE 'generic' END AS tactic FROM ({fixtures.URLS})")
def url_tactic(spark, d):
    return fixtures.urls(spark, d).select("url", sg.tactic(web.url_kind(F.col("url")), F.lit(None).cast("string")).alias("tactic")).distinct()


_URL_KIND = f"CASE {_KINDS} WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')) || '/', '://[^/]*.*/(docs|doc|api|reference)/') THEN 'docs' END"


@query("page_tactic", f"SELECT page_id, coalesce({_URL_KIND}, {_CLASS}) AS tactic FROM {_ALL_PAGES}")
def page_tactic(spark, d):
    """The address' kind, else the markup's."""
    return all_pages(spark, d).select("page_id", sg.tactic(web.url_kind(F.col("url")), sg.page_class(F.col("html"), sg.single_page_app(F.col("html"))[0])).alias("tactic"))


@query("domain_allowlist", f"SELECT DISTINCT url FROM ({fixtures.URLS}) WHERE {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') OR ends_with({_HOST}, '.test')")
def domain_allowlist(spark, d):
    domains = spark.createDataFrame([("example.com",), ("*.example.com",), ("*.test",)], "pattern string")
    return store.allowed_join(fixtures.urls(spark, d).distinct(), domains).select("url").distinct()


# -- values ----------------------------------------------------------------------------------------------------------

_WS = "[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+"
_T = f"trim(regexp_replace(coalesce(value, ''), '{_WS}', ' ', 'g'))"


@query(
    "clean_text",
    f"""SELECT DISTINCT fact_id, CASE WHEN length({_T}) >= 2 AND ((left({_T}, 1) = right({_T}, 1) AND left({_T}, 1) IN ('"', '''', '«', '»', '“', '”')) OR ({_T} LIKE '«%' AND {_T} LIKE '%»')) THEN trim(substr({_T}, 2, length({_T}) - 2)) ELSE {_T} END AS value FROM facts""",
)
def clean_text(spark, d):
    return table(spark, d, "facts").select("fact_id", tx.clean_text(F.col("value")).alias("value")).distinct()


_C = "regexp_replace(value, '[^0-9.,-]', '', 'g')"


@query(
    "price_numbers",
    f"""SELECT DISTINCT fact_id, TRY_CAST(CASE WHEN length({_C}) - length(replace({_C}, ',', '')) = 1 AND strpos(reverse({_C}), ',') < CASE WHEN contains({_C}, '.') THEN strpos(reverse({_C}), '.') ELSE 100000 END THEN replace(replace({_C}, '.', ''), ',', '.') ELSE replace({_C}, ',', '') END AS DOUBLE) AS price
 FROM facts JOIN field_aliases USING (field) WHERE canonical_field = 'price'""",
)
def price_numbers(spark, d):
    a = table(spark, d, "field_aliases").filter("canonical_field = 'price'").select("field")
    return table(spark, d, "facts").join(a, "field", "left_semi").select("fact_id", tx.price_number(F.col("value")).alias("price")).distinct()


_D = "trim(regexp_replace(value, '[^0-9,.\\s-]', '', 'g'))"
_LAST = lambda sign: f"CASE WHEN contains(c, '{sign}') THEN length(c) - strpos(reverse(c), '{sign}') ELSE -1 END"
_COUNT = lambda sign: f"(length(c) - length(replace(c, '{sign}', '')))"


@query(
    "plain_numbers",
    f"""SELECT DISTINCT fact_id, CASE WHEN NOT regexp_matches(n, '\\s') THEN TRY_CAST(n AS DOUBLE) END AS number FROM (SELECT fact_id, CASE WHEN {_COUNT(",")} = 0 AND {_COUNT(".")} = 0 THEN c WHEN {_LAST(",")} > {_LAST(".")} AND {_COUNT(",")} = 1 THEN replace(replace(c, '.', ''), ',', '.')
 WHEN {_LAST(".")} > {_LAST(",")} AND {_COUNT(".")} = 1 THEN replace(c, ',', '') WHEN TRY_CAST(replace(c, ',', '') AS DOUBLE) IS NOT NULL THEN replace(c, ',', '') ELSE replace(replace(c, '.', ''), ',', '.') END AS n
 FROM (SELECT fact_id, {_D} AS c FROM facts JOIN field_aliases USING (field) WHERE canonical_field = 'price'))""",
)
def plain_numbers(spark, d):
    a = table(spark, d, "field_aliases").filter("canonical_field = 'price'").select("field")
    return table(spark, d, "facts").join(a, "field", "left_semi").select("fact_id", tx.coerced(F.col("value"), "number").alias("number")).distinct()


@query(
    "canonical_values",
    """SELECT DISTINCT fact_id, CASE canonical_field WHEN 'price' THEN regexp_replace(lower(trim(value)), '[\\s\\x{A0},]', '', 'g') WHEN 'availability' THEN regexp_replace(lower(trim(value)), '^https?://schema\\.org/', '') ELSE lower(trim(value)) END AS value
 FROM facts JOIN field_aliases USING (field) WHERE canonical_field IN ('price', 'availability', 'brand', 'currency')""",
)
def canonical_values(spark, d):
    a = table(spark, d, "field_aliases").filter(F.col("canonical_field").isin("price", "availability", "brand", "currency"))
    return table(spark, d, "facts").join(a, "field").select("fact_id", tx.canonical_value(F.col("canonical_field"), F.col("value")).alias("value")).distinct()


@query(
    "currency_availability",
    """SELECT DISTINCT fact_id, canonical_field AS field, CASE WHEN canonical_field = 'currency' THEN CASE trim(value) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN '₽' THEN 'RUB' WHEN 'руб' THEN 'RUB' WHEN 'руб.' THEN 'RUB' ELSE upper(left(trim(value), 3)) END
 ELSE CASE lower(split_part(trim(value), '/', -1)) WHEN 'instock' THEN 'true' WHEN 'in_stock' THEN 'true' WHEN 'outofstock' THEN 'false' WHEN 'out_of_stock' THEN 'false' WHEN 'preorder' THEN 'preorder' ELSE value END END AS value
 FROM facts JOIN field_aliases USING (field) WHERE canonical_field IN ('currency', 'availability')""",
)
def currency_availability(spark, d):
    a = table(spark, d, "field_aliases").filter(F.col("canonical_field").isin("currency", "availability"))
    f = table(spark, d, "facts").join(a, "field")
    return f.select("fact_id", F.col("canonical_field").alias("field"), F.when(F.col("canonical_field") == "currency", tx.currency_code(F.col("value"))).otherwise(tx.availability(F.col("value"))).alias("value")).distinct()


_TITLE_WEAK = f"""(value IS NULL OR length(trim(value)) < 2 OR lower(trim(value)) IN ({", ".join(f"'{x}'" for x in [*tx.NO_TITLE, *tx.SITE_NAMES])}) OR (NOT contains(trim(value), ' ') AND length(trim(value)) <= 12 AND regexp_full_match(trim(value), '\\p{{L}}+'))
 OR (length(trim(value)) > 80 AND regexp_matches(trim(value), '^\\p{{Ll}}')) OR starts_with(lower(trim(value)), 'general-purpose') OR starts_with(lower(trim(value)), 'a type of'))"""


@query("weak_titles", f"SELECT DISTINCT fact_id, {_TITLE_WEAK} AS weak FROM facts JOIN field_aliases USING (field) WHERE canonical_field = 'title'")
def weak_titles(spark, d):
    a = table(spark, d, "field_aliases").filter("canonical_field = 'title'").select("field")
    return table(spark, d, "facts").join(a, "field", "left_semi").select("fact_id", tx.weak_title(F.col("value")).alias("weak")).distinct()


# -- facts -----------------------------------------------------------------------------------------------------------

_M = "regexp_replace(replace(lower(coalesce(extraction_method, '')), '-', '_'), '^l3_', '')"
_CAND = f"""(SELECT run_id, field, value, CASE method WHEN 'css' THEN 'css_selector' ELSE method END AS method, confidence, seq FROM (SELECT DISTINCT f.run_id, a.canonical_field AS field, f.value, {_M} AS method,
 CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.0 END AS confidence, f.fact_id AS seq FROM facts f JOIN field_aliases a USING (field) WHERE NOT regexp_full_match(coalesce(value, ''), '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}"''«»“”]*')))"""
_RANK = "CASE method WHEN 'json_ld' THEN 3 WHEN 'meta_og' THEN 2 WHEN 'trafilatura' THEN 2 WHEN 'main_text' THEN 2 WHEN 'css_selector' THEN 1 ELSE 0 END"
_SCORE = f"""CASE WHEN field = 'title' THEN {_RANK} + confidence - CASE WHEN {_TITLE_WEAK} THEN 5 ELSE 0 END + CASE WHEN length(value) BETWEEN 20 AND 160 THEN 0.8 WHEN length(value) BETWEEN 3 AND 80 THEN 0.3 ELSE 0 END
 + CASE WHEN regexp_matches(value, '^\\p{{Lu}}') THEN 0.2 ELSE 0 END + CASE WHEN method IN ('meta_og', 'og_manual', 'css_selector', 'css') THEN 0.5 ELSE 0 END - CASE WHEN method IN ('json-ld', 'microdata') AND length(value) < 20 THEN 0.4 ELSE 0 END ELSE {_RANK} END"""
_RANKED = f"""c AS (SELECT *, field = 'title' AND {_TITLE_WEAK} AS weak FROM {_CAND}), g AS (SELECT *, bool_or(NOT weak) OVER (PARTITION BY run_id, field) AS good FROM c),
 s AS (SELECT *, round({_SCORE}, 9) AS score FROM g WHERE NOT weak OR NOT good), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY score DESC, confidence DESC, seq) AS n, count(*) OVER (PARTITION BY run_id, field) AS k FROM s)"""


@query("resolve_conflicts", f"WITH {_RANKED} SELECT run_id, field, value, method, confidence, k - 1 AS losers FROM r WHERE n = 1")
def resolve_conflicts(spark, d):
    f = resolve.resolve(stored_facts(spark, d), "run_id")
    return f.select("run_id", "field", "value", "method", "confidence", F.size("conflict_values").alias("losers"))


@query("conflict_losers", f"WITH {_RANKED} SELECT run_id, field, value, method, confidence FROM r WHERE n > 1")
def conflict_losers(spark, d):
    f = resolve.resolve(stored_facts(spark, d), "run_id")
    return f.select("run_id", "field", F.explode("conflict_values").alias("v")).select("run_id", "field", "v.*")


@query(
    "consensus_vote",
    f"""WITH c AS (SELECT DISTINCT r.normalized_url, f.field, f.value, f.seq FROM {_CAND} f JOIN (SELECT DISTINCT run_id, normalized_url FROM runs) r USING (run_id)),
 p AS (SELECT normalized_url, field, lower(trim(value)) AS v, count(*) AS votes, min(seq) AS r, arg_min(value, seq) AS value FROM c GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY normalized_url, field ORDER BY votes DESC, r, v) AS n, sum(votes) OVER (PARTITION BY normalized_url, field) AS total, count(*) OVER (PARTITION BY normalized_url, field) AS distinct_values FROM p)
 SELECT normalized_url, field, value, votes, round(votes / total, 3) AS agreement, distinct_values FROM w WHERE n = 1""",
)
def consensus_vote(spark, d):
    runs = table(spark, d, "runs").select("run_id", "normalized_url").distinct()
    c = stored_facts(spark, d).join(runs, "run_id").select("normalized_url", "field", "value", "seq").distinct()
    return resolve.consensus(c.filter(F.col("normalized_url").isNotNull()), ["normalized_url", "field"], "value", "seq")


_ASKED = {"title": {}, "description": {}, "source": {}, "publish_date": {"optional": True}}


@query(
    "missing_status",
    f"""WITH h AS (SELECT run_id, count(*) AS n, count(DISTINCT field) FILTER (WHERE field IN ('title', 'description', 'source', 'publish_date')) AS k, count(DISTINCT field) FILTER (WHERE field IN ('title', 'description', 'source')) AS kr FROM {_CAND} GROUP BY run_id)
 SELECT r.run_id, 4 - coalesce(k, 0) AS missing, 3 - coalesce(kr, 0) AS required_missing, coalesce(n, 0) AS n_facts, CASE WHEN k = 4 THEN 'success' WHEN n > 0 THEN 'partial' ELSE 'unresolved' END AS status FROM (SELECT DISTINCT run_id FROM runs) r LEFT JOIN h USING (run_id)""",
)
def missing_status(spark, d):
    m = resolve.missing(table(spark, d, "runs").select("run_id").distinct(), stored_facts(spark, d), _ASKED, "run_id")
    m = m.withColumn("status", resolve.status(F.lit(False), F.size("missing"), F.col("n_facts")))
    return m.select("run_id", F.size("missing").alias("missing"), F.size("required_missing").alias("required_missing"), "n_facts", "status")


_ROUTED = "coalesce(bytes_downloaded, 0)"


@query(
    "route_decision",
    f"""WITH t AS (SELECT DISTINCT run_id, level, status, warnings, missing_fields, normalized_url, {_ROUTED} AS b FROM runs), u AS (SELECT run_id, {_HOST.replace("url,", "normalized_url,")} AS h, CASE {_KINDS.replace("url", "normalized_url")} WHEN regexp_matches(lower(normalized_url) || '/', '://[^/]*.*/(docs|doc|api|reference)/') THEN 'docs' ELSE 'generic' END AS tactic,
  CASE level WHEN 'L0' THEN 'http' WHEN 'L3' THEN 'browser' ELSE 'auto' END AS mode, CASE WHEN status = 'unresolved' AND b % 2 = 0 THEN 'L3_browser' WHEN status = 'unresolved' THEN 'L1_http' END AS rule, coalesce(contains(warnings, 'bot_wall_detected'), false) AS wall, coalesce(contains(warnings, 'http status'), false) AS fault,
  coalesce(contains(missing_fields, '"price"'), false) AS price, coalesce(missing_fields <> '[]', false) AS gaps, b % 5 = 0 AS score, b % 7 = 0 AS spa FROM t),
 v AS (SELECT *, regexp_replace(h, '^www\\.', '') AS site, tactic IN ('product', 'spa') AS hint FROM u)
 SELECT run_id, CASE WHEN mode = 'http' THEN 'mode=http' WHEN rule IS NOT NULL THEN 'domain_rule:' || site WHEN mode = 'browser' THEN 'mode=browser' WHEN wall THEN 'bot_wall' WHEN fault THEN 'failure:needs_browser:http' WHEN gaps AND hint THEN 'browser_hint+missing' WHEN price AND score THEN 'price_missing+spa_score'
  WHEN gaps AND spa THEN 'likely_spa+missing' WHEN hint THEN 'tactic:' || tactic || ':browser_hint' ELSE 'tactic:' || tactic END AS reason,
 CAST(CASE WHEN mode = 'http' THEN 1.0 WHEN rule = 'L3_browser' THEN 0.9 WHEN rule IS NOT NULL THEN 0.7 WHEN mode = 'browser' THEN 1.0 WHEN wall THEN 0.95 WHEN fault THEN 0.9 WHEN gaps AND hint THEN 0.85 WHEN price AND score THEN 0.8 WHEN gaps AND spa THEN 0.75 WHEN hint THEN 0.55 WHEN tactic = 'docs' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence,
 mode <> 'http' AND (coalesce(rule = 'L3_browser', false) OR (rule IS NULL AND (mode = 'browser' OR wall OR fault OR (gaps AND hint) OR (price AND score) OR (gaps AND spa)))) AS escalate, CAST(CASE WHEN spa OR hint THEN 0.3 ELSE 0.8 END AS DOUBLE) AS predicted FROM v""",
)
def route_decision(spark, d):
    """All branches of the decision: mode, rules, faults and signs are derived from each run's columns."""
    r = whole_runs(spark, d, "level", "status", "warnings", "missing_fields", "normalized_url", "bytes_downloaded").withColumn("b", F.expr(_ROUTED))
    r = r.withColumn("tactic", sg.tactic(web.url_kind(F.col("normalized_url")), F.lit(None).cast("string"))).withColumn("m", F.coalesce(F.from_json("missing_fields", "array<string>"), F.array().cast("array<string>")))
    mode = F.when(F.col("level") == "L0", "http").when(F.col("level") == "L3", "browser").otherwise("auto")
    rule = F.when((F.col("status") == "unresolved") & (F.col("b") % 2 == 0), "L3_browser").when(F.col("status") == "unresolved", "L1_http")
    fault = F.when(F.col("warnings").contains("bot_wall_detected"), "bot_wall").when(F.col("warnings").contains("http status"), "needs_browser:http")
    sig = F.struct(F.col("tactic").isin("product", "spa").alias("browser_hint"), F.when(F.col("b") % 5 == 0, 0.6).otherwise(0.2).alias("spa_score"), (F.col("b") % 7 == 0).alias("likely_spa"))
    x = resolve.route(mode, rule, fault, F.col("m"), sig, F.col("tactic"), web.site(F.col("normalized_url")))
    r = r.select("run_id", x.alias("x"), resolve.predicted_confidence(sig).alias("predicted"))
    return r.select("run_id", "x.reason", "x.confidence", resolve.should_escalate(F.col("x")).alias("escalate"), "predicted")


def whole_runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Runs, each once, with the named columns alone: only these are read and shuffled. Repeated rows of a run are equal in
    all columns, so they are equal in these too, and rows of one run that differ keep apart where they differ in these."""
    return table(spark, d, "runs").select("run_id", *columns).distinct()


_FACT_ROW = ["extraction_method"]

# -- telemetry -------------------------------------------------------------------------------------------------------

_R = "(SELECT DISTINCT * FROM runs)"
_F = "(SELECT DISTINCT * FROM facts)"


@query(
    "economics",
    f"""WITH r AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE level IN ('L3', 'L4')) AS browser_runs, count(*) FILTER (WHERE contains(warnings, 'l2_llm_fill') OR contains(warnings, 'l2_failed')) AS llm_runs FROM {_R}),
 f AS (SELECT count(*) AS facts_total, count(*) FILTER (WHERE len(evidence_ids) > 0) AS ids, count(*) FILTER (WHERE run_id IN (SELECT run_id FROM evidence)) AS facts_with_evidence FROM {_F})
 SELECT total_runs, browser_runs, llm_runs, 1 - round(browser_runs / total_runs, 3) AS browser_avoidance_rate, 1 - round(llm_runs / total_runs, 3) AS llm_avoidance_rate, facts_total, facts_with_evidence, round(facts_with_evidence / facts_total, 3) AS provenance_coverage, round(ids / facts_total, 3) AS fact_coverage FROM r, f""",
)
def economics(spark, d):
    f = table(spark, d, "facts").select("run_id", "fact_id", F.size("evidence_ids").alias("n"), *_FACT_ROW).distinct()
    return measures.economics(whole_runs(spark, d, "level", "warnings"), f.withColumn("evidence_ids", F.when(F.col("n") > 0, F.array(F.lit("x")))), table(spark, d, "evidence"))


@query("level_status", f"SELECT coalesce(level, 'all') AS level, coalesce(status, 'all') AS status, count(*) AS runs FROM (SELECT coalesce(level, 'unknown') AS level, coalesce(status, 'unknown') AS status FROM {_R}) GROUP BY ROLLUP (level, status)")
def level_status(spark, d):
    return measures.histogram(whole_runs(spark, d, "level", "status"))


@query("warning_kinds", f"""SELECT split_part(w, ':', 1) AS warning, count(*) AS runs FROM (SELECT unnest(from_json(warnings, '["VARCHAR"]')) AS w FROM {_R}) GROUP BY 1""")
def warning_kinds(spark, d):
    return measures.warning_counts(whole_runs(spark, d, "warnings"))


@query(
    "latency_picks",
    "WITH v AS (SELECT latency_ms, run_id, row_number() OVER (ORDER BY latency_ms, run_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT * FROM runs) WHERE latency_ms > 0 AND NOT isnan(latency_ms)) SELECT CAST(share AS DOUBLE) AS share, latency_ms AS value FROM v, (VALUES (0.5), (0.95)) AS s(share) WHERE r = least(CAST(floor(n * share) AS BIGINT), n - 1)",
)
def latency_picks(spark, d):
    r = whole_runs(spark, d, "latency_ms").filter((F.col("latency_ms") > 0) & ~F.isnan("latency_ms"))
    return measures.picked(r, "latency_ms", "run_id", [0.5, 0.95])


@query(
    "overview",
    f"SELECT count(*) AS total_runs, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0 END), 4) AS success_rate, round(avg(CASE WHEN status = 'partial' THEN 1.0 ELSE 0 END), 4) AS partial_rate, round(avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0 END), 4) AS failure_rate, round(avg(bytes_downloaded), 2) AS avg_bytes, round(avg(CASE WHEN level IN ('L3', 'L4') THEN 1.0 ELSE 0 END), 4) AS browser_fallback_rate FROM {_R}",
)
def overview(spark, d):
    return measures.overview(whole_runs(spark, d, "level", "status", "bytes_downloaded"))


@query(
    "run_metrics",
    f"""SELECT r.run_id, coalesce(n, 0) AS n_facts, round(coalesce(n, 0) / 8, 4) AS completeness, round(least(coalesce(n, 0) / 8, 1.0), 4) AS completeness_capped, coalesce(level = 'L1' AND status IN ('success', 'partial'), false) AS deterministic, coalesce(level IN ('L0', 'L1', 'L2'), false) AS no_browser,
 coalesce(level IN ('L0', 'L1'), false) AS no_model, bytes_downloaded FROM {_R} r LEFT JOIN (SELECT run_id, count(*) AS n FROM {_F} GROUP BY run_id) USING (run_id)""",
)
def run_metrics(spark, d):
    return measures.run_metrics(whole_runs(spark, d, "level", "status", "bytes_downloaded"), table(spark, d, "facts").select("run_id", "fact_id", *_FACT_ROW).distinct(), 8)


@query("method_stats", f"SELECT coalesce(extraction_method, 'unknown') AS method, count(*) AS facts, count(DISTINCT field) AS fields, round(CAST(sum(CAST(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS DECIMAL(20,10))) AS DOUBLE) / nullif(count(CASE WHEN confidence BETWEEN 0 AND 1 THEN 1 END), 0), 6) AS mean_confidence FROM {_F} GROUP BY 1")
def method_stats(spark, d):
    return measures.method_stats(table(spark, d, "facts").select("run_id", "fact_id", *_FACT_ROW, "field", "confidence").distinct())


@query(
    "evidence_validity",
    f"""WITH c AS (SELECT run_id, fact_id, unnest(CASE WHEN len(evidence_ids) > 0 THEN evidence_ids ELSE [NULL] END) AS e FROM {_F}), k AS (SELECT c.run_id, c.fact_id, bool_and(x.evidence_id IS NOT NULL) AS ok FROM c LEFT JOIN (SELECT DISTINCT run_id, evidence_id FROM evidence) x ON x.run_id = c.run_id AND x.evidence_id = c.e GROUP BY c.run_id, c.fact_id)
 SELECT run_id, count(*) AS facts, count(*) FILTER (WHERE ok) AS valid FROM k GROUP BY run_id""",
)
def evidence_validity(spark, d):
    return measures.evidence_validity(table(spark, d, "facts").select("run_id", "fact_id", "evidence_ids").distinct(), table(spark, d, "evidence"))


# -- ground truth ----------------------------------------------------------------------------------------------------

_RULES = """SELECT run_id AS item_id, field, kind, equals, lo, hi, min_len FROM (SELECT DISTINCT run_id FROM runs) CROSS JOIN (VALUES ('title', 'min_len', CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 12),
 ('price', 'range', CAST(NULL AS STRING), CAST(10 AS DOUBLE), CAST(60 AS DOUBLE), CAST(NULL AS INT)), ('availability', 'equals', 'true', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS INT)), ('currency', 'in', 'eur', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS INT))) AS t(field, kind, equals, lo, hi, min_len)"""


def _truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fixtures.views(spark, d, "runs")
    rules = spark.sql(_RULES).withColumn("contains", F.array(F.lit("x"))).withColumn("in_set", F.array(F.lit("EUR"), F.lit("USD")))
    return rules, resolve.resolve(stored_facts(spark, d), "run_id", losers=False).select(F.col("run_id").alias("item_id"), "field", "value")


_SCORED = f"""{_RANKED}, best AS (SELECT run_id, field, value FROM r WHERE n = 1), rules AS ({_RULES}),
 j AS (SELECT coalesce(x.item_id, b.run_id) AS item_id, x.item_id IS NOT NULL AS asked, b.value IS NOT NULL AS found, CASE WHEN x.item_id IS NULL THEN 'extra' WHEN x.kind = 'min_len' THEN 'soft' ELSE 'strict' END AS strength,
  coalesce(CASE x.kind WHEN 'equals' THEN lower(trim(b.value)) = x.equals WHEN 'in' THEN lower(trim(b.value)) IN ('eur', 'usd') WHEN 'range' THEN TRY_CAST(b.value AS DOUBLE) BETWEEN x.lo AND x.hi WHEN 'min_len' THEN length(trim(b.value)) >= x.min_len END, false) AS ok
  FROM rules x FULL OUTER JOIN best b ON b.run_id = x.item_id AND b.field = x.field),
 sc AS (SELECT item_id, strength, sum(CASE WHEN asked AND found AND ok THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN asked AND found AND NOT ok THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN asked AND NOT found THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN asked THEN 0 ELSE 1 END) AS extra FROM j GROUP BY 1, 2)"""


@query("gt_scores", f"WITH {_SCORED} SELECT item_id, strength, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(extra AS BIGINT) AS extra FROM sc")
def gt_scores(spark, d):
    return measures.scores(*_truth(spark, d))


_SUM = "sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(extra) AS extra"


@query(
    "gt_summary",
    f"""WITH {_SCORED}, a AS (SELECT coalesce(strength, 'all') AS strength, count(DISTINCT item_id) AS items, {_SUM} FROM sc GROUP BY ROLLUP (strength))
 SELECT strength, items, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(extra AS BIGINT) AS extra, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp + extra, 0), 0), 6) AS effective_precision FROM a""",
)
def gt_summary(spark, d):
    return measures.summary(measures.scores(*_truth(spark, d)))


@query(
    "class_precision",
    f"""WITH {_SCORED}, it AS (SELECT item_id, sum(tp) AS tp, sum(tp + fp + fn) AS asked FROM sc GROUP BY 1), ru AS (SELECT DISTINCT run_id, coalesce(schema_hash, 'unknown') AS class, coalesce(CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END, 0) AS ms FROM runs),
 jo AS (SELECT class, tp, asked, ms, row_number() OVER (PARTITION BY class ORDER BY ms, run_id) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM ru JOIN it ON it.item_id = ru.run_id)
 SELECT class, count(*) AS items, CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(tp) AS BIGINT) AS correct, round(coalesce(sum(tp) / nullif(sum(asked), 0), 0), 6) AS precision, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN ms END) AS p50_ms, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN ms END) AS p95_ms FROM jo GROUP BY class""",
)
def class_precision(spark, d):
    rules, facts = _truth(spark, d)
    ms = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    latency = whole_runs(spark, d, "schema_hash", "latency_ms").select(F.col("run_id").alias("item_id"), F.col("schema_hash").alias("class"), ms.alias("latency_ms"))
    return measures.class_precision(rules, facts, latency, "class")


@query("conflict_winners", f"WITH {_RANKED} SELECT method, count(*) AS facts, count(*) FILTER (WHERE k > 1) AS won, CAST(sum(k - 1) AS BIGINT) AS beaten FROM r WHERE n = 1 GROUP BY method")
def conflict_winners(spark, d):
    """Per method: the facts it gives after resolution, how many against others, and how many candidates it beat."""
    f = resolve.resolve(stored_facts(spark, d), "run_id").select("method", F.size("conflict_values").alias("n"))
    return f.groupBy("method").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("n") > 0).alias("won"), F.sum("n").cast("bigint").alias("beaten"))


@query("missing_counts", f"""SELECT field, count(*) AS runs FROM (SELECT unnest(from_json(missing_fields, '["VARCHAR"]')) AS field FROM {_R}) GROUP BY 1""")
def missing_counts(spark, d):
    m = whole_runs(spark, d, "missing_fields").select(F.explode(F.from_json("missing_fields", "array<string>")).alias("field"))
    return m.groupBy("field").agg(F.count(F.lit(1)).alias("runs"))


def _meta_sql(by: str, name: str) -> str:
    return f"""coalesce(list_transform(list_filter(m, lambda x: lower(regexp_extract(x, '(?i)\\b{by}="([^"]*)"', 1)) = '{name}'), lambda x: trim(regexp_extract(x, '(?i)\\bcontent="([^"]*)"', 1)))[1], '')"""


_CLAIM_SQL = " UNION ALL ".join(
    [f"SELECT page_id, 'opengraph' AS source, 1 AS rank, '{f}' AS field, {_meta_sql('property', p)} AS value FROM m" for p, f in extract.CLAIMED_OG]
    + [f"SELECT page_id, 'meta', 2, '{f}', {_meta_sql('name', f)} FROM m" for f in ("description", "author", "keywords")]
    + ["SELECT page_id, 'visible', 3, 'title', coalesce(nullif(t, ''), h1) FROM m", "SELECT page_id, 'visible', 3, 'name', h1 FROM m"]
    + ["SELECT page_id, 'jsonld', 0, unnest(['name', 'brand', 'price', 'currency', 'availability']), unnest([p_name, p_brand, price, 'EUR', 'https://schema.org/InStock']) FROM p WHERE page_id % 3 <> 0"]
)


@query(
    "truth_sources",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_name, p_brand, {fixtures.PRICE} AS price FROM part), m AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<meta\\b[^>]*>') AS m, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS t, trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)) AS h1 FROM ({fixtures.PRODUCT_PAGES})) SELECT * FROM ({_CLAIM_SQL}) WHERE trim(value) <> ''""",
)
def truth_sources(spark, d):
    """What each source of a page claims: JSON-LD, Open Graph, standard meta, visible elements."""
    return extract.claims(fixtures.product_pages(spark, d)).select("page_id", "source", "rank", "field", "value")


@query(
    "truth_of_pages",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_name, p_brand, {fixtures.PRICE} AS price FROM part), m AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<meta\\b[^>]*>') AS m, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS t, trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)) AS h1 FROM ({fixtures.PRODUCT_PAGES})), c AS (SELECT * FROM ({_CLAIM_SQL}) WHERE trim(value) <> ''),
 g AS (SELECT page_id, field, lower(trim(value)) AS v, count(*) AS votes, min(rank) AS r, arg_min(value, rank) AS value FROM c GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY votes DESC, r, v) AS n, sum(votes) OVER (PARTITION BY page_id, field) AS total FROM g)
 SELECT page_id, field, value, votes, round(votes / total, 3) AS agreement FROM w WHERE n = 1""",
)
def truth_of_pages(spark, d):
    """Consensus of a page's own sources."""
    c = resolve.consensus(extract.claims(fixtures.product_pages(spark, d)), ["page_id", "field"], "value", "rank")
    return c.select("page_id", "field", "value", "votes", "agreement")


@query(
    "completeness_by_class",
    f"""WITH i AS (SELECT r.run_id, r.schema_hash AS class, f.field FROM (SELECT DISTINCT run_id, schema_hash FROM runs) r CROSS JOIN (VALUES ('title'), ('description'), ('source')) AS f(field)), h AS (SELECT DISTINCT run_id, field FROM {_CAND} WHERE length(trim(value)) > 0)
 SELECT coalesce(class, 'all') AS class, count(DISTINCT i.run_id) AS items, count(*) AS required, count(h.run_id) AS found, round(count(h.run_id) / count(*), 6) AS completeness FROM i LEFT JOIN h ON h.run_id = i.run_id AND h.field = i.field GROUP BY ROLLUP (class)""",
)
def completeness_by_class(spark, d):
    asked = F.explode(F.array(*[F.lit(x) for x in ("title", "description", "source")])).alias("field")
    items = table(spark, d, "runs").select(F.col("run_id").alias("item_id"), F.col("schema_hash").alias("class")).distinct().select("item_id", "class", asked, F.lit(False).alias("optional"))
    return measures.completeness(items, stored_facts(spark, d).withColumnRenamed("run_id", "item_id"), "class")


@query(
    "compare_arms",
    f"""WITH a AS (SELECT run_id, count(DISTINCT field) AS v FROM {_CAND} GROUP BY run_id), b AS (SELECT run_id, count(DISTINCT field) AS v FROM {_CAND} WHERE method IN ('json_ld', 'meta_og') GROUP BY run_id)
 SELECT count(*) AS items, round(avg(a.v), 6) AS mean_a, round(avg(b.v), 6) AS mean_b, round(avg(a.v) - avg(b.v), 6) AS delta, count(*) FILTER (WHERE a.v > b.v) AS wins, count(*) FILTER (WHERE a.v < b.v) AS losses, count(*) FILTER (WHERE a.v = b.v) AS ties FROM a JOIN b USING (run_id)""",
)
def compare_arms(spark, d):
    f = stored_facts(spark, d)
    arm = lambda x: x.groupBy("run_id").agg(F.countDistinct("field").alias("v"))
    return measures.compare_arms(arm(f), arm(f.filter(F.col("method").isin("json_ld", "meta_og"))), "run_id", "v")


@query(
    "loose_matches",
    f"""WITH a AS (SELECT f.fact_id, f.value AS a, b.value AS b FROM (SELECT DISTINCT fact_id, run_id, value FROM facts JOIN field_aliases USING (field) WHERE canonical_field = 'price') f JOIN (SELECT run_id, value FROM ({f"WITH {_RANKED} SELECT * FROM r WHERE n = 1 AND field = 'price'"})) b USING (run_id))
 SELECT fact_id, coalesce(lower(trim(a)) = lower(trim(b)) OR contains(lower(trim(a)), lower(trim(b))) OR contains(lower(trim(b)), lower(trim(a))) OR coalesce(abs(TRY_CAST(trim(a) AS DOUBLE) - TRY_CAST(trim(b) AS DOUBLE)) <= 0.1 * greatest(abs(TRY_CAST(trim(b) AS DOUBLE)), 1e-9), false), false) AS same FROM a""",
)
def loose_matches(spark, d):
    alias = table(spark, d, "field_aliases").filter("canonical_field = 'price'").select("field")
    f = table(spark, d, "facts").join(alias, "field", "left_semi").select("fact_id", "run_id", F.col("value").alias("a")).distinct()
    b = resolve.resolve(stored_facts(spark, d).filter("field = 'price'"), "run_id", losers=False).select("run_id", F.col("value").alias("b"))
    return f.join(b, "run_id").select("fact_id", F.coalesce(tx.loose_match(F.col("a"), F.col("b")), F.lit(False)).alias("same"))


@query(
    "value_warnings",
    f"""SELECT DISTINCT fact_id, concat_ws(',', CASE WHEN coalesce(trim(value), '') = '' THEN 'empty' END, CASE WHEN k = 'price' AND p IS NULL THEN 'no_number' END, CASE WHEN k = 'price' AND p <= 0 THEN 'not_positive' END, CASE WHEN k = 'price' AND p > 1000000 THEN 'very_high' END,
 CASE WHEN k = 'currency' AND NOT coalesce(regexp_full_match(value, '[A-Z]{{3}}'), false) THEN 'no_code' END,
 CASE WHEN k = 'availability' AND NOT coalesce(lower(split_part(trim(value), '/', -1)) IN ('instock', 'in_stock', 'outofstock', 'out_of_stock', 'preorder') OR value IN ('true', 'false', 'preorder'), false) THEN 'unknown_word' END, CASE WHEN k IN ('title', 'name') AND {_TITLE_WEAK} THEN 'weak_title' END) AS warnings
 FROM (SELECT fact_id, value, canonical_field AS k, TRY_CAST(CASE WHEN length({_C}) - length(replace({_C}, ',', '')) = 1 AND strpos(reverse({_C}), ',') < CASE WHEN contains({_C}, '.') THEN strpos(reverse({_C}), '.') ELSE 100000 END THEN replace(replace({_C}, '.', ''), ',', '.') ELSE replace({_C}, ',', '') END AS DOUBLE) AS p
 FROM facts JOIN field_aliases USING (field))""",
)
def value_warnings(spark, d):
    a = table(spark, d, "field_aliases")
    w = resolve.value_warnings(F.col("canonical_field"), F.col("value"))
    return table(spark, d, "facts").join(a, "field").select("fact_id", F.array_join(w, ",").alias("warnings")).distinct()


_WARNED = """concat_ws(',', CASE WHEN coalesce(trim(value), '') = '' THEN 'empty' END, CASE WHEN field = 'price' AND p IS NULL THEN 'no_number' END, CASE WHEN field = 'price' AND p <= 0 THEN 'not_positive' END, CASE WHEN field = 'price' AND p > 1000000 THEN 'very_high' END,
 CASE WHEN field = 'currency' AND NOT coalesce(regexp_full_match(value, '[A-Z]{3}'), false) THEN 'no_code' END,
 CASE WHEN field = 'availability' AND NOT coalesce(lower(split_part(trim(value), '/', -1)) IN ('instock', 'in_stock', 'outofstock', 'out_of_stock', 'preorder') OR value IN ('true', 'false', 'preorder'), false) THEN 'unknown_word' END, CASE WHEN field IN ('title', 'name') AND """ + _TITLE_WEAK + """ THEN 'weak_title' END)"""
_PRICE = f"TRY_CAST(CASE WHEN length({_C}) - length(replace({_C}, ',', '')) = 1 AND strpos(reverse({_C}), ',') < CASE WHEN contains({_C}, '.') THEN strpos(reverse({_C}), '.') ELSE 100000 END THEN replace(replace({_C}, '.', ''), ',', '.') ELSE replace({_C}, ',', '') END AS DOUBLE)"


@query("auto_truth", f"SELECT normalized_url, field, value, votes, agreement, distinct_values, {_WARNED} AS warnings FROM (SELECT *, {_PRICE} AS p FROM ({SQL['consensus_vote']})) WHERE agreement >= 0.5")
def auto_truth(spark, d):
    """Consensus values of each page with an agreement of half or more."""
    runs = table(spark, d, "runs").select("run_id", "normalized_url").distinct()
    c = stored_facts(spark, d).join(runs, "run_id").select("normalized_url", "field", "value", "seq").distinct()
    return resolve.auto_truth(c, ["normalized_url", "field"], 0.5, "value", "seq").withColumn("warnings", F.array_join("warnings", ","))


# -- store -----------------------------------------------------------------------------------------------------------


@query("latest_runs", f"SELECT normalized_url, run_id, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY retrieved_at DESC NULLS LAST, run_id) AS position FROM {_R}) WHERE position <= 2")
def latest_runs(spark, d):
    return store.latest_per_url(whole_runs(spark, d, "normalized_url", "retrieved_at"), 2).select("normalized_url", "run_id", "position")


@query("runs_upsert", f"SELECT normalized_url, max(stored_at) AS stored_at, arg_max(status, stored_at) AS status, min(stored_at) AS first_at FROM (SELECT normalized_url, stored_at, coalesce(status, 'unknown') AS status FROM {_R} WHERE stored_at IS NOT NULL AND normalized_url IS NOT NULL) GROUP BY 1")
def runs_upsert(spark, d):
    r = whole_runs(spark, d, "normalized_url", "status", "stored_at").filter("stored_at IS NOT NULL AND normalized_url IS NOT NULL").select("normalized_url", "stored_at", F.coalesce("status", F.lit("unknown")).alias("status"), F.col("stored_at").alias("first_at"))
    cut = F.lit("2024-01-01").cast("timestamp")
    return store.upsert(r.filter(F.col("stored_at") < cut), r.filter(F.col("stored_at") >= cut), ["normalized_url"], "stored_at", ["status"])


_ONE = "(SELECT min(normalized_url) FROM runs)"


@query("query_by_url", f"SELECT run_id, retrieved_at FROM (SELECT DISTINCT run_id, retrieved_at, normalized_url FROM runs) WHERE normalized_url = {_ONE} ORDER BY retrieved_at DESC NULLS LAST, run_id LIMIT 10")
def query_by_url(spark, d):
    r = table(spark, d, "runs").select("run_id", "retrieved_at", "normalized_url").distinct()
    return store.by_url(r, r.agg(F.min("normalized_url")).scalar()).select("run_id", "retrieved_at")


@query("query_by_signature", "SELECT run_id, retrieved_at FROM (SELECT DISTINCT run_id, retrieved_at, content_signature FROM runs) WHERE content_signature = (SELECT max(content_signature) FROM runs)")
def query_by_signature(spark, d):
    r = whole_runs(spark, d, "retrieved_at", "content_signature")
    return store.by_signature(r, r.agg(F.max("content_signature")).scalar()).select("run_id", "retrieved_at")


@query("get_run", f"SELECT run_id, status, level, latency_ms FROM {_R} WHERE run_id = (SELECT min(run_id) FROM runs)")
def get_run(spark, d):
    r = whole_runs(spark, d, "status", "level", "latency_ms")
    return store.by_id(r, r.agg(F.min("run_id")).scalar())


@query(
    "candidate_maps",
    f"SELECT run_id, array_to_string(list_sort(list(field || '=' || value)), '|') AS candidates FROM (SELECT run_id, field, arg_min(value, seq) AS value FROM {_CAND} GROUP BY run_id, field) GROUP BY run_id",
)
def candidate_maps(spark, d):
    m = resolve.candidate_map(stored_facts(spark, d), "run_id")
    return m.select("run_id", F.array_join(F.array_sort(F.transform(F.map_entries("candidates"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|").alias("candidates"))


@query(
    "merged_verdicts",
    f"""WITH {_RANKED} SELECT run_id, field, CASE field WHEN 'title' THEN 'accepted' WHEN 'price' THEN 'rejected' WHEN 'currency' THEN 'edited' ELSE 'skipped' END AS verdict, CASE field WHEN 'currency' THEN 'XXX' ELSE value END AS value FROM r WHERE n = 1""",
)
def merged_verdicts(spark, d):
    """A person's decisions over all resolved facts: titles accepted, prices rejected, currencies edited, the rest left alone."""
    best = resolve.resolve(stored_facts(spark, d), "run_id", losers=False).select("run_id", "field", "value")
    said = F.when(F.col("field") == "title", "accepted").when(F.col("field") == "price", "rejected").otherwise("edited")
    decisions = best.filter(F.col("field").isin("title", "price", "currency")).select("run_id", "field", said.alias("verdict"), F.when(F.col("field") == "currency", "XXX").alias("edited_value"))
    return measures.verdicts(best, decisions, ["run_id", "field"]).select("run_id", "field", "verdict", "value")


_HOSTS = f"SELECT DISTINCT {_HOST} AS host FROM runs"


@query(
    "robots_check",
    f"""SELECT DISTINCT url, NOT (starts_with(h, 'docs.') AND regexp_matches(url, '^[a-z]+://[^/]*/en/')) AS allowed, CASE WHEN starts_with(h, 'docs.') THEN CAST(4 AS DOUBLE) END AS crawl_delay, CASE WHEN starts_with(h, 'docs.') THEN 'https://' || h || '/s.xml' ELSE '' END AS sitemaps FROM (SELECT url, {_HOST} AS h FROM runs WHERE url IS NOT NULL)""",
)
def robots_check(spark, d):
    """Rules of the documentation hosts are fresh, those of the shops too old to count, other hosts have none."""
    runs = table(spark, d, "runs").filter("url IS NOT NULL").select("url").distinct()
    hosts = runs.select(web.host(F.col("url")).alias("host")).distinct().filter(F.col("host").startswith("docs.") | F.col("host").startswith("shop."))
    text = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nCrawl-delay: 4\nSitemap: https://"), "host", F.lit("/s.xml\n"))
    rules = hosts.select("host", text.alias("text"), F.when(F.col("host").startswith("docs."), "2024-01-01 11:30:00").otherwise("2024-01-01 08:00:00").alias("fetched_at"))
    r = acquire.robots(runs.withColumn("now", F.lit("2024-01-01 12:00:00")), rules, "ours/1", at="now")
    return r.select("url", "allowed", "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps"))


@query(
    "crawl_schedule",
    f"""SELECT url, CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) + 3 * (row_number() OVER (PARTITION BY {_HOST} ORDER BY url) - 1) AS at FROM (SELECT DISTINCT url FROM runs WHERE url IS NOT NULL)""",
)
def crawl_schedule(spark, d):
    """When each address is asked for: one after the other per host, three seconds apart."""
    u = table(spark, d, "runs").filter("url IS NOT NULL").select("url").distinct().withColumn("crawl_delay", F.lit(3.0))
    return acquire.planned(u, "2024-01-01 00:00:00").select("url", F.unix_timestamp("scheduled_at").alias("at"))


def _answer(url: str) -> dict:
    """A web in which what lies under /en/ leads into a private network."""
    if "/en/" in url:
        return {"status": 302, "headers": {"Location": "http://10.0.0.1/inner"}}
    return {"status": 200, "headers": {"Content-Type": "text/html; charset=utf-8"}, "body": url.encode(), "ttfb_ms": 1.0}


def _nowhere(host: str) -> list[str]:
    return []


@query(
    "fetched_pages",
    f"""SELECT url, CASE WHEN verdict <> 'ok' THEN url WHEN contains(url, '/en/') THEN 'http://10.0.0.1/inner' ELSE url END AS final_url, CASE WHEN verdict <> 'ok' THEN 'PolicyError: ' || verdict WHEN contains(url, '/en/') THEN 'PolicyError: private_ip' END AS error,
 CASE WHEN verdict = 'ok' AND NOT contains(url, '/en/') THEN url END AS text FROM ({SQL['url_policy']})""",
)
def fetched_pages(spark, d):
    """Pages of all addresses, with the policy on every hop, decoded."""
    p = acquire.fetch(fixtures.urls(spark, d).distinct(), _answer, resolve=_nowhere)
    return acquire.decoded(p).select("url", "final_url", "error", "text")


@query("changed_signatures", f"SELECT run_id, before AS previous_signature FROM (SELECT *, lag(content_signature) OVER (PARTITION BY normalized_url ORDER BY retrieved_at NULLS FIRST, run_id) AS before FROM {_R}) WHERE before IS NOT NULL AND before <> content_signature")
def changed_signatures(spark, d):
    return measures.recent_change(whole_runs(spark, d, "normalized_url", "content_signature", "retrieved_at"), "normalized_url", "content_signature", "retrieved_at").select("run_id", "previous_signature")


_TTL = 30 * 86400


@query(
    "cache_hits",
    f"""WITH r AS (SELECT DISTINCT run_id, normalized_url, schema_hash, status, retrieved_at, stored_at FROM runs WHERE retrieved_at IS NOT NULL AND stored_at IS NOT NULL)
 SELECT q.run_id, arg_max(c.run_id, (c.retrieved_at, c.run_id)) AS cached_run FROM r q LEFT JOIN r c ON c.normalized_url = q.normalized_url AND c.schema_hash = q.schema_hash AND c.status IN ('success', 'partial') AND c.retrieved_at <= q.stored_at
 AND floor(epoch(q.stored_at)) - floor(epoch(c.retrieved_at)) <= {_TTL} GROUP BY q.run_id""",
)
def cache_hits(spark, d):
    r = table(spark, d, "runs").select("run_id", "normalized_url", "schema_hash", "status", "retrieved_at", "stored_at").distinct().filter("retrieved_at IS NOT NULL AND stored_at IS NOT NULL")
    q = r.select(F.col("run_id").alias("asked"), "normalized_url", "schema_hash", F.col("stored_at").alias("requested_at"))
    return store.cached(q, r, ["normalized_url", "schema_hash"], ttl_s=_TTL).select(F.col("asked").alias("run_id"), "cached_run")


@query("cache_keys", f"SELECT run_id, concat_ws('|', normalized_url, schema_hash, content_signature) AS key FROM (SELECT DISTINCT run_id, normalized_url, schema_hash, content_signature FROM runs)")
def cache_keys(spark, d):
    r = whole_runs(spark, d, "normalized_url", "schema_hash", "content_signature")
    return r.select("run_id", store.cache_key(F.col("normalized_url"), F.col("schema_hash"), F.col("content_signature")).alias("key"))


@query(
    "evidence_digests",
    """WITH f AS (SELECT DISTINCT run_id, fact_id, field, coalesce(value, 'None') AS value, list_min(evidence_ids) AS e FROM facts), x AS (SELECT run_id, evidence_id, min({'b': extraction_backend, 's': selector, 'h': content_hash}) AS m FROM evidence GROUP BY ALL)
 SELECT f.run_id, 'sha256:' || sha256(CAST(to_json(list_sort(list([coalesce(field, ''), value, coalesce(m.b, ''), coalesce(m.s, ''), coalesce(m.h, '')]))) AS VARCHAR)) AS evidence_digest FROM f LEFT JOIN x ON x.evidence_id = f.e AND x.run_id = f.run_id GROUP BY f.run_id""",
)
def evidence_digests(spark, d):
    return chain.evidence_digest(table(spark, d, "facts"), table(spark, d, "evidence"))


_LINKED = ["run_id", "url", "level", "status", "evidence_digest"]


@query(
    "chain_verify",
    """WITH r AS (SELECT DISTINCT run_id, normalized_url, level, status, schema_hash, stored_at FROM runs WHERE run_id IN (SELECT run_id FROM facts)), n AS (SELECT *, row_number() OVER (PARTITION BY schema_hash ORDER BY strftime(stored_at, '%Y%m%d%H%M%S%f'), run_id) AS i FROM r)
 SELECT schema_hash, bool_and(schema_hash <> 'sc_docs' OR coalesce(level, '') <> 'L2') AS ok, CAST(coalesce(min(i) FILTER (WHERE schema_hash = 'sc_docs' AND level = 'L2') - 1, count(*)) AS BIGINT) AS verified, CASE WHEN NOT bool_and(schema_hash <> 'sc_docs' OR coalesce(level, '') <> 'L2') THEN 'hash mismatch' END AS error FROM n GROUP BY schema_hash""",
)
def chain_verify(spark, d):
    """A chain per schema over all runs, appended and verified, with one entry altered in the second."""
    r = table(spark, d, "runs").select("run_id", F.col("normalized_url").alias("url"), "level", "status", "schema_hash", "stored_at").distinct()
    r = r.join(chain.evidence_digest(table(spark, d, "facts"), table(spark, d, "evidence")), "run_id").withColumn("seq", F.concat_ws("|", F.date_format("stored_at", "yyyyMMddHHmmssSSSSSS"), "run_id"))
    c = chain.append(r, "schema_hash", "seq", _LINKED)
    return chain.verify(c.withColumn("level", F.when((F.col("schema_hash") == "sc_docs") & (F.col("level") == "L2"), "L1").otherwise(F.col("level"))), "schema_hash", "seq", _LINKED)


# -- extraction ------------------------------------------------------------------------------------------------------


@query(
    "structured_facts",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_name, p_brand, {fixtures.PRICE} AS price FROM part)
 SELECT page_id, field, value, method FROM (
 SELECT page_id, unnest(['title', 'name', 'brand', 'price', 'currency', 'availability']) AS field, unnest([p_name, p_name, p_brand, price, 'EUR', 'https://schema.org/InStock']) AS value, 'json-ld' AS method FROM p WHERE page_id % 3 <> 0
 UNION ALL SELECT page_id, unnest(['title', 'name', 'price']), unnest([p_name, p_name, price]), 'microdata' FROM p WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, 'title', p_name, 'og_manual' FROM p WHERE page_id % 3 = 0 AND page_id % 2 <> 0 UNION ALL SELECT page_id, 'price', price, 'og_manual' FROM p WHERE page_id % 3 = 0 AND page_id % 2 <> 0 UNION ALL SELECT page_id, 'currency', 'EUR', 'og_manual' FROM p WHERE page_id % 3 = 0)""",
)
def structured_facts(spark, d):
    return extract.candidates(fixtures.product_pages(spark, d), PRODUCT_SCHEMA).filter("stage = 0").select("page_id", "field", "value", "method")


@query("meta_facts", f"SELECT p_partkey AS page_id, unnest(['title', 'name', 'source', 'price', 'currency']) AS field, unnest([p_name, p_name, 'Shop', {fixtures.PRICE}, 'EUR']) AS value FROM part")
def meta_facts(spark, d):
    return extract.candidates(fixtures.product_pages(spark, d), PRODUCT_SCHEMA).filter("method = 'meta_og'").select("page_id", "field", "value")


_LEAD = "'A part of size ' || CAST(p_size AS VARCHAR) || ' for everyday use, made by ' || p_brand || ', that fits where other parts of its type do not.'"

_AT = """'json-ld:$[0]' || CASE WHEN p_partkey % 5 = 0 THEN '["@graph"][1]' ELSE '' END"""
_OFFER = """'["offers"]' || CASE WHEN p_partkey % 7 = 0 THEN '[0]' ELSE '' END"""


def _rows(stage: int, method: str, confidence: float, backend: str, rows: list[tuple[str, str, str]], when: str = "true") -> str:
    """Candidates (field, value, selector) of one extractor, as SQL over the parts."""
    pick = lambda i: ", ".join(r[i] for r in rows)
    return f"SELECT p_partkey AS page_id, {stage} AS stage, '{method}' AS method, unnest([{pick(0)}]) AS field, unnest([{pick(1)}]) AS value, CAST({confidence} AS DOUBLE) AS confidence, unnest([{pick(2)}]) AS selector, '{backend}' AS backend FROM p WHERE {when}"


_NUMBER = "CAST(CAST(price AS DOUBLE) AS VARCHAR)"
_CANDIDATES = " UNION ALL ".join(
    [
        _rows(0, "json-ld", 0.96, "L1_structured", [(f"'{f}'", v, f"{_AT} || {w}") for f, v, w in (("title", "p_name", """'["name"]'"""), ("name", "p_name", """'["name"]'"""), ("price", "price", f"""{_OFFER} || '["price"]'"""), ("currency", "'EUR'", f"""{_OFFER} || '["priceCurrency"]'"""), ("availability", "'https://schema.org/InStock'", f"""{_OFFER} || '["availability"]'"""), ("brand", "p_brand", """'["brand"]["name"]'"""))], "p_partkey % 3 <> 0"),
        _rows(0, "microdata", 0.91, "L1_structured", [(f"'{f}'", v, f"""'microdata:$[0]["{w}"]'""") for f, v, w in (("title", "p_name", "name"), ("name", "p_name", "name"), ("price", "price", "price"))], "p_partkey % 2 = 0"),
        _rows(0, "og_manual", 0.88, "L1_structured", [("'title'", "p_name", "'og_manual:og:title'"), ("'price'", "price", "'og_manual:product:price:amount'")], "p_partkey % 3 = 0 AND p_partkey % 2 <> 0"),
        _rows(0, "og_manual", 0.88, "L1_structured", [("'currency'", "'EUR'", "'og_manual:product:price:currency'")], "p_partkey % 3 = 0"),
        _rows(3, "meta_og", 0.93, "L1_meta", [(f"'{f}'", v, f"""'meta[property="{w}"]'""") for f, v, w in (("title", "p_name", "og:title"), ("name", "p_name", "og:title"), ("source", "'Shop'", "og:site_name"), ("price", "price", "product:price:amount"), ("currency", "'EUR'", "product:price:currency"))]),
        _rows(4, "main_text", 0.90, "L1_text", [("'title'", "p_name", "'main::title'"), ("'main_text'", _LEAD, "'main::main_text'")]),
        _rows(6, "css_selector", 0.85, "L1_css", [("'name'", "p_name", "'h1'"), *[(f"'{f}'", v, f"""'meta[property="{w}"]'""") for f, v, w in (("title", "p_name", "og:title"), ("price", _NUMBER, "product:price:amount"), ("currency", "'EUR'", "product:price:currency"), ("source", "'Shop'", "og:site_name"))]]),
        _rows(7, "microdata", 0.87, "L1_microdata", [("'name'", "p_name", """'[itemprop="name"]'"""), ("'price'", "price", """'[itemprop="price"]'""")], "p_partkey % 2 = 0"),
        _rows(10, "price_regex", 0.75, "L1_price_regex", [("'price'", _NUMBER, "'price_regex:near_price_class'")], "p_partkey % 2 = 0"),
        _rows(10, "price_regex", 0.5, "L1_price_regex", [("'price'", _NUMBER, "'price_regex:body_context'")], "p_partkey % 2 <> 0"),
        _rows(12, "url_derived", 0.65, "L1_domain", [("'currency'", "'USD'", "'domain_heuristic::currency'")]),
    ]
)


@query("candidate_facts", f"WITH p AS (SELECT *, {fixtures.PRICE} AS price FROM part) {_CANDIDATES}")
def candidate_facts(spark, d):
    """Candidates of every extractor for the product pages."""
    return extract.candidates(fixtures.product_pages(spark, d), PRODUCT_SCHEMA).select("page_id", "stage", "method", "field", "value", "confidence", "selector", "backend")


@query("page_candidates")
def page_candidates(spark, d):
    """Candidates of every extractor for the stored pages."""
    schema = {"fields": {"title": "string", "description": "string", "source": "string", "category": "string", "version": {"type": "string", "optional": True}}}
    return extract.candidates(pages(spark, d), schema).select("page_id", "page_class", "tactic", "stage", "method", "field", "value", "confidence", "selector")


@query(
    "state_facts",
    """SELECT s_suppkey AS page_id, field, value, selector FROM (SELECT s_suppkey, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['name', 'price'] WHEN 1 THEN ['title', 'brand'] WHEN 2 THEN ['name', 'price'] ELSE ['name', 'availability'] END) AS field,
 unnest(CASE s_suppkey % 4 WHEN 0 THEN [s_name, '12.5'] WHEN 1 THEN [s_name, 'Acme'] WHEN 2 THEN [s_name, '990.0'] ELSE [s_name, 'false'] END) AS value,
 unnest(CASE s_suppkey % 4 WHEN 0 THEN ['state:productName', 'state:currentPrice'] WHEN 1 THEN ['state:fullTitle', 'state:brand'] WHEN 2 THEN ['state:name', 'state:price'] ELSE ['state:name', 'state:availability'] END) AS selector FROM supplier)""",
)
def state_facts(spark, d):
    """Facts from embedded state."""
    return extract.candidates(fixtures.state_pages(spark, d), PRODUCT_SCHEMA).filter("stage = 2").select("page_id", "field", "value", "selector")


def _model(prompt: str) -> str:
    """A text model that knows the article number of a page alone."""
    n = prompt.partition("/product/")[2].partition('"')[0]
    return f'It is this: ```json\n{{"sku": "S-{n}", "name": "no", "brand": null}}\n``` I hope it helps.'


@query(
    "filled_facts",
    """SELECT p_partkey AS page_id, field, value, method, backend, validation_status, CASE WHEN p_partkey % 3 = 0 THEN 'L3' ELSE 'L2' END AS level FROM (SELECT p_partkey, 'sku' AS field, 'S-' || CAST(p_partkey AS VARCHAR) AS value, 'llm_fill' AS method, 'L2' AS backend, 'unverified' AS validation_status FROM part
 UNION ALL SELECT p_partkey, 'brand', CASE WHEN p_partkey % 3 = 0 THEN 'Made by ' || p_brand ELSE p_brand END, CASE WHEN p_partkey % 3 = 0 THEN 'L3_og_manual' ELSE 'json-ld' END, 'L1_structured', 'valid' FROM part)""",
)
def filled_facts(spark, d):
    """What the later levels add: the model the missing article number, the rendered page the missing brand."""
    p = fixtures.product_pages(spark, d)
    brand = p.join(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), "p_brand"), "page_id")
    shown = brand.select("page_id", "url", F.replace("html", F.lit("<head>"), F.concat(F.lit('<head><meta property="product:brand" content="Made by '), "p_brand", F.lit('">'))).alias("html"))
    t = engine.extract(p, {"name": "string", "brand": "string", "sku": "string"}, ask=_model, rendered=shown)
    f = t.facts.filter(F.col("field").isin("sku", "brand")).join(t.runs.select("page_id", "level"), "page_id")
    return f.select("page_id", "field", "value", "method", "backend", "validation_status", "level")


@query(
    "extracted_facts",
    f"""WITH p AS (SELECT *, {fixtures.PRICE} AS price, CASE WHEN p_partkey % 3 <> 0 THEN 'json-ld' WHEN p_partkey % 2 = 0 THEN 'microdata' END AS m FROM part)
 SELECT page_id, field, value, method, validation_status FROM (SELECT p_partkey AS page_id, unnest(['title', 'name', 'price', 'currency', 'source', 'main_text', 'availability', 'brand']) AS field, unnest([p_name, p_name, price, 'EUR', 'Shop', {_LEAD}, 'true', CASE WHEN p_partkey % 3 <> 0 THEN p_brand END]) AS value,
 unnest([coalesce(m, 'og_manual'), coalesce(m, 'meta_og'), coalesce(m, 'og_manual'), CASE WHEN p_partkey % 3 <> 0 THEN 'json-ld' ELSE 'og_manual' END, 'meta_og', 'main_text', CASE WHEN p_partkey % 3 <> 0 THEN 'json-ld' ELSE 'url_derived' END, 'json-ld']) AS method, 'valid' AS validation_status FROM p) WHERE value IS NOT NULL""",
)
def extracted_facts(spark, d):
    """All facts of the product pages, resolved, with what they came from."""
    f = engine.extract(fixtures.product_pages(spark, d), PRODUCT_SCHEMA).facts
    return f.select("page_id", "field", "value", "method", "validation_status")


@query(
    "extracted_runs",
    """SELECT p_partkey AS page_id, 'partial' AS status, 'product' AS tactic, 'L1' AS level, CASE WHEN p_partkey % 3 = 0 THEN 'brand,category' ELSE 'category' END AS missing, CAST(CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 8 END AS BIGINT) AS n_facts, 'tactic:product:browser_hint' AS reason,
 array_to_string(list_filter([CASE WHEN p_partkey % 3 <> 0 THEN 'jsonld_detected' END, 'spa_score:0.0', 'canonical:https://shop.example.com/product/' || CAST(p_partkey AS VARCHAR), 'page_class:product', 'tactic:product',
  'missing_fields: ' || CASE WHEN p_partkey % 3 = 0 THEN 'brand, category' ELSE 'category' END, 'route:L1_http:tactic:product:browser_hint'], lambda x: x IS NOT NULL), '|') AS warnings FROM part""",
)
def extracted_runs(spark, d):
    r = engine.extract(fixtures.product_pages(spark, d), PRODUCT_SCHEMA).runs
    return r.select("page_id", "status", "tactic", "level", F.array_join("missing", ",").alias("missing"), "n_facts", F.col("route.reason").alias("reason"), F.array_join("warnings", "|").alias("warnings"))


@query(
    "page_snapshots",
    f"""SELECT p_partkey AS page_id, p_name || ' | Shop' AS title, 'en' AS language, '/product/' || CAST(p_partkey AS VARCHAR) AS canonical, 'main: ' || p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || ' x ' ELSE '' END || {_LEAD} AS sections,
 'og:site_name=Shop,og:title=' || p_name || ',product:price:amount=' || {fixtures.PRICE} || ',product:price:currency=EUR' AS meta, 0 AS links FROM part""",
)
def page_snapshots(spark, d):
    s = extract.snapshots(fixtures.product_pages(spark, d))
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return s.select("page_id", "title", "language", "canonical", F.array_join(F.transform("sections", lambda x: F.concat_ws(": ", x["tag"], x["text"])), "|").alias("sections"), meta.alias("meta"), F.size("links").alias("links"))


@query("canonical_links", "SELECT p_partkey AS page_id, 'https://shop.example.com/product/' || CAST(p_partkey AS VARCHAR) AS canonical FROM part")
def canonical_links(spark, d):
    return extract.primary_canonical(extract.links(fixtures.product_pages(spark, d)))


@query(
    "text_pages_snapshots",
    f"""SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1), '') AS language, len(regexp_extract_all(html, '(?i)<(?:header|main|article|section|aside|footer)[\\s>]')) AS sections, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="http')) AS links,
 len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<meta[^>]*?(?:name|property)="([^"]+)"', 1), lambda x: x <> ''))) AS metas FROM {_DOC}""",
)
def text_pages_snapshots(spark, d):
    """Sections, links and meta of the stored pages."""
    s = extract.snapshots(pages(spark, d))
    return s.select("page_id", "language", F.size("sections").alias("sections"), F.size("links").alias("links"), F.size("meta").alias("metas"))


# -- streams ---------------------------------------------------------------------------------------------------------


@query(
    "stream_telemetry",
    "SELECT date_trunc('hour', retrieved_at) AS start, level, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed FROM runs WHERE retrieved_at IS NOT NULL GROUP BY 1, 2",
)
def stream_telemetry(spark, d):
    """The hourly telemetry of a stream that has read the whole table."""
    schema = table(spark, d, "runs").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/runs.parquet" if _is_folder(spark, f"{d}/runs.parquet") else _alone(d))
    folder = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    return streams.materialised(streams.telemetry(rows.filter("retrieved_at IS NOT NULL"), late="3650 days"), ["start", "level"], folder).select("start", "level", "runs", "failed")


@query("stream_first_seen", "SELECT DISTINCT normalized_url, content_signature FROM runs WHERE retrieved_at IS NOT NULL")
def stream_first_seen(spark, d):
    """Each address and content once, from a stream that has read the whole table."""
    schema = table(spark, d, "runs").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/runs.parquet" if _is_folder(spark, f"{d}/runs.parquet") else _alone(d))
    folder = f"{shared_folder(spark)}/first-{uuid.uuid4().hex}"
    seen = streams.first_seen(rows.filter("retrieved_at IS NOT NULL"), ["normalized_url", "content_signature"], late="3650 days").select("normalized_url", "content_signature")
    streams.append_to(seen, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{folder}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _alone(d: str) -> str:
    """A glob that names the runs file alone: streams read folders or globs."""
    return f"{d}/runs.parque[t]"
