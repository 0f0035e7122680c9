"""Derived inputs whose SQL text is the same for Spark and other engines: no locale formatting, whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.sources.tables import table

_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
PRICE = f"(CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({_CENTS} % 100 AS STRING), 2, '0'))"
#: Product pages from `part`: Open Graph on all, JSON-LD where the key is no multiple of three (in a graph behind an
#: organisation at every fifth key, offers as a list at every seventh), microdata on even keys.
PRODUCT_PAGES = f"""
SELECT p_partkey AS page_id, 'https://shop.example.com/product/' || CAST(p_partkey AS STRING) AS url,
  '<!doctype html><html lang="en"><head><title>' || p_name || ' | Shop</title><meta property="og:title" content="' || p_name || '"><meta property="og:site_name" content="Shop">'
  || '<meta property="product:price:amount" content="' || {PRICE} || '"><meta property="product:price:currency" content="EUR"><link rel="canonical" href="/product/' || CAST(p_partkey AS STRING) || '">'
  || CASE WHEN p_partkey % 3 <> 0 THEN '<script type="application/ld+json">' || CASE WHEN p_partkey % 5 = 0 THEN '{{"@graph": [{{"@type": "Organization", "name": "Shop"}}, ' ELSE '' END
    || '{{"@type": "Product", "name": "' || p_name || '", "brand": {{"name": "' || p_brand || '"}}, "offers": ' || CASE WHEN p_partkey % 7 = 0 THEN '[' ELSE '' END || '{{"price": "' || {PRICE} || '", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}}'
    || CASE WHEN p_partkey % 7 = 0 THEN ']' ELSE '' END || '}}' || CASE WHEN p_partkey % 5 = 0 THEN ']}}' ELSE '' END || '</script>' ELSE '' END
  || '</head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/t">' || p_type || '</a><a href="/b">' || p_brand || '</a></nav><main><h1>' || p_name || '</h1>'
  || CASE WHEN p_partkey % 2 = 0 THEN '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">' || p_name || '</span><span class="price" itemprop="price" content="' || {PRICE} || '">x</span></div>' ELSE '' END
  || '<p>A part of size ' || CAST(p_size AS STRING) || ' for everyday use, made by ' || p_brand || ', that fits where other parts of its type do not.</p></main></body></html>' AS html
FROM part
"""
#: Pages with heads of several habits, from `supplier`: attribute order, quotes and upper case vary, relative addresses too;
#: state blobs, scripts, frameworks, trackers and generators by turns; half of them have a head of more than 70,000 characters.
HEAD_PAGES = """
SELECT s_suppkey AS page_id, 'https://h.example/shop/page' AS url,
  '<!doctype html><html><head>' || CASE WHEN s_suppkey % 2 = 0 THEN '<style>' || repeat('.a{color:red}\n', 5000) || '</style>' ELSE '' END || '<title>' || s_name || '</title>'
  || CASE s_suppkey % 4 WHEN 0 THEN '<link rel="canonical" href="/c/1">' WHEN 1 THEN '<link href=' || chr(39) || 'https://h.example/c/2' || chr(39) || ' rel=' || chr(39) || 'Canonical' || chr(39) || '>' WHEN 2 THEN '<LINK HREF="../c/3" REL="canonical">' ELSE '<link rel="canonical">' END
  || CASE s_suppkey % 3 WHEN 0 THEN '<link rel="alternate" hreflang="de" href="/de"><link href="/fr" hreflang="fr" rel="alternate">' WHEN 1 THEN '<link rel="alternate" type="application/rss+xml" href="/feed"><link type="application/atom+xml" rel="alternate" href="https://h.example/atom">' ELSE '' END
  || CASE s_suppkey % 5 WHEN 0 THEN '<link rel="preload" href="/a.js"><link rel="preload" href="/b.js">' WHEN 1 THEN '<link rel="next" href="/p/3"><link rel="prev" href="/p/1">' WHEN 2 THEN '<meta name="theme-color" content="#fff">' WHEN 3 THEN '<meta name="generator" content="Gatsby 5">' ELSE '<!-- WordPress 6 -->' END
  || CASE s_suppkey % 7 WHEN 0 THEN '<script id="__NEXT_DATA__" type="application/json">{"a": 1}</script>' WHEN 1 THEN '<script src="/_nuxt/x.js"></script>' WHEN 2 THEN '<script src="/static/js/main.chunk.js"></script><script src="/static/js/1.chunk.js"></script><script src="https://www.googletagmanager.com/gtag/js"></script><script>a()</script><script>b()</script>' WHEN 3 THEN '<div class="infobox">x</div>' ELSE '' END
  || '</head><body>' || CASE s_suppkey % 6 WHEN 0 THEN '<article><time datetime="2024-01-01">d</time></article>' WHEN 1 THEN '<h2>a</h2><h2>b</h2><h2>c</h2><h2>d</h2><pre>x</pre><code>y</code>' WHEN 2 THEN '<div id="root"></div>' ELSE '<p>' || s_name || ' sells parts of many kinds and writes a few plain words about each of them.</p>' END || '</body></html>' AS html
FROM supplier
"""
#: Addresses for the fetch policy, with odd ones.
URLS = """
SELECT url FROM (VALUES ('http://localhost/a'), ('https://127.0.0.1/'), ('http://10.1.2.3/x'), ('http://172.16.0.9:8080/'), ('http://172.32.0.1/'), ('https://192.168.1.1/'), ('ftp://files.example.com/a'), ('http://printer.local/'),
 ('http://169.254.169.254/latest'), ('https://user:pw@example.com:8443/docs/a?b=1'), ('https://WWW.Example.COM/'), ('http:///nohost'), ('javascript:alert(1)'), ('http://8.8.8.8/'), ('http://[fd00::1]/'), ('http://[FE80::2]:80/'), ('http://[2001:db8::7]/v1/a'), ('http://[::1]/'), ('http://[0:0:0:0:0:0:0:1]/'), ('http://[::ffff:10.0.0.1]/x'), ('https://[::ffff:8.8.8.8]/docs/a'), ('https://sub.deep.example.com/v2/guide')) AS t(url)
UNION ALL SELECT DISTINCT url FROM runs
"""
#: Response headers by turns, from `supplier`, one column each; null where the header is absent.
HEADER_ROWS = """
SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'AmazonS3' WHEN 2 THEN 'nginx' WHEN 3 THEN 'AkamaiGHost' WHEN 4 THEN 'Fastly' WHEN 5 THEN 'Vercel' WHEN 6 THEN 'Netlify' ELSE 'Apache PHP/8' END AS server,
 CASE s_suppkey % 5 WHEN 0 THEN '1.1 x.CloudFront.net' WHEN 1 THEN '1.1 varnish fastly' END AS via, CASE s_suppkey % 6 WHEN 0 THEN 'max-age=299' WHEN 1 THEN 'max-age=300' WHEN 2 THEN 'no-cache, max-age=900' END AS cc, CASE s_suppkey % 7 WHEN 0 THEN '59' WHEN 1 THEN '60' WHEN 2 THEN 'x' END AS age,
 CASE s_suppkey % 11 WHEN 0 THEN 'HIT' WHEN 1 THEN 'MISS' END AS cfs, CASE s_suppkey % 13 WHEN 0 THEN 'Hit from cloudfront' END AS xcache, CASE s_suppkey % 9 WHEN 0 THEN 'ab_x=1, sid=2' WHEN 1 THEN 'experiment=7; Path=/, FLAG_b=1' END AS cookie,
 CASE s_suppkey % 10 WHEN 0 THEN 'Express' WHEN 1 THEN 'ASP.NET' WHEN 2 THEN 'Next.js' WHEN 3 THEN 'PHP/8.1' END AS powered, CASE s_suppkey % 4 WHEN 0 THEN 'W/1' END AS etag, CASE s_suppkey % 3 WHEN 0 THEN 'max-age=1' END AS hsts FROM supplier
"""
HEADER_NAMES = {"server": "Server", "via": "Via", "cc": "Cache-Control", "age": "Age", "cfs": "CF-Cache-Status", "xcache": "X-Cache", "cookie": "Set-Cookie", "powered": "X-Powered-By", "etag": "ETag", "hsts": "Strict-Transport-Security"}
#: Pages with embedded state of four kinds, from `supplier`.
STATE_PAGES = """
SELECT s_suppkey AS page_id, 'https://h.example/shop/' || CAST(s_suppkey AS STRING) AS url, '<html><body>' || CASE s_suppkey % 4
  WHEN 0 THEN '<script id="__NEXT_DATA__" type="application/json">{"props": {"product": {"productName": "' || s_name || '", "currentPrice": 12.5, "title": "x"}}}</script>'
  WHEN 1 THEN '<script>window.__NUXT__ = {"fullTitle": "' || s_name || '", "list": [{"brand": "Acme"}, 3]};</script>'
  WHEN 2 THEN '<script>var meta = {"product": {"name": "' || s_name || '", "price": 990, "currency": "euros"}}; var x = 1</script>'
  ELSE '<script type="application/json">{"a": {"name": "first of them"}, "b": {"name": "' || s_name || '", "availability": "https://schema.org/OutOfStock"}}</script>' END || '</body></html>' AS html FROM supplier
"""


def views(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    # narrow rows of a small file become whole pages: spread them before they grow
    table(spark, d, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey").createOrReplaceTempView("part")
    return spark.sql(PRODUCT_PAGES)


def head_pages(spark: SparkSession, d: str) -> DataFrame:
    return _by_view(spark, d, HEAD_PAGES, "supplier")


def state_pages(spark: SparkSession, d: str) -> DataFrame:
    return _by_view(spark, d, STATE_PAGES, "supplier")


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """(k, h): the headers as maps, with the spelling of names as servers send them."""
    one = lambda c, name: F.struct(F.lit(name).alias("key"), F.col(c).alias("value"))
    entries = F.array(*[one(c, name) for c, name in HEADER_NAMES.items()])
    return _by_view(spark, d, HEADER_ROWS, "supplier").select("k", F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("h"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    return _by_view(spark, d, URLS, "runs")


def _by_view(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    views(spark, d, *names)
    return spark.sql(sql)
