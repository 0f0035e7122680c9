import json
from collections import Counter

from pyspark.sql import Row, functions as F

from factloom import engine
from factloom.functions import signature as sg, text as tx, web
from factloom.operators import chain, extract, measures, resolve, structured as st
from factloom.operators.dom import Tree
from factloom.sources import acquire, store

ARTICLE = """<html lang="en"><head><title>How rivers carve the plain | Site</title><meta property="og:title" content="How rivers carve the plain">
<meta name="author" content="A. Writer"><script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Site"}, {"@type": "NewsArticle", "headline": "How rivers carve the plain", "datePublished": "2024-05-01"}]}</script></head>
<body><article><h1>How rivers carve the plain</h1><time datetime="2024-05-01">May</time><p>First paragraph of the story.<p>Second one.</article></body></html>"""


def test_dom_is_forgiving():
    t = Tree("<div class='a b'><p>one<p>two<ul><li>x<li id=k data-q='1 2'>y</ul><br><img src=z></div><b>open")
    assert [n.text() for n in t.select("p")] == ["one", "two"]
    assert [n.text() for n in t.select("div.a > ul li")] == ["x", "y"]
    assert t.first("#k").attrs["data-q"] == "1 2" and t.first("[data-q*='2']").text() == "y" and t.first("li, b").text() == "x"
    assert t.select("div > li") == [] and t.first("img").value() == "z" and Tree("").nodes == []


def test_structured_and_state():
    a = st.structured(Tree(ARTICLE))
    assert {(x["field"], x["value"]) for x in a if x["syntax"] == "json-ld"} == {("title", "How rivers carve the plain"), ("publish_date", "2024-05-01"), ("date", "2024-05-01")}
    assert a[0]["locator"] == 'json-ld:$[0]["@graph"][1]["headline"]'
    page = '<script id="__NEXT_DATA__" type="application/json">{"props": {"product": {"productName": "Green lamp", "currentPrice": 12.5, "title": "x"}}}</script>'
    assert {(x["field"], x["value"]) for x in st.embedded(page)} == {("name", "Green lamp"), ("price", "12.5")}
    offers = {"@type": "Product", "offers": [{"price": "1"}, {"price": "2"}], "brand": {"name": "B"}}
    assert [(x["field"], x["value"], x["locator"]) for x in st.assertions(offers, "json-ld", 0)][:2] == [("price", "1", 'json-ld:$[0]["offers"][0]["price"]'), ("price", "2", 'json-ld:$[0]["offers"][1]["price"]')]


def test_links():
    h = '<https://a.example/x,y>; rel="next"; title="a, \\"b\\"", </p>; rel=canonical, <>; rel=x, <q>; type="t"'
    got = st.header_links(h, "https://h.example/d/")
    assert [(x["url"], x["rel"]) for x in got] == [("https://a.example/x,y", ["next"]), ("https://h.example/p", ["canonical"])]
    assert st.html_links(Tree("<link rel='Canonical alternate' href='/c'><a href>none</a>"), "https://h.example")[0]["rel"] == ["canonical", "alternate"]


def test_addresses_that_are_none(spark):
    assert st.html_links(Tree("<link rel=next href='http://[x'>"), "http://[y")[0]["url"] == "http://[x" and st.header_links("<http://[x>; rel=next", "https://h.example/")[0]["url"] == "http://[x"
    pages = spark.createDataFrame([(1, "http://[x", "<link rel=canonical href='http://[y'><h1>A longer title here</h1>"), (2, "", ""), (3, None, None)], "page_id long, url string, html string")
    assert engine.extract(pages, {"title": "string"}).runs.count() == 3 and extract.links(pages).count() == 1 and extract.snapshots(pages).count() == 3
    bad = [r.error for r in acquire.fetch(pages.select("url"), lambda u: 1 / 0, resolve=lambda h: []).collect()]
    assert bad == ["PolicyError: unsupported"] * 3


def test_extract_article(spark):
    pages = spark.createDataFrame([(1, "https://www.h.example/en/news/rivers", ARTICLE), (2, "https://h.example/", None), (3, "https://h.example/", "<title>Just a moment</title>")], "page_id long, url string, html string")
    t = engine.extract(pages, {"fields": {"title": "string", "author": "string", "publish_date": "string", "category": {"type": "string", "optional": True}, "price": "number"}})
    f = {(r.page_id, r.field): r for r in t.facts.collect()}
    assert f[1, "title"].value == "How rivers carve the plain" and f[1, "author"].value == "A. Writer" and f[1, "publish_date"].value == "2024-05-01"
    runs = {r.page_id: r for r in t.runs.collect()}
    assert runs[1].page_class == "article" and runs[1].status == "partial" and "price" in runs[1].missing and runs[3].status == "failed" and runs[3].route.reason == "bot_wall"
    assert t.evidence.count() == t.facts.count()


def test_fill_levels(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", "<h1>A longer page title</h1>")], "page_id long, url string, html string")
    rendered = spark.createDataFrame([(1, "https://h.example/", "<h1>Other title</h1><meta property='product:price:amount' content='9.50'>")], "page_id long, url string, html string")
    t = engine.extract(pages, {"title": "string", "brand": "string", "price": "number"}, ask=lambda _: '```json\n{"brand": "Acme", "title": "no", "bad": {}}\n```', rendered=rendered)
    f = {r.field: (r.value, r.method) for r in t.facts.collect()}
    assert f["title"][0] == "A longer page title" and f["brand"] == ("Acme", "llm_fill") and f["price"] == ("9.50", "L3_og_manual")
    assert t.runs.first().level == "L3"
    assert extract.json_object("x {\"a\": 1} y") == {"a": 1} and extract.json_object(None) == {} and extract.json_object("{broken") == {}


def test_rendered_pages_are_read_once_where_fields_are_missing(spark, tmp_path, monkeypatch):
    read, log = extract.page_candidates, tmp_path / "read"

    def noted(page, *rest):
        with log.open("a") as f:
            f.write(page + "\n")
        return read(page, *rest)

    monkeypatch.setattr(extract, "page_candidates", noted)
    whole, part = "<h1>A longer page title</h1><meta property='product:brand' content='Acme'>", "<h1>Another page title</h1>"
    sch = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "https://h.example/a", whole), (2, "https://h.example/b", part)], sch)
    rendered = spark.createDataFrame([(i, f"https://h.example/{u}", f"<p>{u}</p><meta property='product:brand' content='Other {u}'>") for i, u in ((1, "a"), (2, "b"))], sch)
    t = engine.extract(pages, {"title": "string", "brand": "string"}, rendered=rendered)
    assert {(r.page_id, r.value, r.method) for r in t.facts.filter("field = 'brand'").collect()} == {(1, "Acme", "og_manual"), (2, "Other b", "L3_og_manual")}
    assert {(r.page_id, r.level) for r in t.runs.collect()} == {(1, "L1"), (2, "L3")}
    assert Counter(log.read_text().splitlines()) == {whole: 1, part: 1, "<p>b</p><meta property='product:brand' content='Other b'>": 1}


def test_parts_by_page_give_the_same_facts(spark, monkeypatch):
    rows = [(i, f"https://h.example/product/{i}", f"<title>Shop</title><h1>Title of page number {i}</h1>" + (f"<meta property='product:brand' content='B{i}'>" if i % 2 else "")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rendered = spark.createDataFrame([(i, u, f"<meta property='product:brand' content='R{i}'>") for i, u, _ in rows], pages.schema)

    def facts():
        f = engine.extract(pages, {"name": "string", "brand": "string"}, rendered=rendered).facts
        return sorted(map(repr, f.drop("conflict_values").collect()))

    whole = facts()
    monkeypatch.setattr(engine, "PAGES_A_TASK", 4)
    assert engine._spread(pages).rdd.getNumPartitions() == 10 and facts() == whole and len(whole) >= 80


def test_batches_of_many_pages(spark):
    n = 2 * extract.AT_ONCE + 1
    pages = spark.range(n).coalesce(1).selectExpr("id AS page_id", "'https://h.example/' AS url", "IF(id % 3 = 0, NULL, concat('<h1>Title of page number ', id, '</h1>')) AS html")
    got = {(r.page_id, r.value) for r in extract.candidates(pages, {"title": "string"}).filter("method = 'css_selector'").collect()}
    assert got == {(i, f"Title of page number {i}") for i in range(n) if i % 3}
    assert extract.candidates(pages.limit(0), {"title": "string"}).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.56",), ("1.234,56",), ("99",), ("1 234",), ("129900",), (None,), ("",), ("EUR 12,5",)], "v string")
    got = {r.v: (r.p, r.n) for r in df.select("v", tx.price_number(F.col("v")).alias("p"), tx.plain_number(F.col("v")).alias("n")).collect()}
    assert got["1,234.56"] == (1234.56, 1234.56) and got["1.234,56"] == (1234.56, 1234.56) and got["1 234"] == (1234.0, None) and got["EUR 12,5"] == (12.5, 12.5) and got[""] == (None, None) and got[None] == (None, None)
    df = spark.createDataFrame([("«Цена»",), ('"a  b"',), ("x",)], "v string")
    assert [r[0] for r in df.select(tx.clean_text(F.col("v"))).collect()] == ["Цена", "a b", "x"]


def test_rules(spark):
    sch = "kind string, value string, equals string, needles array<string>, allowed array<string>, lo double, hi double, n int, want boolean"
    rows = [("equals", " Ab ", "aB", None, None, None, None, None, True), ("contains", "a b c", None, ["A", "c"], None, None, None, None, True), ("in", "EUR", None, None, ["eur"], None, None, None, True), ("range", "5", None, None, None, 1.0, 4.0, None, False), ("min_len", "abc", None, None, None, None, None, 3, True), ("equals", None, "x", None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, sch)
    c = [F.col(x) for x in ("kind", "value", "equals", "needles", "allowed", "lo", "hi", "n")]
    assert all(r.got == r.want for r in df.withColumn("got", tx.rule_holds(*c)).collect())


def test_headers(spark):
    df = spark.createDataFrame([Row(h={"Server": "cloudflare", "Cache-Control": "max-age=600", "Set-Cookie": "ab_x=1, sid=2"}), Row(h={"Via": "1.1 CloudFront", "Age": "61"}), Row(h={"X-Powered-By": "Express"})], "h map<string,string>")
    got = [r[0] for r in df.select(web.header_profile(F.col("h"))).collect()]
    assert (got[0].cdn, got[0].static_hint, got[0].ab_cookies) == ("cloudflare", True, ["ab_x"]) and (got[1].cdn, got[1].age_s, got[1].static_hint) == ("cloudfront", 61, True) and got[2].framework == "express" and got[2].cdn is None


def test_policy(spark):
    df = spark.createDataFrame([("https://[::1]/",), ("http://[fe80::1]/",), ("http://[2001:db8::1]/",), (None,), ("http://256.1.1.1/",)], "url string")
    assert [r[0] for r in df.select(web.url_verdict(F.col("url"))).collect()] == ["blocked_host", "private_ip", "ok", "unsupported", "ok"]
    p = store.TrustedPolicy("1", ("*.docs.example", "a.example"), {"x": {}}, True)
    df = spark.createDataFrame([("https://docs.example/",), ("https://b.docs.example/",), ("https://a.example/",), ("https://c.a.example/",)], "url string")
    assert [r[0] for r in df.select(p.allowed(F.col("url"))).collect()] == [False, True, True, False]
    assert len(p.hash()) == 64 and store.TrustedPolicy.load("/nonexistent").version == "none" and store.hash_json({"b": 1, "a": 2}) == store.hash_json({"a": 2, "b": 1})


def test_fetch(spark):
    def get(url):
        if url.endswith("/a"):
            return {"status": 302, "headers": {"Location": "/b"}}
        if url.endswith("/loop"):
            return {"status": 301, "headers": {"location": "/loop"}}
        if url.endswith("/boom"):
            raise TimeoutError("slow")
        return {"status": 200, "headers": {"Content-Type": "text/html; charset=latin-1"}, "body": "é".encode("latin-1"), "ttfb_ms": 1.0}

    df = spark.createDataFrame([("https://h.example/a",), ("https://h.example/loop",), ("https://h.example/boom",), ("http://10.0.0.1/",)], "url string")
    got = {r.url: r for r in acquire.decoded(acquire.fetch(df, get)).collect()}
    assert got["https://h.example/a"].text == "é" and got["https://h.example/a"].final_url == "https://h.example/b"
    assert got["https://h.example/loop"].error == "TooManyRedirects" and got["https://h.example/boom"].error.startswith("TimeoutError") and "private_ip" in got["http://10.0.0.1/"].error


def test_robots(spark):
    text = "User-agent: *\nCrawl-delay: 5\nDisallow: /no\nSitemap: https://h.example/s.xml\n\nUser-agent: ours\nCrawl-delay: 2\nDisallow: /ours"
    assert acquire.crawl_delay(text, "ours/1.0") == 2 and acquire.crawl_delay(text, "else/1") == 5 and acquire.crawl_delay(None, "x") is None
    pages = spark.createDataFrame([("https://h.example/no/1",), ("https://h.example/ok",), ("https://other.example/no",)], "url string")
    got = {r.url: r for r in acquire.robots(pages, spark.createDataFrame([("h.example", text)], "host string, text string"), "else/1").collect()}
    assert not got["https://h.example/no/1"].allowed and got["https://h.example/ok"].sitemaps == ["https://h.example/s.xml"] and got["https://other.example/no"].allowed


def test_chain(spark):
    fields = ["run_id", "status"]
    df = spark.createDataFrame([("c", i, f"r{i}", "ok") for i in range(5)] + [("d", 0, "x", None)], "chain string, seq int, run_id string, status string")
    c = chain.append(df, "chain", "seq", fields).cache()
    ok = {r.chain: r for r in chain.verify(c, "chain", "seq", fields).collect()}
    assert ok["c"].ok and ok["c"].verified == 5 and ok["d"].ok
    edited = c.withColumn("status", F.when(F.col("seq") == 2, "bad").otherwise(F.col("status")))
    r = {x.chain: x for x in chain.verify(edited, "chain", "seq", fields).collect()}["c"]
    assert (r.ok, r.verified, r.error) == (False, 2, "hash mismatch")
    r = {x.chain: x for x in chain.verify(c.filter("seq <> 2 OR chain = 'd'"), "chain", "seq", fields).collect()}["c"]
    assert (r.ok, r.verified, r.error) == (False, 2, "broken link")
    e = {"run_id": "r0", "status": "ok", "prev_hash": chain.GENESIS}
    assert c.filter("chain = 'c' AND seq = 0").first().hash == chain.entry_hash(e)


def test_report_numbers(spark):
    runs = spark.createDataFrame([("a", "L1", "success", "[]"), ("b", "L1", "partial", '["l2_llm_fill"]'), ("c", "L3", "success", "[]"), ("d", "L1", "failed", "[]")], "run_id string, level string, status string, warnings string")
    facts = spark.createDataFrame([("a", "1", ["e"]), ("a", "2", []), ("b", "3", [])], "run_id string, fact_id string, evidence_ids array<string>")
    ev = spark.createDataFrame([("a", "e"), ("c", "z")], "run_id string, evidence_id string")
    r = measures.economics(runs, facts, ev).first()
    assert (r.total_runs, r.browser_avoidance_rate, r.llm_avoidance_rate, r.facts_total, r.facts_with_evidence, r.provenance_coverage) == (4, 0.75, 0.75, 3, 2, 0.667)
    assert measures.economics(runs.limit(0), facts.limit(0), ev.limit(0)).first().provenance_coverage == 0
    v = {x.run_id: (x.facts, x.valid) for x in measures.evidence_validity(facts, ev).collect()}
    assert v == {"a": (2, 1), "b": (1, 0)}


def test_verdicts_and_reason(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, value string")
    d = spark.createDataFrame([(1, "accepted", None), (2, "edited", "B")], "id int, verdict string, edited_value string")
    assert {r.id: (r.verdict, r.value) for r in measures.verdicts(c, d, ["id"]).collect()} == {1: ("accepted", "a"), 2: ("edited", "B"), 3: ("skipped", "c")}
    e = spark.createDataFrame([("ReadTimeout", ""), ("HTTPStatusError", "status 404"), ("ConnectError", "x"), ("PolicyError", "mime image/png"), ("PolicyError", "private_ip"), ("PolicyError", "robots"), ("PolicyError", "max_bytes"), ("OSError", "gone"), (None, None)], "e string, m string")
    want = ["no_html:timeout", "no_html:http_error", "no_html:timeout", "wrong_mime_type", "policy_blocked", "robots_disallowed", "no_html:too_large", "OSError: gone", None]
    assert [r[0] for r in e.select(resolve.failure_reason(F.col("e"), F.col("m"))).collect()] == want


def test_signature_markers(spark):
    shell = '<div id="__next"></div><script id="__NEXT_DATA__" type="application/json">{}</script>' + '<script src="/_next/static/chunk.js"></script>' * 3
    docs = "<h2>a</h2>" * 4 + "<pre>x</pre><code>y</code>"
    product = '<meta property="product:price:amount" content="3"><span itemprop="price">3</span>'
    wiki = '<script>var captcha = 1</script><table class="infobox">'
    df = spark.createDataFrame([(1, shell), (2, docs), (3, product), (4, wiki), (5, "Verify you are human"), (6, "")], "id int, html string")
    got = {r.id: r.s for r in df.select("id", sg.signature(F.col("html")).alias("s")).collect()}
    assert got[1].likely_spa and got[1].page_class == "spa" and got[1].spa_score >= 0.6 and got[2].page_class == "docs" and got[3].page_class == "product" and got[4].page_class == "reference" and not got[4].bot_wall and got[5].bot_wall and got[6].text_ratio == 1.0


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("k", 1, "x", "p")], "id string, at int, v string, w string")
    b = spark.createDataFrame([("k", 2, "y", "q"), ("l", 1, "z", "r")], "id string, at int, v string, w string")
    assert {(r.id, r.v, r.w) for r in store.upsert(a, b, ["id"], "at").collect()} == {("k", "y", "q"), ("l", "z", "r")}
    assert {(r.id, r.v, r.w) for r in store.upsert(a, b, ["id"], "at", ["v"]).collect()} == {("k", "y", "p"), ("l", "z", "r")}
    shots = extract.snapshots(spark.createDataFrame([(1, "https://h.example/", ARTICLE)], "page_id int, url string, html string"))
    store.save_snapshots(shots, str(tmp_path / "s"))
    h = shots.first().hash
    assert store.load_snapshot(spark, str(tmp_path / "s"), h).first().title == "How rivers carve the plain | Site"
    store.write_report(shots.select("page_id"), str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("*.json")).read_text()) == {"page_id": 1}


def test_streams(spark, data, tmp_path):
    from factloom.streaming import streams

    src = tmp_path / "runs"
    runs = spark.read.parquet(f"{data}/runs.parquet").filter("retrieved_at IS NOT NULL")
    runs.write.parquet(str(src))
    s = streams.runs_stream(spark, str(src), runs.schema)
    q = streams.append_to(streams.first_seen(s, ["normalized_url"], late="3650 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == runs.select("normalized_url").distinct().count()
    s = streams.runs_stream(spark, str(src), runs.schema)
    q = streams.append_to(streams.cached_runs(s, ttl_s=10**9, late="3650 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o2"))
    keys = runs.select(F.concat_ws("|", "normalized_url", "schema_hash", "content_signature")).distinct().count()
    assert out.count() == runs.count() and out.filter("NOT hit").count() == keys
    seen = []
    streams.upsert_each(streams.runs_stream(spark, str(src), runs.schema), str(tmp_path / "c3"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == runs.count()


def test_product_links_and_hop(spark):
    shell = '<a href="/product/9">x</a><a href="../product/8">y</a><a href="//cdn.example/dp/3?x=1">z</a><a href="/about">w</a><meta property="product:price:currency" content="EUR"><span itemprop="price">'
    target = '<meta property="product:price:amount" content="7.50"><h1>Nine of them</h1>'
    pages = spark.createDataFrame([(1, "https://h.example/shop/a", shell), (2, "https://h.example/product/9", target)], "page_id long, url string, html string")
    got = pages.filter("page_id = 1").select(sg.product_links(F.col("html"), F.col("url"))).first()[0]
    assert got[0] == "https://h.example/product/9" and "https://cdn.example/dp/3?x=1" in got and got[1] == "https://h.example/product/8"
    schema = {"title": "string", "price": "number", "availability": "string"}
    plain = {(r.page_id, r.field): r.value for r in engine.extract(pages, schema).facts.collect()}
    assert (1, "price") not in plain and plain[2, "price"] == "7.50" and plain[2, "availability"] == "true"
    assert {(r.page_id, r.field): r.value for r in engine.extract(pages, schema, hop=True).facts.collect()}[1, "price"] == "7.50"


def test_price_scan():
    at = lambda h: extract.price_in(Tree(h), h)
    assert at('<span class="price">only $ 1,299.00</span>') == ("1299.0", "USD", 0.75, "price_regex:near_price_class")
    assert at("<p>Made in 2020. Buy from 49,90 EUR today</p>")[:3] == ("49.9", "EUR", 0.5) and at("<p>Room 12, price 7</p>") is None and at("") is None


def test_lead(spark):
    wiki = '<table class="infobox"><p>' + "A river is a natural stream of water that flows towards another body. " + "<p>x"
    pages = spark.createDataFrame([(1, "https://r.example/w/River", wiki)], "page_id long, url string, html string")
    f = {r.field: r for r in engine.extract(pages, {"description": "string"}).facts.collect()}
    assert f["description"].selector in ("lead:p", "p") and f["description"].value.startswith("A river is")


def test_fallbacks_and_cli(spark, tmp_path):
    from factloom.__main__ import main

    pages = spark.createDataFrame([(1, "https://www.h.example/", "<title>Just a moment</title>"), (2, "https://h.example/docs/", "<h1>A page about docs</h1>")], "page_id long, url string, html string")
    runs = engine.extract(pages, {"title": "string"}).runs
    store.record_fallbacks(runs, str(tmp_path / "f"))
    got = store.fallbacks(spark, str(tmp_path / "f")).collect()
    assert [(r.host, r.actual, r.reason) for r in got] == [("h.example", "L3_browser", "bot_wall")]
    pages.write.parquet(str(tmp_path / "p"))
    (tmp_path / "s.json").write_text('{"fields": {"title": "string"}}')
    assert main(["extract", str(tmp_path / "p"), str(tmp_path / "s.json"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == 2
    c = chain.append(pages.withColumn("chain_id", F.lit("a")), "chain_id", "page_id", ["url"])
    c.write.parquet(str(tmp_path / "c"))
    assert main(["verify", str(tmp_path / "c"), "url", "--seq", "page_id"]) == 0


def test_candidate_map(spark):
    f = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2), (1, "a", "z", 3)], "page_id int, field string, value string, seq int")
    assert resolve.candidate_map(f).first().candidates == {"a": "x", "b": "y"}


def test_every_hop_is_checked(spark):
    asked = []

    def get(url):
        hops = {"https://h.example/meta": "http://169.254.169.254/latest/", "https://h.example/v6": "http://[fd00::1]/", "https://h.example/mapped": "http://[::ffff:10.0.0.1]/", "https://h.example/name": "https://inner.example/x", "https://h.example/file": "file:///etc/passwd"}
        assert not url.startswith(("http://1", "http://[", "https://inner", "file:"))
        if url in hops:
            return {"status": 302, "headers": {"Location": hops[url]}}
        return {"status": 200, "headers": {"Content-Type": "image/png"}, "body": b"x"}

    urls = [f"https://h.example/{x}" for x in ("meta", "v6", "mapped", "name", "file", "png")]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    got = {r.url: r for r in acquire.fetch(df, get, resolve=lambda host: ["10.0.0.7"] if host == "inner.example" else []).collect()}
    want = dict(zip(urls, ["private_ip|blocked_host", "private_ip", "private_ip", "private_ip", "unsupported", "mime image/png"]))
    for u, w in want.items():
        assert got[u].body is None and got[u].error.removeprefix("PolicyError: ") in w.split("|"), got[u]
    assert got[None].error == "PolicyError: unsupported" and asked == []


def test_python_and_column_policy_agree(spark, data):
    from factloom.plans import fixtures

    def by_python(u):
        try:
            acquire.check_address(u, lambda host: [])
            return "ok"
        except acquire.Refused as e:
            return str(e)

    for r in fixtures.urls(spark, data).select("url", web.url_verdict(F.col("url")).alias("v")).distinct().collect():
        assert by_python(r.url) == r.v, r


def test_robots_groups(spark):
    text = "Crawl-delay: 9\nuser-agent: a\nUser-Agent: ourbot\nCrawl-Delay: 3 # slow\nDisallow: /x\n\nUser-agent: ourbot-news\nCrawl-delay: x\nUser-agent: *\nCrawl-delay: 7"
    assert [g.agents for g in acquire.groups(text)] == [("a", "ourbot"), ("ourbot-news",), ("*",)]
    assert acquire.crawl_delay(text, "OurBot/2") == 3 and acquire.crawl_delay(text, "ourbot-news/1") == 7 and acquire.crawl_delay(text, "zzz") == 7 and acquire.crawl_delay("User-agent: zzz", "zzz") is None
    pages = spark.createDataFrame([("https://h.example/no", "2024-01-01 02:00:00"), ("https://h.example/no", "2024-01-01 00:30:00")], "url string, now string")
    rules = spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /no", "2024-01-01 00:00:00"), ("h.example", "", "2023-01-01 00:00:00")], "host string, text string, fetched_at string")
    got = sorted((r.now, r.allowed) for r in acquire.robots(pages, rules, "x", at="now").collect())
    assert got == [("2024-01-01 00:30:00", False), ("2024-01-01 02:00:00", True)]  # rules that are too old do not count


def test_throttle_spreads_a_hot_host(spark):
    df = spark.createDataFrame([(f"https://h.example/{i:03}", 2.0) for i in range(50)] + [("https://o.example/", None)], "url string, crawl_delay double")
    got = {r.url: r.scheduled_at for r in acquire.planned(df, "2024-01-01 00:00:00").collect()}
    t0 = got["https://h.example/000"]
    assert (got["https://h.example/049"] - t0).total_seconds() == 98 and got["https://o.example/"] == t0


def test_chain_with_escapes_and_a_long_chain(spark):
    odd = ['a"b', "back\\slash", "line\nbreak", "tab\t", "\x01", "é", None]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(odd * 30)], "chain string, seq int, url string")
    c = chain.append(df, "chain", "seq", ["url"])
    r = chain.verify(c, "chain", "seq", ["url"]).first()
    assert (r.ok, r.verified, r.error) == (True, 210, None)
    cut = chain.verify(c.filter("seq <> 100"), "chain", "seq", ["url"]).first()
    assert (cut.ok, cut.verified, cut.error) == (False, 100, "broken link")


def test_digests_need_the_run(spark):
    f = spark.createDataFrame([("r", "f", "title", "x", ["e"]), ("s", "g", "title", "x", ["e"])], "run_id string, fact_id string, field string, value string, evidence_ids array<string>")
    e = spark.createDataFrame([("r", "e", "css", "h1", "1"), ("s", "e", "css", "h2", "2"), ("s", "e", "css", "h3", "0")], "run_id string, evidence_id string, extraction_backend string, selector string, content_hash string")
    d = {r.run_id: r.evidence_digest for r in chain.evidence_digest(f, e).collect()}
    alone = chain.evidence_digest(f.filter("run_id = 's'"), e.filter("selector = 'h2'")).first()
    assert d["r"] != d["s"] and d["s"] == alone.evidence_digest


def test_secondary_syntaxes_and_typed_pass():
    page = """<div vocab="https://schema.org/" typeof="Product"><b property="name">Lamp of brass</b><span property="offers" typeof="Offer"><i property="price" content="12.5">x</i></span></div>
    <article class="h-entry"><h1 class="p-name">A long walk along the river</h1><time class="dt-published" datetime="2024-03-04">x</time><a class="p-author h-card" href="/a"><b class="p-name">Ann</b></a></article>"""
    a = {(x["syntax"], x["field"], x["value"]) for x in st.structured(Tree(page))}
    assert {("rdfa", "name", "Lamp of brass"), ("rdfa", "price", "12.5"), ("microformat", "title", "A long walk along the river"), ("microformat", "publish_date", "2024-03-04"), ("microformat", "author", "Ann")} <= a
    assert st.secondary_wanted("<p class=x>", False) is False and st.secondary_wanted("<p TYPEOF=x>", False) and st.secondary_wanted("", True)
    ld = '<script type="application/ld+json">[{"@type": "Product", "headline": "A lamp for every room", "offers": [{"price": 3}], "brand": "B"}, {"@type": ["X", "WebPage"], "name": "Some page"}, {"@type": "Person", "name": "no"}]</script>'
    assert {(t["type"], t["field"], t["value"]) for t in st.typed(Tree(ld))} == {("Product", "title", "A lamp for every room"), ("Product", "brand", "B"), ("Product", "price", "3"), ("WebPage", "title", "Some page")}
    got = extract.page_candidates(ld, "product", ["json_ld"], False, extract.schema_fields({"title": "string", "price": "number"}))
    assert not [c for c in got if c["stage"] == 1 and c["field"] in ("title", "price")]  # claimed by the structured layer


def test_trees_of_any_shape():
    deep = {"a": 1}
    for _ in range(300):
        deep = {"mainEntity": deep}
    assert len(list(st.entities(deep))) == 301
    assert [p for _, p in st.entities({"@graph": [{"x": 1}, [{"y": 2}]]})] == [("@graph", 0), ("@graph", 1, 0)]
    assert st.follow({"a": [[{"b": 1}], {"b": [2, 3]}, 4]}, ["a", "b"]) == [(1, ("a", 0, 0, "b")), ([2, 3], ("a", 1, "b"))]
    wide = {"items": [{"k": i} for i in range(2000)], "name": "n"}
    assert list(st.flat(wide))[0] == ("name", "n") and len(list(st.flat(wide))) == 2001
    assert st.state_value("availability", "OutOfStock") == "false" and st.state_value("availability", True) == "true" and st.state_value("availability", "soon") is None and st.state_value("price", "$1,200") == "1200.0" and st.state_value("currency", "euros") is None
    shop = '<script>var meta = {"product": {"name": "Green lamp", "price": 990}}; var x</script><script>ShopifyAnalytics.lib.track("Viewed product", {"brand": "Acme"})</script>'
    assert {(x["field"], x["value"]) for x in st.embedded(shop)} == {("name", "Green lamp"), ("price", "990.0")}
    assert extract.json_object('so {not} this: {"a": {"b": "}"}} {"c": 1}') == {"a": {"b": "}"}}


def test_walls_keep_no_titles_and_ask_no_model(spark):
    asked = []
    pages = spark.createDataFrame([(1, "https://h.example/", "<title>Access denied</title><meta property='og:title' content='Access denied'><meta name='description' content='why'>")], "page_id long, url string, html string")
    t = engine.extract(pages, {"title": "string", "description": "string"}, ask=lambda _: 1 / 0)
    r = t.runs.first()
    assert {f.field for f in t.facts.collect()} == {"description"} and r.status == "failed" and r.failure_reason == "bot_wall" and "bot_wall_detected" in r.warnings and asked == []


def test_warnings_and_validation(spark):
    html = '<head><meta name="generator" content="Gatsby 5"><script src="https://www.googletagmanager.com/gtag/js"></script><script type="application/ld+json">{"@type": "Product", "name": "A lamp of green glass", "offers": {"price": "from ten"}}</script></head>'
    pages = spark.createDataFrame([(1, "https://h.example/product/1", html.replace("<head>", "<head><link rel='canonical' href='/p'>"), {"Server": "cloudflare", "ETag": "W1", "Age": "99"})], "page_id long, url string, html string, headers map<string,string>")
    t = engine.extract(pages, {"name": "string", "price": "number", "brand": "string", "sku": "string"})
    w = t.runs.first().warnings
    tags = [x.split(":")[0] for x in w]
    assert tags == ["likely_spa", "jsonld_detected", "generator", "cdn", "frameworks", "static_hint", "etag", "trackers", "spa_score", "canonical", "page_class", "tactic", "missing_fields", "route"], w
    f = {x.field: x for x in t.facts.collect()}
    assert f["price"].datatype == "string" and f["price"].validation_status == "valid" and f["name"].validation_status == "valid"
    assert t.runs.select(resolve.should_escalate(F.col("route"))).first()[0]


def test_local_numbers(spark):
    df = spark.createDataFrame([("1.234", "de-DE"), ("1.234", "en-US"), ("1,234", "fr_FR"), ("1,234", "en"), ("1 234,5", "ru"), ("12.345,6", "en"), ("1.234", None), ("x", "de"), (None, "de")], "v string, l string")
    assert [r[0] for r in df.select(tx.local_number(F.col("v"), F.col("l"))).collect()] == [1234.0, 1.234, 1.234, 1234.0, 1234.5, 12345.6, 1.234, None, None]
    assert [tx.is_weak_title(x) for x in ("Home", "", None, "A good long title here", "ipsum")] == [True, True, True, False, True]


def test_whole_pages_are_read(spark):
    head = "<html><head><style>" + ".a{}" * 300_000 + "</style>"
    page = head + '<meta name="generator" content="Hugo"><link rel="next" href="../n?q=1#f"><a href="/dp/1">x</a></head><body><article><time>x</time></article><p>captcha</p></body>'
    df = spark.createDataFrame([(page, "https://h.example/a/b/c")], "h string, u string")
    s, h, p = df.select(sg.signature(F.col("h")), sg.head_links(F.col("h"), F.col("u")), sg.product_links(F.col("h"), F.col("u"))).first()
    assert s.generator == "Hugo" and s.page_class == "article" and s.bot_wall and s.has_time and h.rel_next == "https://h.example/a/n?q=1#f" and p == ["https://h.example/dp/1"]


def test_class_precision(spark):
    rules = spark.createDataFrame([(f"i{i}", "title", "equals", "x", None, None, None) for i in range(4)], "item_id string, field string, kind string, equals string, lo double, hi double, min_len int").withColumn("contains", F.array(F.lit("x"))).withColumn("in_set", F.array(F.lit("x")))
    facts = spark.createDataFrame([("i0", "title", "x"), ("i1", "title", "y"), ("i2", "title", "x")], "item_id string, field string, value string")
    lat = spark.createDataFrame([("i0", "a", 5.0), ("i1", "a", 1.0), ("i2", "b", None), ("i3", "b", 7.0)], "item_id string, class string, latency_ms double")
    got = {r["class"]: r for r in measures.class_precision(rules, facts, lat, "class").collect()}
    assert (got["a"].precision, got["a"].p50_ms, got["b"].precision, got["b"].p95_ms) == (0.5, 5.0, 0.5, 7.0)


class Browser:
    def get(self, url):
        if "boom" in url:
            raise TimeoutError("slow")
        return ("http://10.0.0.1/" if "away" in url else url + "/final"), f"<h1>{url}</h1>"

    def close(self):
        raise RuntimeError("closing is not trusted")


def test_render_with_a_pool(spark):
    urls = [f"https://h.example/{x}" for x in ("a", "boom", "b", "away", "c")] + ["http://localhost/", None]
    got = {r.url: r for r in acquire.render(spark.createDataFrame([(u,) for u in urls], "url string"), Browser, pool=2, resolve=lambda h: []).collect()}
    assert got["https://h.example/a"].html == "<h1>https://h.example/a</h1>" and got["https://h.example/c"].final_url.endswith("/c/final")
    assert got["https://h.example/boom"].error == "TimeoutError: slow" and got["https://h.example/away"].error == "PolicyError: private_ip" and got["https://h.example/away"].html is None
    assert got["http://localhost/"].error == "PolicyError: blocked_host" and got[None].error == "PolicyError: unsupported"


def test_tables_of_the_store(spark, tmp_path):
    folder = f"file://{tmp_path}"
    store.create(spark, folder)
    runs = spark.read.parquet(f"{folder}/runs.parquet")
    assert runs.count() == 0 and "payload" in runs.columns
    store.save(spark.range(100).selectExpr("cast(id % 10 as string) AS k", "id"), f"{folder}/t", key=["k", "id"])
    t = spark.read.parquet(f"{folder}/t")
    now = store.frozen(t)
    store.save(spark.range(5).selectExpr("'x' AS k", "id"), f"{folder}/t")
    assert now.count() == 100 and spark.read.parquet(f"{folder}/t").count() == 105 and now.filter("k = '3'").count() == 10


def test_main_article_without_its_element():
    page = '<head><meta name="author" content="Ann"><meta property="article:published_time" content="2024-02-03"></head><div><p><a>Menu of many many words</a></p></div><div><h1>Title here</h1><p>One long paragraph about the river and the mill.</p><p>Another one.</p></div>'
    got = extract.main_article(Tree(page))
    assert got["main_text"] == "One long paragraph about the river and the mill.\n\nAnother one." and (got["title"], got["author"], got["date"]) == ("Title here", "Ann", "2024-02-03")
    assert extract.main_article(Tree("<p></p>")) == {} and extract.main_article(Tree("")) == {}
    assert extract._typed("1.234", "number", "de-DE") == "1234.0" and extract._typed("1.234", "number", "en-US") == "1.234" and extract._typed("1.234", "number") == "1.234" and extract._typed("yes", "boolean") == "true"


def test_staged_tables_go_with_their_block(spark):
    from factloom.session import stage, staged_here

    with staged_here():
        df = stage(spark.range(3), "gone")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3
    import os

    assert not os.path.exists(path)
