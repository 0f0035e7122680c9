import random
import re
import unicodedata
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import lookalike, mainbody, mixing, packing, percentiles, queries, repetition, residue, survivor, tokens
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        check(df, queries.SQL[name], data)
    else:
        assert df.columns and df.count() > 0


COLUMNS = {"p1_found": ["fact_id"], "p2_found": ["src", "rec_id", "line_no"], "p4_found": ["claim_id"], "p5_found": ["kind", "rec_id"], "p6_found": ["kind", "key_a", "key_b"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert queries.QUERIES[name](spark, data).columns == COLUMNS[name]


# -- 1 ---------------------------------------------------------------------------------------------------------------

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_best_facts(spark):
    rows = [
        ("u", "a", "cut…", 90, 0.9, T2), ("u", "b", "whole", 10, 0.1, T1),  # whole first
        ("v", "c", "x", None, 0.9, T1), ("v", "d", "y", 5, 0.1, T1),  # trust
        ("w", "f", "x", 5, 7.0, T2), ("w", "e", "y", 5, 0.0, None),  # confidence outside is lowest
        ("x", "g", "x", 5, None, T1), ("x", "h", "y", 5, -1.0, T2),  # later
        ("y", "j", "x", 5, 0.5, None), ("y", "i", "y", 5, 0.5, None), ("y", "i", "y", 5, 0.5, None),  # smaller id, repeated row
        ("z", "k", "x", 5, 0.5, T1), ("z", "k", "x", 5, 0.5, T1),  # one id only
        ("q", "l", "  ", 5, 0.5, T1), ("q", "m", None, 5, 0.5, T1),  # nothing usable
        (None, "n", "x", 5, 0.5, T1), (None, "o", "x", 5, 0.5, T1),
    ]
    df = spark.createDataFrame(rows, "g string, id string, value string, trust int, conf double, at timestamp").withColumn("_lo", F.lit(1))
    got = survivor.best_facts(df, ["g"], "id", "value", "trust", "conf", "at")
    assert {r.g: r.id for r in got.collect()} == {"u": "b", "v": "d", "w": "e", "x": "h", "y": "i"}
    assert survivor.best_facts(df.limit(0), ["g"], "id", "value", "trust", "conf", "at").collect() == []


def test_currency(spark):
    rows = [(f"p{i}", "avail", v, t) for i in range(4) for v, t in (("soon", T1), ("now", T2))]
    rows += [("q", "avail", "soon", None), ("q", "avail", "now", None)]  # learnt order decides
    rows += [("r", "avail", "soon", T2), ("r", "avail", "now", None)]  # an untimed value that comes after
    rows += [("s", "avail", "now", T2), ("s", "avail", "soon", None)]
    rows += [("t", "avail", "other", None), ("t", "avail", "else", None), ("t", "avail", "else", None)]
    rows += [("u", "avail", "only", None), ("u", "avail", " ", T2), (None, "avail", "x", T1)]
    df = spark.createDataFrame(rows, "page string, kind string, value string, at timestamp")
    got = {r.page: (r.value, r.basis) for r in survivor.latest_values(df, "page", "kind", "value", "at").collect()}
    assert got["p0"] == ("now", "timestamp") and got["q"] == ("now", "precedence") and got["r"] == ("now", "precedence") and got["s"][0] == "now"
    assert got["t"] == ("else", "unordered") and got["u"] == ("only", "only") and None not in got
    assert survivor.latest_values(df.limit(0), "page", "kind", "value", "at").collect() == []


MOVES = "earlier string, later string, n long"


def order_of(spark, moves, **kw):
    return {(r.a, r.b) for r in survivor.precedence(spark.createDataFrame(moves, MOVES), **kw).collect()}


def test_precedence_breaks_cycles_by_evidence(spark):
    # weakest edge of the cycle leaves, pairs seen both ways count by their difference
    assert order_of(spark, [("a", "b", 5), ("b", "c", 5), ("c", "a", 3), ("b", "a", 1)]) == {("a", "b"), ("b", "c")}
    # without a cycle nothing leaves, whatever the strengths
    assert order_of(spark, [("z", "a", 200), ("a", "b", 10), ("b", "c", 3), ("b", "d", 90)]) == {("z", "a"), ("a", "b"), ("b", "c"), ("b", "d")}
    assert order_of(spark, [("a", "b", 1), ("c", "c", 9), ("d", "e", 5), ("e", "d", 4)]) == set() and order_of(spark, []) == set()


def widest_back(edges, a, b):
    """Whether b leads back to a over edges at least as strong as a to b."""
    seen, todo = {b}, [b]
    while todo:
        x = todo.pop()
        for (u, v), n in edges.items():
            if u == x and n >= edges[a, b] and v not in seen:
                seen.add(v)
                todo.append(v)
    return a in seen


def test_precedence_against_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(3):
        edges = {}
        for _ in range(30):
            x, y = rnd.sample("abcdefgh", 2)
            if (y, x) not in edges:
                edges[x, y] = rnd.randint(2, 9)
        got = order_of(spark, [(x, y, n) for (x, y), n in edges.items()])
        assert got == {e for e in edges if not widest_back(edges, *e)}
        todo = set(got)
        while todo:  # no cycle: some edge's tail has nothing before it
            heads = {y for _, y in todo}
            free = {e for e in todo if e[0] not in heads}
            assert free
            todo -= free


def test_order_closes_over_absent_values(spark):
    rows = [(f"ab{i}", "k", v, t) for i in range(4) for v, t in (("A", T1), ("B", T2))] + [(f"bc{i}", "k", v, t) for i in range(4) for v, t in (("B", T1), ("C", T2))]
    rows += [(f"cd{i}", "k", v, t) for i in range(4) for v, t in (("C", T1), ("D", T2))]
    rows += [("x", "k", "A", None), ("x", "k", "A", None), ("x", "k", "C", None)]
    rows += [("y", "k", "A", None), ("y", "k", "D", T1)] + [("z", "k", "D", None), ("z", "k", "A", T2)]
    rows += [("o", "other", "A", None), ("o", "other", "A", None), ("o", "other", "C", None)]  # the order holds for its kind alone
    df = spark.createDataFrame(rows, "page string, kind string, value string, at timestamp")
    for pairs in (16, 1):  # asked in pairs, and walked per group
        got = {r.page: (r.value, r.basis) for r in survivor.latest_values(df, "page", "kind", "value", "at", pairs_up_to=pairs).collect()}
        assert got["y"][0] == "D" and got["x"] == ("C", "precedence") and got["z"] == ("D", "precedence") and got["o"] == ("A", "unordered")


def test_both_ways_of_asking_agree(spark):
    rnd = random.Random(9)
    days = [datetime(2024, 1, d) for d in range(1, 28)]
    rows = []
    for g in range(120):
        for v in sorted(rnd.sample(range(12), rnd.randint(1, 6)), key=lambda v: v + rnd.random() * 3):
            rows.append((f"g{g}", "k", f"v{v:02}", days[v] if rnd.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "page string, kind string, value string, at timestamp")
    a, b = (sorted(survivor.latest_values(df, "page", "kind", "value", "at", pairs_up_to=n).collect()) for n in (16, 1))
    assert a == b and {r.basis for r in a} >= {"only", "timestamp", "precedence"}


# -- 2 ---------------------------------------------------------------------------------------------------------------


def page(i, host):
    words = "the quiet river moves past the old mill and carries leaves".split()
    rnd = random.Random(i)
    prose = [" ".join(rnd.sample(words, 9)).capitalize() + f" {i}." for _ in range(4)]
    lines = ["<html>", "<head><title>x</title></head>", "<body>", '<div class="top">', "<li>Home</li>", "<li>About us</li>", "</div>", '<div class="main">', f"<h1>{' '.join(rnd.sample(words, 4)).capitalize()}</h1>", f"<p>{prose[0]}</p>", "<p>Advertisement</p>", f"<p>{prose[1]}</p>", f"<p>{prose[2]}</p>"]
    lines += ["</div>"] * (i % 3 > 0) + ['<div class="end">', f"<p>© 20{i % 30:02d} Site</p>", f"<p>{prose[3]}</p>", "</div>", "</body></html>"]
    at = {n for n, x in enumerate(lines, 1) if x.startswith("<h1>") or (x.startswith("<p>") and any(p in x for p in prose[:3]))}
    return ("page", f"{host}{i}", f"https://www.{host}.example/en/story-{i}", "\n".join(lines), True), at


def test_main_body(spark):
    made = [page(i, h) for h in ("kanto", "bruno") for i in range(12)]
    error = ("page", "err", "https://www.kanto.example/en/x", "<html>\n<body>\n<h1>Sorry, we couldn't find that page.</h1>\n</body></html>", True)
    plain = ("evidence", "e", "https://www.kanto.example/en/long-walk-7", "Home\nAbout us\nLong walk by the sea\nThe sea was calm and grey all day.\n* It rained in the evening again.\nAdvertisement\nThen we walked back home at night.", False)
    odd = [("page", "null", None, None, True), ("page", "empty", None, "", True), ("evidence", "n", None, "One line here.\n\nThe next line of the text is this.", False)]
    df = spark.createDataFrame([m[0] for m in made] + [made[0][0], error, plain, *odd], "src string, rec_id string, url string, text string, page boolean").withColumn("host", F.lit("clash"))
    got = {}
    for r in mainbody.main_body(df, least=4).distinct().collect():
        got.setdefault(r.rec_id, set()).add(r.line_no)
    for row, want in made:
        assert got[row[1]] == want, row[1]
    assert "err" not in got and "null" not in got and "empty" not in got and got["e"] == {3, 4, 5, 7}
    assert mainbody.main_body(df.limit(0)).collect() == []
    strange = [(None, None, None, "<div>\n<p>One line of the text is here.</p>\n</div>", None), ("page", "x", "http://[bad", "One line of the text here.\nAnother line of it.", True), ("page", "y", "https://h.example/%zz?x", "<", None)]
    assert {r.rec_id for r in mainbody.main_body(spark.createDataFrame(strange, df.drop("host").schema)).collect()} >= {None, "x"}


def test_tree_matching():
    a = "<html>\n<head>\n<title>no line</title>\n" + "<style>.x{}</style>\n" * 900 + "</head>\n<body>\n<nav>\n<li>Home</li>\n</nav>\n<main>\n<section class='text'>\n<h1>Red lamp</h1>\n<div><p>Long words.</p></div>\n</section>\n<ul>\n<li>One</li>\n</ul>\n</main>\n</body>\n</html>"
    x = mainbody.parse_html(a, "h.example")
    assert mainbody.layout(x) == "body(nav()main(section.text()ul()))" and [k.text for k in x[3].kids] == ["Red lamp", "Long words."] and [k.text for b in x for k in b.kids if isinstance(k, mainbody.Line)][0] == "Home"
    y = mainbody.unpack(mainbody.pack(x))
    assert mainbody.layout(y) == mainbody.layout(x) and [(k.no, k.text, k.tag, k.key) for k in y[3].kids] == [(k.no, k.text, k.tag, k.key) for k in x[3].kids]
    b = "<body>\n<div>\n<p>Notice</p>\n</div>\n<nav>\n<li>About</li>\n<li>Home</li>\n</nav>\n<main>\n<section class='text'>\n<h1>Blue lamp</h1>\n</section>\n</main>\n</body>"
    weight, pairs = mainbody.match(x[0], mainbody.parse_html(b, "h.example")[0], True)
    assert dict(pairs) == {0: 0, 1: 2, 2: 3, 3: 4} and weight == 4 + 2 + 1  # containers, the same line, a line of the same tag
    open_ = "<body>\n<div class=a>\n<p>x\n<div class=b>\n<p>y\n<div class=c>\n<p>z"
    assert mainbody.layout(mainbody.parse_html(open_, "")) == "body(div.a()div.b()div.c())"  # no end tags, no depth
    assert mainbody.layout(mainbody.parse_html("plain <b>line", "")) == "body()" and mainbody.match(x[0], mainbody.parse_html("", "")[0])[0] == 1


def test_wrapper_over_layouts_and_nesting(spark):
    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.sample("quiet river moves past old mill and carries leaves under bridges where children fish".split(), n)).capitalize()
    rows, want = [], {}
    for i in range(40):
        notice = ["<div class='note'>", f"<p>{'We keep small files on your machine to remember what you like. ' * 12}</p>", "</div>"] if i % 3 else []
        body = ["<main>", "<article>", f"<h1>{some(4)}</h1>", f"<p>{some(9)} {i}.</p>", "<p>Join our letter and never miss a story again.</p>", f"<p>{some(8)} {i}.</p>", "</article>", "</main>"]
        rail = ["<aside>", *[f"<li>{some(5)}</li>" for _ in range(3)], "</aside>"] if i % 2 else []
        lines = ["<html>", "<head>", *["<meta name='x' content='" + "y" * 200 + "'>"] * (60 if i % 4 == 0 else 1), "</head>", "<body>", *notice, "<nav>", "<li>Home</li>", f"<li>{some(3)}</li>", "</nav>", *body, *rail, "</body>", "</html>"]
        at = lines.index("<article>") + 1
        rows.append(("page", f"p{i}", f"https://www.selva.example/en/story-{i}", "\n".join(lines), True))
        want[f"p{i}"] = {at + 1, at + 2, at + 4}
    rows += [("evidence", f"e{i}", f"https://www.selva.example/en/e-{i}", f"Home\nJoin our letter and never miss a story again.\n{some(9)} {i}.", False) for i in range(6)]
    df = spark.createDataFrame(rows, "src string, rec_id string, url string, text string, page boolean")
    for plain_rule in (True, False):
        got = {}
        for r in mainbody.main_body(df, plain_rule).collect():
            got.setdefault(r.rec_id, set()).add(r.line_no)
        assert {k: v for k, v in got.items() if k[0] == "p"} == want and all(got[f"e{i}"] == {3} for i in range(6))


def test_constants_of_any_length(spark):
    rnd = random.Random(6)
    words = "quiet river moves past old mill and carries leaves under bridges where children fish until evening".split()
    notice = " ".join(rnd.choice(words) for _ in range(90)).capitalize() + "."
    some = lambda n: " ".join(rnd.sample(words, n)).capitalize()
    colours = ["red", "blue", "green", "black", "white"]
    rows, want = [], {}
    for i in range(30):
        lines = [f"Home > {some(3)} {i}", f"{some(4)}", f"{some(9)} {i}.", notice, f"Colour – {colours[i % 5]}", f"Finish – {colours[i // 5 % 5]}", f"{some(8)} {i}."]
        rows.append(("page", f"p{i}", f"https://www.kanto.example/en/story-{i}", "\n".join(lines), True))
        want[f"p{i}"] = {2, 3, 5, 6, 7}
    for i in range(30):  # the notice holds more words than the body
        body = [f"<h1>{some(4)}</h1>", f"<p>{some(9)} {i}.</p>", f"<p>{some(8)} {i}.</p>"]
        rows.append(("page", f"h{i}", f"https://www.bruno.example/en/story-{i}", "\n".join(["<html>", "<body>", '<div class="note">', f"<p>{notice}</p>", "</div>", '<div class="main">', *body, "</div>", "</body></html>"]), True))
        want[f"h{i}"] = {7, 8, 9}
    df = spark.createDataFrame(rows, "src string, rec_id string, url string, text string, page boolean")
    got = {}
    for r in mainbody.main_body(df, host_share=0.3, least=4).collect():
        got.setdefault(r.rec_id, set()).add(r.line_no)
    assert {k: v & {1, 4} if k[0] == "p" else v for k, v in got.items()} == {k: set() if k[0] == "p" else v for k, v in want.items()}
    keys = {r.k for r in mainbody.parsed(df.filter("rec_id like 'p%'")).select(F.explode("keys").alias("k")).collect()}
    assert mainbody.key(mainbody.mask(notice, "www.kanto.example")) in keys and mainbody.key("Home") in keys and mainbody.key("Colour") not in keys


def test_long_head_is_no_body():
    head = ["<html>", "<head>", "<title>A long walk</title>", *(f'<meta name="m{i}" content="{"x" * 90}">' for i in range(80)), "</head>"]
    lines = mainbody.parse_html("\n".join([*head, "<BODY>", "<h1>Walk</h1>", "</BODY></html>"]), "a.example")[0].kids
    assert [(x.no, x.text) for x in lines] == [(len(head) + 2, "Walk")]


def brute_match(a, b):
    if not a or not b:
        return 0
    skip = max(brute_match(a[1:], b), brute_match(a, b[1:]))
    return max(skip, 1 + brute_match(a[0][1], b[0][1]) + brute_match(a[1:], b[1:])) if a[0][0] == b[0][0] else skip


LEAF = st.sampled_from("xyz").map(lambda t: (t, []))
TREES = st.lists(st.tuples(st.sampled_from("ab"), st.lists(LEAF, max_size=3)), max_size=4)


@settings(max_examples=150, deadline=None)
@given(TREES, TREES)
def test_tree_matching_is_the_largest(a, b):
    def tree(kids, start):
        blocks = [mainbody.Block("body", None, 0)]
        for label, leaves in kids:
            inner = mainbody.Block(label, blocks[0], len(blocks)) if label in "ab" else blocks[0]
            if inner is not blocks[0]:
                blocks.append(inner)
                blocks[0].kids.append(inner)
            inner.kids += [mainbody.Line(0, f"{start} {len(blocks)} {i} of them", t, 0, "") for i, (t, _) in enumerate(leaves)]
        return blocks

    x, y = tree(a, "one"), tree(b, "two")
    size, pairs = mainbody.match(x[0], y[0], True)
    assert size == brute_match(a, b) + 1
    assert all(x[i].label == y[j].label for i, j in pairs) and sorted(pairs) == sorted(pairs, key=lambda p: p[1])


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_percentiles_against_sorting(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "b", None]), f"r{i}", rnd.choice([None, -1.0, float("nan"), 30000.0, rnd.random() * 100])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id string, v double").withColumn("_rank", F.lit(1))
    got = {(r.g, r["quantile"]): (r.n, r["value"]) for r in percentiles.exact_percentiles(df, ["g"], "v", "id", [0.0, 0.5, 0.9, 1.0]).collect()}
    for g in ("hot", "b", None):
        xs = sorted(v for k, _, v in rows if k == g and v is not None and v >= 0)
        for q in (0.0, 0.5, 0.9, 1.0):
            p = q * (len(xs) - 1)
            lo = int(p)
            hi = min(lo + 1, len(xs) - 1)
            assert got[g, q][0] == len(xs) and got[g, q][1] == pytest.approx(xs[lo] + (p - lo) * (xs[hi] - xs[lo]))
    assert percentiles.exact_percentiles(df.limit(0), ["g"], "v", "id", [0.5]).collect() == []


def test_claims_at_ties(spark):
    df = spark.createDataFrame([("L1", f"r{i}", 5.0 if i < 60 else 9.0, "2024-01-02") for i in range(100)], "level string, id string, v double, d string").withColumn("day", F.col("d").cast("date"))
    claims = spark.createDataFrame([(1, "L1", None, None, 0.5, 5.0), (2, "L1", None, None, 0.7, 5.0), (3, None, "2024-01-03", None, 0.5, 5.0), (4, "L1", "2024-01-01", "2024-01-02", 0.61, 5.0), (5, "L1", None, None, 0.3, 7.0)], "claim_id int, level string, day_from string, day_to string, quantile double, claimed_ms double")
    s = {r.claim_id: (r.n, r.below, r.upto) for r in percentiles.interval_shares(df, claims, "v", "id", "day", ["level"]).collect()}
    assert s == {1: (100, 0, 60), 2: (100, 0, 60), 4: (100, 0, 60), 5: (100, 60, 60)}
    assert {r.claim_id for r in percentiles.wrong_claims(df, claims, "v", "id", "day", ["level"]).collect()} == {2, 5}


# -- 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["{{ title }}", "Lamp by [insert author here]", "A %%DATE%% lamp", "x ${price}", "#{a.b} | y", "<%= x %>", "[YOUR_NAME]", "$PRICE$", "__TITLE__", "the lamp NaN there", "[object Object]", "Traceback: cannot render view", "{status}", "%(status)s"])
def test_placeholder(text):
    assert residue.placeholder(text)


@pytest.mark.parametrize("text", ["In X the tag `{{ user }}` prints the reader", "Quoting `${HOME}` in shells", "a server error once printed [object Object] on 3 tickets", "asks writers to leave no [TODO] marks", "writes undefined behaviour out", "Quoting `${ ...", "$ cd --all 3", "f(x)[0] = {1: 2}", "", "2024-03-31T02:00:00+01:00[Europe/Paris]"])
def test_no_placeholder(text):
    assert not residue.placeholder(text)


def test_residue(spark):
    rows = []
    for i, h in enumerate(["a", "b", "c", "d", "e"]):
        url = f"https://www.{h}site.example/en/page-{i}"
        rows += [("evidence", f"bad{i}", url, False, f"Please enable JavaScript to view {h}site."), ("evidence", f"talk{i}", url, False, f"How Person{h.upper()} answers error {400 + i} without losing the reader"), ("evidence", f"ok{i}", url, False, f"A plain sentence about {h} lamps.")]
    rows += [("run", "r1", None, True, "bot_wall_detected"), ("run", "r2", None, True, "{{ run.status }}"), ("run", "r3", "https://www.asite.example/x", True, "note: Please enable JavaScript to view asite."), ("evidence", "l", None, False, "Lorem ipsum dolor sit amet, consectetur."), ("evidence", "null", None, False, None), ("evidence", "empty", None, False, ""), ("evidence", "long", None, False, "word " * 50_000), rows[0]]
    df = spark.createDataFrame(rows, "kind string, rec_id string, url string, own boolean, text string").withColumn("frag", F.lit("clash"))
    assert {r.rec_id for r in residue.residue(df).collect()} == {*(f"bad{i}" for i in range(5)), "r2", "r3", "l"}
    assert residue.residue(df.limit(0)).collect() == []


MESSAGES = ["429 Too Many Requests", "Error 503: service unavailable", "504 Gateway Time-out", "HTTP 403 – Forbidden nginx/1.27", "Texto de relleno pendiente", "asdf asdf asdf", "Your text goes here.", "Access to /shop/8671 was denied", "Sorry, we couldn't find that page.", "Aone is down for maintenance. Please check back in 54 minutes.", "Включите JavaScript, чтобы открыть страницу", "Страница не найдена.", "Le serveur ne répond pas.", "Scholars came. Texte provisoire à remplacer", "Something went wrong on our side. Reference 8dd4e92-68", "Ｎｏｔ Ｆｏｕｎｄ nginx/1.2"]
TALK = ["Access denied for centuries, Kloneid opens its tower", "Why Koskokai works without JavaScript", "Forbidden gardens of", "Maintenance ...", "Not found in Feistivi until 1911: the...", "Every archive carries a modern browser and 959 bytes.", "404 Not Found is what the reader of the guide sees", "The server answers `503 Service Unavailable` under load", "http status 503", "7 Not Found letters"]


def test_residue_message_on_one_page(spark):
    rows = [("evidence", f"m{i}", "https://www.aone.example/en/lamp-1", False, m) for i, m in enumerate(MESSAGES)]
    rows += [("evidence", f"t{i}", "https://www.aone.example/en/lamp-1", False, m) for i, m in enumerate(TALK)]
    rows += [("evidence", "content", "https://www.aone.example/en/too-many-requests", False, "429 Too Many Requests"), ("evidence", "nowhere", None, False, "504 Gateway Time-out"), ("run", "r", "https://www.aone.example/x", True, "page text: Error 404: not found"), ("run", "own", "https://www.aone.example/x", True, "fetch failed: 503 Service Unavailable")]
    df = spark.createDataFrame(rows, "kind string, rec_id string, url string, own boolean, text string")
    assert {r.rec_id for r in residue.residue(df).collect()} == {*(f"m{i}" for i in range(len(MESSAGES))), "nowhere", "r"}


OWN_BROKEN = ["missing_fields: undefined", "missing_fields: UNDEFINED {x}", "page_class:[object Object]", "route: NaN", "tactic:<no value>", "missing_fields: (null)", "fetch failed: [TITLE]", "route: ｛｛ x ｝｝", "partial: cannot render", "success\nTraceback:"]
OWN_WHOLE = ["bot_wall_detected", "fetch failed: 503 Service Unavailable", "http status 503", "missing_fields: financial", "route: café", "missing_fields: renderings", "page_class:product_page", "success"]


def test_residue_in_own_wording(spark):
    rows = [("run", f"{k}{i}", "https://www.a.example/x", True, t) for k, ts in (("bad", OWN_BROKEN), ("ok", OWN_WHOLE)) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "kind string, rec_id string, url string, own boolean, text string")
    assert {r.rec_id for r in residue.residue(df).collect()} == {f"bad{i}" for i in range(len(OWN_BROKEN))}


def test_residue_in_words_no_list_holds(spark):
    finnish, odd = "Hakemaasi sivua ei löytynyt palvelimelta {}.", "Kaikki putket ovat jumissa juuri nyt, tule myöhemmin takaisin {} kohteeseen"
    rows, titles = [], []
    for i, h in enumerate(["kanto", "bruno", "selva", "tarmo"]):
        for j in range(2):
            url = f"https://www.{h}.example/fi/kivinen-polku-{i}{j}"
            rows += [("evidence", f"f{i}{j}", url, False, finnish.format(h)), ("evidence", f"own{i}{j}", url + "/b", False, f"Kaikki oikeudet kuuluvat meille {h}")]
            rows += [("evidence", f"slug{i}{j}", f"https://www.{h}.example/fi/vanha-kivinen-silta", False, "Vanha kivinen silta"), ("evidence", f"title{i}{j}", f"https://www.{h}.example/fi/p-{j}", False, "Joki virtaa hiljaa")]
            rows += [("evidence", f"day{i}{j}", url + "/c", False, f"Sun, {i + 3} Mar 2024 1{j}:00:00 GMT"), ("evidence", f"cut{i}{j}", url + "/d", False, "Kun vanha joki tulvii ...")]
            rows += [("run", f"run{i}{j}", url, True, "l3_failed:TimeoutError:page load takes long")]
            titles += [(f"https://www.{h}.example/fi/p-{j}", "Joki virtaa hiljaa merelle"), (url, finnish.format(h))]  # an error page repeats its message
        rows.append(("evidence", f"site{i}", f"https://www.kanto.example/fi/sivu-{i}", False, "Kanto ja kumppanit oy"))  # one host
    rows += [("evidence", "several", "https://www.aamu.example/fi/talo", False, "Talo mäellä\n" + odd.format("aamu")), ("evidence", "none", "https://www.aamu.example/fi/x", False, odd.format("aamu")[:-5])]
    for i, h in enumerate(["kanto", "bruno", "selva"]):
        rows += [("evidence", f"o{i}", f"https://www.{h}.example/fi/yks-{i}", False, odd.format(h)), ("evidence", f"go{i}", f"https://www.{h}.example/fi/kaks-{i}", False, f"{['Kahvila', 'Kirjasto', 'Torni'][i]} auki\nPalaa etusivulle tästä")]
    rows += [("evidence", "glued", "https://www.aamu.example/fi/y", False, odd.format("aamu") + " Palaa etusivulle tästä"), ("evidence", "story", "https://www.aamu.example/fi/z", False, odd.format("aamu") + " Matti sanoi aamulla")]
    df = spark.createDataFrame(rows, "kind string, rec_id string, url string, own boolean, text string")
    got = {r.rec_id for r in residue.residue(df, spark.createDataFrame(titles, "url string, title string")).collect()}
    want = {r[1] for r in rows if r[1][0] in "fo" and r[1][1].isdigit()} | {"several", "glued"}
    assert got - {r[1] for r in rows if r[1].startswith("own")} == want, got ^ want


# -- 6 ---------------------------------------------------------------------------------------------------------------

SAME = [("Loukidru", "Lоukіdru"), ("Fastix", "Ｆａｓｔｉｘ"), ("a b", "a b"), ("ab", "a​b"), ("Löffel", "Löﬀel"), ("K2", "K2"), ("Hoвый", "Новый"), ("a–b", "a–b﻿"), ("ё", "ë")]
OTHER = [("Kure", "kure"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("a", "ab"), ("½", "1/2"), ("™", "TM")]


def forms(spark, pairs):
    df = spark.createDataFrame([(i, k, t) for i, p in enumerate(pairs) for k, t in zip("ab", p)], "i int, k string, text string")
    got = {(r.i, r.k): r.form for r in lookalike.consistent_form(df, "text").collect()}
    return [(got[i, "a"], got[i, "b"]) for i in range(len(pairs))]


def test_looks(spark):
    assert all(a == b for a, b in forms(spark, SAME))
    assert all(a != b for a, b in forms(spark, OTHER))


def test_classes_are_transitive():
    k = lookalike.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "x")):
        k.union(a, b)
    assert list(k.members().values()) == [["a", "b", "c", "d"]]
    assert lookalike.representatives(k, {"c": 5, "a": 5, "d": 1}) == {"b": "a", "c": "a", "d": "a"}


def test_longest_match_first():
    f = lookalike.Rewriter({"ab": "X", "a": "Y", "bc": "Z"})
    assert f("éabca") == "éXcY"


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_stable(text):
    f = _rewriter()
    assert f(f(text)) == f(text) or unicodedata.normalize("NFD", f(text)) == unicodedata.normalize("NFD", f(f(text)))


_F: list = []


def _rewriter():
    if not _F:
        c = lookalike.look_alikes()
        _F.append(lookalike.Rewriter(lookalike.representatives(c, {m: 1 for g in c.members().values() for m in g if m.isascii()})))
    return _F[0]


def test_pairs(spark):
    rows = [("r", "1", "Kure"), ("r", "2", "Kurе"), ("r", "2", "Kurе"), ("r", "3", "Kure"), ("s", "4", "Kurе"), ("r", "5", None), ("r", "6", " "), ("r", "7", "​"), ("r", "8", "x" * 100_000)]
    df = lookalike.consistent_form(spark.createDataFrame(rows, "run string, id string, text string").withColumn("form", F.lit("old")), "text")
    assert sorted(tuple(r) for r in lookalike.same_look_pairs(df, ["run"], "id", "text").collect()) == [("1", "2"), ("2", "3")]
    assert lookalike.same_look_pairs(df.limit(0), ["run"], "id", "text").collect() == []


# -- 7 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25), st.sampled_from([40, 64]))
def test_plan_places_everything(histogram, capacity):
    p = packing.plan_containers(histogram, capacity)
    placed = {}
    for pattern, m in p.patterns:
        assert sum(x * k for x, k in pattern.items()) <= capacity and m > 0
        for x, k in pattern.items():
            placed[x] = placed.get(x, 0) + k * m
    assert placed == histogram
    total = sum(x * n for x, n in histogram.items())
    assert p.containers() <= 2 * max(1, -(-total // capacity))


def test_exact_complements_are_used():
    p = packing.plan_containers({60: 5, 40: 5, 50: 2, 30: 3, 45: 1, 25: 1}, 100)
    assert p.containers() == -(-sum(x * n for x, n in {60: 5, 40: 5, 50: 2, 30: 3, 45: 1, 25: 1}.items()) // 100)


def test_pack(spark):
    rnd = random.Random(3)
    sizes = [0, 0, 10, 250, 100, None] + [rnd.choice([7, 7, 7, 20, 33, 55, 90]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").withColumn("part", F.lit(9))
    packs = spark.createDataFrame([(1, 100), (2, 64), (3, None)], "pack_id int, capacity_tokens int")
    got = packing.pack(df, packs, "id", "n").collect()
    for pack, cap in ((1, 100), (2, 64)):
        rows = [r for r in got if r.pack_id == pack]
        room, text = {}, {}
        for r in rows:
            room[r.container] = room.get(r.container, 0) + r.tokens
            text.setdefault(r.id, []).append((r["first"], r.tokens))
        assert max(room.values()) <= cap and sorted(room) == list(range(max(room) + 1))
        for i, n in enumerate(sizes):
            parts = sorted(text[i])
            assert sum(t for _, t in parts) == (n or 0) and len(parts) == max(1, -(-(n or 0) // cap)) and [a for a, _ in parts] == [k * cap for k in range(len(parts))]
        assert len(room) <= 1.05 * sum(n or 0 for n in sizes) / cap + 2
    assert packing.pack(df.limit(0), packs, "id", "n").collect() == []
    f = {r.pack_id: r for r in packing.fill(packing.pack(df, packs, "id", "n"), packs).collect()}
    assert f[1].tokens == sum(n or 0 for n in sizes) and f[1].fullest <= 100 and f[1].filled > 0.9


# -- 8 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 40), min_size=1))
def test_every_moment_keeps_the_shares(blocks):
    order = mixing.schedule(blocks)
    n, seen = len(order), dict.fromkeys(blocks, 0)
    assert n == sum(blocks.values())
    for t, (s, k) in enumerate(order, 1):
        assert k == seen[s]
        seen[s] += 1
        for x, m in blocks.items():
            assert abs(seen[x] - t * m / n) < 1 + 1e-9


def test_quotas():
    t = {"a": (0.5, 1), "b": (0.3, 2), "none": (0.2, 4)}
    q = mixing.quotas({"a": 100, "b": 100}, t)
    assert q["a"]["quota"] == 100 and q["b"]["quota"] == 60 and "none" not in q
    q = mixing.quotas({"a": 100, "b": 100}, t, total=250)
    assert q["a"] == {"weight": 0.625, "quota": 100, "capped": True} and q["b"]["quota"] == 150
    assert mixing.quotas({}, t) == {}


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big", "big", "big", "small", None, "unasked"]), rnd.randint(1, 30)) for i in range(3000)] + [(9000, "big", 0), (9001, "small", None)]
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumn("slot", F.lit(1))
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    draws, shares = mixing.mix(df, targets, "id", "source", "n", block_tokens=1, most_blocks=64)
    d = draws.collect()
    uses = {}
    for r in d:
        uses[r.id] = uses.get(r.id, 0) + 1
        assert r["pass"] == 0 or r.source == "small"
    assert max(uses.values()) <= 3 and {r.source for r in d} == {"big", "small"} and 9000 not in uses
    s = {r.source: r for r in shares.collect()}
    assert s["absent"].reached_share == 0 and not s["absent"].has_texts
    assert s["big"].reached_share == pytest.approx(4 / 9, abs=0.01) and s["small"].reached_share == pytest.approx(5 / 9, abs=0.01) and s["small"].repeats == 3
    total = sum(r.tokens for r in d)
    half = sum(r.tokens for r in d if r.slot < 32 and r.source == "big") / sum(r.tokens for r in d if r.slot < 32)
    assert half == pytest.approx(4 / 9, abs=0.05) and total > 0
    e, s = mixing.mix(df.limit(0), targets, "id", "source", "n")
    assert e.collect() == [] and {r.reached_share for r in s.collect()} == {0.0}


def test_full_mix(spark, data):
    draws = queries.QUERIES["p8_mixed"](spark, data)
    uses = draws.groupBy("doc_id", "source").count().collect()
    shares = {r.source: r for r in queries.QUERIES["p8_shares"](spark, data).collect()}
    assert any(r.capped for r in shares.values()) and all(r["count"] <= shares[r.source].max_repeats for r in uses)
    corpus = queries.counted(spark, data).agg(F.sum("n_tokens").alias("n")).first()["n"]
    assert sum(r.tokens for r in shares.values()) == pytest.approx(corpus, rel=0.05)


def test_tokens(spark):
    enc = tokens.encoder(tokens.VOCABULARY)
    text = "Der späte Nachweis <|endoftext|> 123\n"
    assert enc.decode(enc.encode_ordinary(text)) == text
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.n_tokens for r in tokens.token_counts(df, "id", "text").collect()} == {1: len(enc.encode_ordinary(text)), 2: 0, 3: 0}


# -- 9 ---------------------------------------------------------------------------------------------------------------


def brute_repeats(words, k=5):
    seen, covered = set(), set()
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        if g in seen:
            covered.update(range(i, i + k))
        seen.add(g)
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "Ähm"]), max_size=60))
def test_repeats_against_brute_force(words):
    assert repetition.repeated_words(", ".join(words)) == (len(words), brute_repeats([w.casefold() for w in words]))


def test_repetition_cases(spark):
    s = "One two three four five six."
    rows = [(1, s + " ONE two, three four five six!"), (2, s), (3, ""), (4, None), (5, "word " * 60_000), (1, s)]
    got = {}
    for r in repetition.repeated_share(spark.createDataFrame(rows, "doc long, text string").withColumn("id", F.lit("clash")), "doc", "text").collect():
        got.setdefault(r.doc, []).append((r.n_words, r.n_repeated))
    assert sorted(got[1]) == [(6, 0), (12, 6)] and got[2] == [(6, 0)] and got[3] == got[4] == [(0, 0)] and got[5][0][0] == 60_000 and got[5][0][1] == 59_999
    assert repetition.repeated_share(spark.createDataFrame([], "doc long, text string"), "doc", "text").collect() == []


def test_line_first(spark):
    notice, rnd = "We keep small files on your machine number {} to remember you", random.Random(8)
    words = "quiet river moves past old mill and carries leaves under bridges where children fish until evening".split()
    rows, bad, total = [], {}, {}
    for i in range(60):
        lines = [(" ".join(rnd.sample(words, 10)).capitalize() + f" {i}.", False) for _ in range(6)]
        if i % 2:
            lines.insert(rnd.randrange(6), (notice.format(i), True))  # boilerplate of the corpus, in words no list holds
        if i % 3 == 0:
            lines.insert(2, ("Home | News | Shop | About", True))
        if i % 5 == 0:
            lines += [(lines[0][0], True), ("More", True), (f"    {rnd.choice(words)} = {rnd.choice(words)} + {rnd.choice(words)}", False)]
        rows.append((i, "\n".join(t for t, _ in lines)))
        n = lambda t: len(re.findall(r"\w+", t))
        bad[i], total[i] = sum(n(t) for t, b in lines if b), sum(n(t) for t, _ in lines)
    rows += [(100, None), (101, ""), (102, "A | B | C\nshort\nOne whole sentence stands here."), rows[0]]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("h", F.lit("clash"))
    out = repetition.line_first(df, "doc", "text").collect()
    got = {r.doc: r for r in out}
    assert len(out) == 63 and all((got[i].n_words, got[i].n_words - got[i].n_words_kept) == (total[i], bad[i]) for i in range(60))
    assert (got[100].n_words, got[100].rejected, got[101].lost) == (0, False, 0.0) and (got[102].n_lines, got[102].n_kept, got[102].rejected) == (3, 1, True)
    assert repetition.line_first(df.limit(0), "doc", "text").collect() == []
    assert repetition.repeated_words("一二三四五六。一二三四五六") == (12, 6)


def test_partial_percentiles_add_up(spark):
    rnd = random.Random(2)
    rows = [(f"r{i}", "ab"[i % 2] if i % 7 else None, i % 3, rnd.choice([rnd.random() * 100, 30.0])) for i in range(500)] + [("x", "a", 0, float("nan")), ("y", "a", 0, None), ("z", "a", 1, -1.0)]
    df = spark.createDataFrame(rows, "id string, g string, day int, v double")
    whole = {(r.g, r.quantile): (r.n, round(r.value, 9)) for r in percentiles.exact_percentiles(df, ["g"], "v", "id", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    parts = [percentiles.partial_counts(df.filter(F.col("day") == d), ["g"], "v") for d in range(3)]
    union = parts[0].unionAll(parts[1]).unionAll(parts[2])
    assert {(r.g, r.quantile): (r.n, round(r.value, 9)) for r in percentiles.combined_percentiles(union, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()} == whole
    rough = percentiles.combined_percentiles(percentiles.partial_counts(df, ["g"], "v", step=0.5), ["g"], "v", [0.25, 0.5, 0.99])
    assert all(abs(r.value - whole[r.g, r.quantile][1]) <= 0.25 + 1e-9 for r in rough.collect())
    assert percentiles.combined_percentiles(union.limit(0), ["g"], "v", [0.5]).collect() == []


def test_large_capacities(spark):
    docs = spark.createDataFrame([(i, 1 + i % 5) for i in range(40)], "id long, n long")
    packs = spark.createDataFrame([(f"p{k}", 2**20 + k) for k in range(9)], "pack_id string, capacity_tokens int")
    got = packing.pack(docs, packs, "id", "n").groupBy("pack_id").agg(F.count("*").alias("n"), F.max("container").alias("c")).collect()
    assert len(got) == 9 and all((r.n, r.c) == (40, 0) for r in got)


def test_invisible_of_all_planes():
    form = lookalike.Rewriter(lookalike.representatives(lookalike.look_alikes(), {m: 1 for g in lookalike.look_alikes().members().values() for m in g if m.isascii()}))
    assert form("a\U000e0041\U000e007fb\U000e0100\ufe0f\u200d") == "ab" and form("Ꮋello ɑ") == "Hello a"


def test_letters_learnt_from_words(spark):
    odd = "\ua4d0"  # a letter of a script that no table holds
    rows = [(1, "the Big barn"), (2, f"the {odd}ig barn"), (3, "Bold move"), (4, f"{odd}old move"), (5, f"x{odd}x"), (6, "ⴰnce"), (7, "once"), (8, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    form = {r.id: r.form for r in lookalike.consistent_form(df, "text").collect()}
    assert form[1] == form[2] and form[3] == form[4] and form[6] != form[7]  # one word is no evidence
    c = {r.id: (r["class"], r.links) for r in lookalike.same_look_classes(lookalike.consistent_form(df.withColumn("s", F.lit("s")), "text"), ["s"], "id", "text").collect()}
    assert c == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}
    rows = [("s", k, t) for k, t in enumerate(["ab", "аb", "a\u200bb", "ab", "ab", " ", "other"])] + [("t", 9, "аb")]
    df = lookalike.consistent_form(spark.createDataFrame(rows, "s string, id long, text string"), "text")
    links = {r.id: r.links for r in lookalike.same_look_classes(df, ["s"], "id", "text").collect()}
    pairs = [(r.key_a, r.key_b) for r in lookalike.same_look_pairs(df, ["s"], "id", "text").collect()]
    assert links == {i: sum(i in p for p in pairs) for i in range(5)}
