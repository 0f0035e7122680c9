"""Template leftovers, filler, error-page text and script notices where content should stand.

Host evidence, which knows no words: a record is a *response* if it is the same low-information text, host name, numbers and
ids masked, on several pages of several hosts, and neither the words of these pages' addresses nor their titles agree
with it. What a site says about its pages differs from page to page, and what it says on all of them stands on one host; only a
server's or a template's own message replaces the content of unrelated pages of unrelated hosts. From the responses
their messages are learnt, and a record holds residue if it is a response, if one of its fragments (lines, sentences, title
parts) is a learnt message, or if a fragment is a learnt message followed by another piece that stands on several pages.
Titles that are responses themselves agree with nothing: error pages repeat their message there.

Detectors, second: unfilled placeholders and failed renderings, filler Latin, status lines and messages of known wording count
on a single page too.
"""

from __future__ import annotations

import re
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.signature import once
from factloom.llm.lookalike import Rewriter, consistent_form, look_alikes, representatives
from factloom.session import stage

# Template syntax that was not filled in.
TEMPLATES = [
    r"\{\{\{?[^{}]*\}?\}\}?|\{\{", r"\{%[^%]*%?\}?", r"<%[^%]*%?>?", r"%%\w+%%", r"\$\{[^}]*\}?", r"#\{[^}]*\}?", r"\[\[[^\]]*\]?\]?", r"%\(\w+\)[sdf]", r"\$[A-Z][A-Z_]{2,}\$", r"__[A-Z][A-Z_]*[A-Z]__",
    r"(?<![\w.])\{[a-z_]+(?:\.[a-z_]+)*\}", r"\[(?:[Ii]nsert|[Yy]our|[Aa]dd|[Ee]nter|YOUR|INSERT|ADD|ENTER)[ _][^\]]*\]", r"\[[A-Z]+(?:_[A-Z]+)+\]",
]
# Words that a failed rendering leaves in the place of a value.
FAILED = [
    r"<no value>", r"\[object Object\]", r"\bNaN\b", r"\bnull null\b", r"\bundefined\b", r"\(none\)", r"\(null\)", r"\bTODO\b:", r"\bTraceback\b:", r"\bcannot render\b",
    r"\[(?:NAME|TITLE|DATE|PRICE|TODO|TBD|BRAND|AUTHOR|SUMMARY|HEADLINE|DESCRIPTION)\]",
]
_TEMPLATE, _FAILED = re.compile("|".join(TEMPLATES)), re.compile("|".join(FAILED))
#: Literals of which each pattern above needs at least one.
_MARKS = r"[{}\[$#<]|%%|%\(|__|NaN|null|undefined|\(none|TODO|Traceback|render"
#: Words around a token by which a sentence talks about it: what prints, writes or names it, and what it is said to be.
_NAMED = re.compile(r"(?:\b(?:print|display|show|log|return|emit)(?:s|ed|ing)?|\bsa(?:y|ys|id)|\bwr(?:ite|ites|ote|itten)|\bquot(?:e|es|ed|ing)|\bcalled|\bnamed|\b(?:tag|token|word|term|string|value|marker?)|\bsuch as)\s*$", re.I)
_NAMES = re.compile(r"\s*(?:marks?|tags?|tokens?|markers?|beha[a-z]*)\b", re.I)
_QUOTED = re.compile(r"`[^`\n]*(?:`|$)", re.M)
_LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum".split())
# Tags and statuses of the project's own wording.
OWN = [
    "page_class", "tactic", "cdn", "missing_fields", "robots disallow", "bot_wall", "fetch failed", "http status", "route", "cache_hit", "success", "partial", "failed", "unresolved", "likely_spa", "jsonld_detected", "frameworks", "embedded",
    "trackers", "spa_score", "ab_cookies", "needs_browser",
]
_OWN = rf"^(?:{'|'.join(OWN)})\w*"
#: A tag before something quoted.
_TAG = r"^(?:l\d_\w+:\w+|[a-z][a-z0-9_ ]{0,40}):\s*"
_SPLIT = r"\n|(?<=[.!?…])\s+|\s[|–—]\s"


# Messages that fill a fragment and name no subject, in masked form (@ host, 9 number, # id, / path). Texts and
# patterns are compared in upper case, so no pattern holds a letter escape.
_THING = "(?:page|address|file|url|link|resource|site)"
_ASKED = f"(?:(?:the|this|that) (?:requested )?{_THING}(?: you (?:have )?(?:requested|asked for|(?:are|were) looking for))?)"
_SITE = "(?:@|(?:this|the|our) (?:web ?)?(?:site|page|app|application|service|server))"
_SCRIPTS = "(?:javascript|scripts?|scripting)"
_SHOWN = f"(?:(?:view|see|use|run|read|open|load|continue(?: to)?) (?:{_SITE}|this content)|continue|go on)"
_SOON = "(?:later|again|in (?:9|a few) (?:seconds|minutes|hours)|in a (?:moment|minute))"
MESSAGES = [
    rf"(?:sorry, )?{_ASKED} (?:has moved|(?:has moved or )?(?:no longer exists|does not exist|doesn't exist|(?:can ?not|can't|could not|couldn't) be found|(?:was|is) not found|is no longer available|is gone))", r"(?:page|file|url) not found",
    rf"(?:sorry, )?we (?:couldn't|could not) find {_ASKED}", r"(?:sorry, )?we looked everywhere, but this [a-z]+ is gone", r"nothing lives at this address(?: any ?more)?",
    rf"access(?: to (?:/|{_SITE}|this content))?(?: (?:was|is|has been))? (?:denied|forbidden)", r"(?:oops, )?something went wrong(?: on our (?:side|end))?",
    r"(?:(?:an? )?(?:unexpected |unknown |internal )?(?:server )?error (?:has )?occurred)", r"internal (?:server )?error", r"application (?:fault|error): (?:the server met an exception|a (?:client|server)-side exception has occurred)(?: \((?:digest )?#\))?",
    rf"{_SITE} is (?:currently |temporarily )?(?:(?:down|offline) for (?:scheduled )?maintenance|under maintenance|unavailable)", r"(?:we are )?(?:currently )?(?:down for|under) maintenance", rf"please (?:check|come) back {_SOON}", rf"(?:please )?try again {_SOON}",
    r"your session (?:has )?expired(?:[;,:] (?:please )?sign in again(?: to (?:go on|continue))?)?", r"(?:please )?sign in again to (?:go on|continue)", r"(?:@: )?limit of 9 (?:calls|requests) reached(?:, slow down)?", r"too many requests(?:[,;:] (?:please )?slow down)?",
    r"(?:database )?connection (?:failed|timed out)(?:: too many (?:clients|connections))?(?: \(#\))?", r"the (?:connection|request|server) (?:has )?timed out", r"upstream host hung up before any header came(?: \(reason: [a-z ]+\))?", r"upstream connect error or disconnect/reset before headers(?:.*)", r"bad gateway|gateway time-?out|service (?:temporarily )?unavailable",
    rf"(?:please |you need to )?(?:enable|allow|activate|turn on|switch on) {_SCRIPTS}(?: and cookies)?(?: from @)?(?: in your browser)?(?: (?:in order )?to {_SHOWN})?", rf"{_SITE} (?:needs|requires) (?:{_SCRIPTS}|a (?:newer|modern) browser(?: with {_SCRIPTS} (?:allowed|enabled))?)",
    rf"{_SITE} works (?:only|best) with {_SCRIPTS} (?:(?:switched|turned) on|enabled|allowed)", rf"{_SCRIPTS} (?:(?:is|are) )?(?:required|disabled|blocked)(?: in your browser)?", rf"{_SCRIPTS} must be (?:allowed|enabled)(?: before {_SITE} can start)?", r"noscript: turn scripts on", r"if nothing appears, allow scripts(?: and cookies)?",
    r"turn it on in your browser settings(?: and reload)?", r"your browser is (?:not|no longer) supported",
    r"(?:please )?(?:prove|verify|confirm) (?:that )?you are (?:a )?human(?:: tick the box(?: to continue(?: to @)?)?)?", r"(?:please )?(?:solve|complete) the captcha(?: to (?:go on|continue))?", r"(?:we detected )?unusual traffic from your (?:computer )?network", r"hold on while we make sure that you are no machine(?: \(#\))?",
    r"(?:one moment, )?(?:we are )?(?:testing|checking) your browser(?: before (?:opening|accessing) @)?", r"i(?:'m| am) not a robot",
    r"this is (?:a )?(?:dummy|placeholder|sample) (?:text|copy)(?: for layout purposes only)?", r"(?:your )?(?:text|headline|title|description|caption|content|copy) goes here", r"sample (?:text|description|copy)(?:[,:;]? (?:please )?replace before launch)?", r"(?:please )?replace before launch", r"(?:foo bar(?: baz)? )?placeholder(?: (?:text|copy|headline|image))?",
    r"foo bar(?: baz)?", r"asdf(?: asdf)+", r"xxxxx+(?: xxxxx+)+", r"test test(?:(?: 9)? test)*",
    r"bitte aktivieren sie javascript(?:, um (?:@|diese seite|fortzufahren)(?: zu (?:nutzen|sehen|öffnen))?)?", r"(?:es ist )?ein (?:interner |unerwarteter )?(?:server)?fehler(?: ist)? aufgetreten", r"(?:die )?(?:angeforderte |gesuchte )?seite (?:wurde )?(?:leider )?nicht gefunden", r"(?:der )?(?:server|dienst) (?:ist )?(?:vorübergehend |derzeit )?nicht erreichbar", r"beispieltext(?:, bitte ersetzen)?", r"platzhalter(?:text)?(?:, bitte ersetzen)?",
    r"(?:cette )?page (?:est )?introuvable(?: \(erreur 9\))?", r"le serveur ne répond pas", r"(?:veuillez )?activer javascript dans votre navigateur", r"texte provisoire(?: à remplacer)?", r"une erreur (?:interne )?(?:est survenue|s'est produite)",
    r"la página (?:solicitada |que busca )?no existe", r"página no encontrada", r"error interno(?: del servidor)?(?:: inténtelo (?:en 9 minutos|más tarde|de nuevo))?", r"active javascript(?: para continuar(?: en @)?)?", r"texto de relleno(?: pendiente)?",
    r"страница не найдена", r"сервер временно недоступен(?: \(код 9\))?", r"включите javascript(?:, чтобы (?:открыть страницу|продолжить))?", r"(?:произошла )?ошибка сервера", r"(?:это )?образец текста", r"текст-?заполнитель",
]
_REASON = "|".join(sorted({re.escape(x.phrase) for x in HTTPStatus if x >= 400} | {"gateway time-?out", "request time-?out", "(?:page|file) not found", "service temporarily unavailable", "access denied", "connection timed out", "web server is down"}))
_SERVER = r" (?:nginx|apache|openresty|litespeed|caddy|cloudflare|microsoft-iis|varnish|envoy)(?:/[0-9.]+)?"
#: A status line as servers write it: a code with its reason, a code said to be an error, or a reason with the server's name.
_STATUS = re.compile(rf"(?:(?:http(?:/[0-9.]+)?|(?:http )?error(?: code)?)[ :]*)?[45][0-9][0-9][ :–—-]+(?:{_REASON})(?:{_SERVER})?|(?:http(?:/[0-9.]+)?|(?:http )?error(?: code)?)[ :]*[45][0-9][0-9](?:{_SERVER})?|(?:{_REASON}){_SERVER}", re.I)



_KNOWN = re.compile(rf"(?:{'|'.join(MESSAGES)})(?:$|[ .!|–—…])".upper().replace("@", r"[\w.-]+"))
_KNOWN_STATUS = re.compile(rf"(?:{_STATUS.pattern})(?:$|[ .!|–—])", re.I)


def known_line(text: str) -> bool:
    """Whether a line, or a sentence of it, begins with a status line or a message of known wording."""
    m = re.sub(r"\d+", "9", re.sub(r"\b(?=[0-9a-f-]*\d)[0-9a-f][0-9a-f-]{5,}\b", "#", re.sub(r"(?<!\S)/\S+", "/", text)))
    return text.startswith("Traceback") or bool(_KNOWN_STATUS.match(text)) or any(_KNOWN.match(x.upper()) for x in re.split(r"(?<=[.!?…])\s+", m))


def placeholder(text: str) -> bool:
    """Whether a text holds an unfilled placeholder or a failed rendering. Quoted code does not count, nor does a failed
    rendering that the sentence names."""
    t = _QUOTED.sub(" ", text)
    if _TEMPLATE.search(t):
        return True
    return any(not (_NAMED.search(t[: m.start()]) or _NAMES.match(t[m.end() :])) for m in _FAILED.finditer(t))


class Masks:
    """Columns that mask texts. Upper case is compared, in the form of `to`: look-alikes of two alphabets may differ in lower
    case only. Every step names its input once, so generated code stays small; what comes of the address is a column."""

    def __init__(self, to: dict[str, str]) -> None:
        self.single = [(m, r) for m, r in to.items() if len(m) == len(r) == 1 and ord(m) < 0x10000 and ord(r) < 0x10000 and m.lower() != m]
        self.host, self.brand, self.slug = F.col("_host"), F.col("_brand"), F.col("_slug")

    def of_address(self, df: DataFrame, url: str = "url") -> DataFrame:
        """df with `_host`, `_brand` and `_slug`, the words of the path. What does not occur in texts stands for an empty one."""
        u = F.coalesce(F.col(url), F.lit(""))
        df = df.withColumn("_host", F.upper(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
        parts = F.split("_host", r"\.")
        df = df.withColumn("_brand", F.coalesce(F.try_element_at(parts, F.when(F.size(parts) > 1, F.lit(-2)).otherwise(F.lit(-1))), F.lit("")))
        path = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
        return df.withColumns({"_slug": self.words(F.upper(path)), "_brand": F.when(F.length("_brand") > 2, F.col("_brand")).otherwise(_NO_TEXT), "_host": F.when(F.col("_host") != "", F.col("_host")).otherwise(_NO_TEXT)})

    def upper(self, x: Column) -> Column:
        members, forms = ("".join(pair[i] for pair in self.single) for i in (0, 1))
        low, high = min(members, default="\uffff"), max(members, default="\uffff")  # one range, for it is looked up at every character
        return once(F.upper(x), lambda u: F.when(u.rlike(f"[{low}-{high}&&[^\\u2000-\\u206f]]"), F.translate(u, members, forms)).otherwise(u))

    def mask(self, upper: Column) -> Column:
        """Upper case without host name, paths, ids and numbers: @, /, # and 9."""
        u = F.replace(F.replace(F.regexp_replace(upper, r"(\s|^)/\S+", "$1/"), self.host, F.lit("@")), self.brand, F.lit("@"))
        numbers = lambda v: F.regexp_replace(F.regexp_replace(v, r"\b[0-9A-F][0-9A-F-]{5,}+\b", "#"), r"\d+", "9")
        return _stripped(once(u, lambda v: F.when(v.rlike(r"\d"), numbers(v)).otherwise(v)))

    @staticmethod
    def words(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\p{L}{3,}"), F.lit(0)))


#: Stands for a host or brand that no text can hold.
_NO_TEXT = "\0\0"


def agree(a: Column, b: Column) -> Column:
    """Whether half of the words of a stand in b."""
    return (F.size(a) > 0) & (2 * F.size(F.array_intersect(a, b)) >= F.size(a))


def residue(records: DataFrame, titles: DataFrame | None = None, least_pages: int = 3, least_hosts: int = 2, least_words: int = 3, most_words: int = 40, agreeing: float = 0.5) -> DataFrame:
    """(kind, rec_id) of the records with residue. records: kind, rec_id, url, own BOOLEAN (a list entry or status of the
    project, whose own wording is no residue), text; other columns are not read. titles: url, title of pages, if known.

    A response is a content record (not an own one) that is no cut-off text, of `least_words` to `most_words` words, more words than numbers, on `least_pages` pages of
    `least_hosts` hosts, with which less than `agreeing` of the pages that have words in address or title agree.
    Null and empty texts hold nothing; a null url gives no host evidence and agrees with nothing; repeated rows
    count once, for pages are counted; an empty table gives an empty result. Texts are masked in the JVM, only what is not ASCII
    or may hold a placeholder visits Python; what is shuffled are hashes, and what is joined back are the learnt
    messages, which do not grow with the pages that show them."""
    classes = look_alikes()
    to = representatives(classes, {m: 1 for g in classes.members().values() for m in g if m.isascii()})
    form = Rewriter(to)
    rows = consistent_form(records.filter(F.length("text") > 0).select("kind", "rec_id", "url", "own", "text"), "text", "_form", to)

    @F.arrow_udf("boolean")
    def unfilled(x: pa.Array) -> pa.Array:
        return pa.array([t is not None and placeholder(t) for t in x.to_pylist()], pa.bool_())

    marked = F.col("_form").rlike(_MARKS)
    rows = rows.withColumn("_bad", F.coalesce(F.when(marked, unfilled(F.when(marked, F.col("_form")))), F.lit(False)))
    k = Masks(to)
    own = F.coalesce(F.col("own"), F.lit(False))
    said = F.when(~own, F.array("_form")).when(F.col("_form").rlike(_OWN), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array("_form", F.regexp_replace("_form", _TAG, ""))))
    page = F.when(F.col("url").isNotNull(), F.xxhash64(F.regexp_replace("url", r"\?.*$", "")))
    rows = k.of_address(rows.select("kind", "rec_id", "url", "own", page.alias("page"), "_bad", F.explode_outer(said).alias("t")))
    rows = rows.withColumn("frags", F.filter(F.split(F.regexp_replace("t", r"https?://\S+", " "), _SPLIT), lambda x: x.rlike(r"\S")))
    n_words = lambda x: F.regexp_count(x, F.lit(r"\p{L}{2,}"))
    single = F.size("frags") <= 1  # then the fragment is the whole
    rows = rows.select("kind", "rec_id", "url", "own", "page", "_bad", "_host", "_brand", "_slug", F.col("t").rlike(r"(?U)(?:…|\.\.\.)\s*$").alias("cut"), F.when(~single, k.mask(k.upper(F.col("t")))).alias("_m"), F.posexplode_outer("frags").alias("pos", "x"))
    rows = rows.withColumn("u", k.upper(F.col("x"))).withColumn("m", k.mask(F.col("u")))
    rows = rows.withColumn("words", k.words(F.col("u"))).withColumn("n", n_words(F.col("m"))).withColumn("whole", F.when(F.col("pos") == 0, F.coalesce("_m", "m")))
    rows = rows.withColumn("says", agree(F.col("words"), k.slug))  # what the address says is content
    low = n_words(F.col("whole")).between(least_words, most_words) & (n_words(F.col("whole")) > F.regexp_count(F.col("whole"), F.lit("[9#]"))) & ~F.col("cut") & ~own
    messages = "|".join(form(x.upper()) for x in MESSAGES)
    # a known message or status line at the beginning, and what follows it
    known, status = rf"^(?:{messages})(?:$|[ .!|]+)", rf"^[\s.!|]*(?:{_STATUS.pattern.upper()})(?:$|[ .!|–—]+)"
    asked = ~F.col("says") & (F.col("n") <= 2 * most_words)
    after = F.when(asked & F.col("m").rlike(known), F.regexp_replace("m", known, "")).when(asked & F.col("u").rlike(status), k.mask(F.regexp_replace("u", status, "")))
    latin = F.size(F.array_intersect("words", F.array(*[F.lit(x.upper()) for x in sorted(_LOREM)])))
    filler = (latin >= 4) & (latin >= 0.6 * F.size("words"))
    rows = rows.withColumn("after", after)
    rows = rows.select(
        "kind", "rec_id", "page", F.when(k.host != _NO_TEXT, F.xxhash64(k.host)).alias("host"), F.when(low, F.col("url")).alias("url"), "says",
        (F.col("_bad") | F.coalesce((F.col("after") == "") | filler, F.lit(False))).alias("bad"),
        F.when(F.col("n") > 0, F.xxhash64("m")).alias("h"), F.when(low, F.col("whole")).alias("whole"), F.when(F.col("after") != "", F.xxhash64(_stripped(F.col("after")))).alias("after"),
        F.when(~F.col("says") & F.col("n").between(2, 2 * most_words), F.col("m")).alias("m"),
    )
    rows = stage(rows, "fragments")
    learnt = stage(_learnt(rows, titles, to, least_pages, least_hosts, agreeing), "messages")
    found = rows.filter("bad").select("kind", "rec_id")
    responses = learnt.select(F.col("w").alias("_w")).distinct()
    found = found.unionAll(rows.filter("whole IS NOT NULL").join(responses, F.xxhash64("whole") == F.col("_w"), "left_semi").select("kind", "rec_id"))
    heads = learnt.filter("head IS NOT NULL").select(F.xxhash64("head").alias("_h"), F.col("head").alias("_m")).distinct()
    asked = rows.filter("NOT says")
    found = found.unionAll(asked.join(heads, F.col("h") == F.col("_h"), "left_semi").select("kind", "rec_id"))
    # a message and, after it, a piece that stands on several pages: messages meet texts by their first two words
    first = lambda c: F.xxhash64(F.substring_index(c, " ", 2))
    glued = asked.filter("m IS NOT NULL").withColumn("_k", first("m")).join(heads.withColumn("_f", first("_m")), (F.col("_k") == F.col("_f")) & F.startswith(F.col("m"), F.concat("_m", F.lit(" "))))
    glued = glued.select("kind", "rec_id", F.xxhash64(_stripped(F.substring("m", F.length("_m") + 2, F.length("m")))).alias("b"))
    glued = stage(glued.unionAll(asked.filter("after IS NOT NULL").select("kind", "rec_id", "after")), "glued")
    pieces = rows.join(glued.select(F.col("b").alias("_b")).distinct(), F.col("h") == F.col("_b"), "left_semi").select("h", "page").distinct()
    pieces = pieces.groupBy(F.col("h").alias("_p")).agg(F.count("page").alias("n")).filter(F.col("n") >= least_pages)
    found = found.unionAll(glued.join(pieces, F.col("b") == F.col("_p"), "left_semi").select("kind", "rec_id"))
    return found.distinct()


def _stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r\f\u00a0.!|–—"))


def _learnt(rows: DataFrame, titles: DataFrame | None, to: dict[str, str], least_pages: int, least_hosts: int, agreeing: float) -> DataFrame:
    """(w, head): the hashes of the responses and the fragments they begin with. Pages are counted after a map-side
    combine per text, host and page, so a text that stands on a third of all pages is no single task."""
    r = rows.filter("whole IS NOT NULL AND page IS NOT NULL").select(F.xxhash64("whole").alias("w"), "host", "page", "url", "whole", F.col("m").alias("head"))
    per_page = r.groupBy("w", "host", "page").agg(F.min("head").alias("head"))
    per_host = per_page.groupBy("w", "host").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("head"))
    often = per_host.groupBy("w").agg(F.sum("n").alias("n"), F.count("host").alias("hosts"), F.min("head").alias("head"))
    often = stage(often.filter((F.col("n") >= least_pages) & (F.col("hosts") >= least_hosts)).select(F.col("w").alias("_w"), "head"), "often")
    # only for these texts: what addresses and titles of their pages say
    here = r.join(often.select("_w"), F.col("w") == F.col("_w"), "left_semi").groupBy("w", "page").agg(F.min("url").alias("url"), F.min("whole").alias("whole"))
    k = Masks(to)
    here = k.of_address(here)
    if titles is not None:
        t = titles.select(F.xxhash64(F.regexp_replace("url", r"\?.*$", "")).alias("_page"), F.col("title").alias("_title")).filter("_page IS NOT NULL AND length(_title) > 0").groupBy("_page").agg(F.min("_title").alias("_title"))
        here = here.join(t, F.col("page") == F.col("_page"), "left")
    else:
        here = here.withColumn("_title", F.lit(None).cast("string"))
    # a title that repeats the message itself, or its beginning, is no second voice
    mine, title = k.words(F.col("whole")), k.words(k.mask(k.upper(F.coalesce("_title", F.lit("")))))
    echo = (F.size(title) > 0) & (F.size(F.array_except(title, mine)) == 0)
    voices = F.when(echo, k.slug).otherwise(F.array_union(k.slug, title))
    here = here.select("w", (F.size(voices) > 0).cast("int").alias("heard"), agree(mine, voices).cast("int").alias("yes"))
    says = here.groupBy("w").agg(F.sum("heard").alias("heard"), F.sum("yes").alias("yes"))
    out = says.filter(F.col("yes") <= agreeing * F.greatest(F.col("heard"), F.lit(1)) - 1e-9).select("w")
    return out.join(often, F.col("w") == F.col("_w")).select("w", "head")
