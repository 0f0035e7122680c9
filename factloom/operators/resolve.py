"""From candidates to facts: gap filling, aliases, confidence, conflicts, missing fields, status, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions import signature as sg, text as tx

# The rank of methods in conflicts.
METHOD_RANK = {"json_ld": 3, "meta_og": 2, "trafilatura": 2, "main_text": 2, "css_selector": 1, "url_derived": 0, "price_regex": 0}
ALIASES = [("date", "publish_date"), ("publish_date", "date"), ("title", "name"), ("name", "title"), ("main_text", "description")]


def method_rank(method: Column) -> Column:
    out = F.lit(0)
    for m, r in METHOD_RANK.items():
        out = F.when(method == m, r).otherwise(out)
    return out


def fill_gaps(candidates: DataFrame, id_: str = "page_id") -> DataFrame:
    """Keep each field's earliest stage; the structured stages 0 and 1 may both speak. One window per page and field."""
    first = F.min("stage").over(W.partitionBy(id_, "field"))
    return candidates.withColumn("_first", first).filter((F.col("stage") <= 1) | (F.col("stage") == F.col("_first"))).drop("_first")


def add_aliases(facts: DataFrame, fields: list[str], id_: str = "page_id", most: int | None = None) -> DataFrame:
    """Copies for asked fields that are missing: date and publish_date, title and name, the text's first paragraph as
    description (all of it, or its first `most` characters). Built from one aggregate per page, not a self-join."""
    wanted = [(a, b) for a, b in ALIASES if b in fields]
    if not wanted:
        return facts
    keep = F.struct(*[c for c in facts.columns if c != id_])
    first = [F.min(F.when(F.col("field") == a, F.struct("stage", "seq", keep.alias("k")))).alias(f"_{a}") for a in dict.fromkeys(a for a, _ in wanted)]
    per = facts.groupBy(id_).agg(F.collect_set("field").alias("_have"), *first)
    made = []
    for a, b in wanted:
        s = F.col(f"_{a}.k")
        text = F.trim(s["value"])
        lead = F.trim(F.split(text, "\n\n")[0])
        chunk = F.when(F.length(lead) < 40, text).otherwise(lead)
        value = (chunk if most is None else F.left(chunk, F.lit(most))) if a == "main_text" else s["value"]
        conf = F.least(s["confidence"], F.lit(0.72)) if a == "main_text" else s["confidence"]
        method = F.lit("main_text_alias") if a == "main_text" else s["method"]
        row = F.struct(*[{"field": F.lit(b), "value": value, "confidence": F.round(conf * 0.95, 3), "method": method}.get(c, s[c]).alias(c) for c in facts.columns if c != id_])
        made.append(F.when(~F.array_contains("_have", b) & F.col(f"_{a}").isNotNull(), row))
    new = per.select(id_, F.explode(F.array_compact(F.array(*made))).alias("x")).select(id_, "x.*")
    return facts.unionByName(new.select(*facts.columns))


def add_availability(facts: DataFrame, fields: list[str], id_: str = "page_id") -> DataFrame:
    """For product pages with a price and no availability, when it is asked for: in stock, with low confidence."""
    if "availability" not in fields:
        return facts
    price = facts.filter((F.col("field") == "price") & (F.col("tactic") == "product"))
    price = price.withColumn("_n", F.row_number().over(W.partitionBy(id_).orderBy("stage", "seq"))).filter("_n = 1").drop("_n")
    new = price.join(facts.filter("field = 'availability'").select(id_), id_, "left_anti")
    made = {"field": "availability", "value": "true", "method": "url_derived", "confidence": 0.55, "selector": "heuristic::availability_from_price", "backend": "L1_heuristic", "datatype": "boolean"}
    return facts.unionByName(new.select(*[F.lit(made[c]).alias(c) if c in made else F.col(c) for c in facts.columns]))


def scaled(facts: DataFrame) -> DataFrame:
    return facts.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") * F.col("scale")), 3))


def title_score(value: Column, method: Column, confidence: Column) -> Column:
    """How much a text looks like this page's title."""
    n = F.length(value)
    return (
        method_rank(method)
        + confidence
        - F.when(tx.weak_title(value), 5.0).otherwise(0.0)
        + F.when(n.between(20, 160), 0.8).when(n.between(3, 80), 0.3).otherwise(0.0)
        + F.when(value.rlike(r"^\p{Lu}"), 0.2).otherwise(0.0)
        + F.when(method.isin("meta_og", "og_manual", "css_selector", "css"), 0.5).otherwise(0.0)
        - F.when(method.isin("json-ld", "microdata") & (n < 20), 0.4).otherwise(0.0)
    )


def resolve(facts: DataFrame, id_: str = "page_id", policy: str = "method_priority_then_confidence", losers: bool = True) -> DataFrame:
    """One fact per page and field. Weak titles leave if a better one is there; then titles go by score, other fields by
    method and confidence (policy `highest_confidence`: by confidence alone); `seq` breaks ties.

    losers: also `conflict_values`, what was beaten, in order. A single window ranks; the losers need a second aggregate of
    the page's own candidates, of which a page has a few dozen."""
    naming = F.col("field").isin("title", "name")
    weak = naming & tx.weak_title(F.col("value"))
    by_field = W.partitionBy(id_, "field")
    f = facts.withColumn("_weak", weak).withColumn("_good", F.max(~F.col("_weak")).over(by_field)).filter(~F.col("_weak") | ~F.col("_good"))
    score = F.when(naming, title_score(F.col("value"), F.col("method"), F.col("confidence"))).otherwise(F.lit(0.0) if policy == "highest_confidence" else method_rank(F.col("method")).cast("double"))
    order = [F.col("_score").desc(), F.col("confidence").desc(), F.col("seq")]
    f = f.withColumn("_score", score).withColumn("_n", F.row_number().over(by_field.orderBy(*order)))
    if not losers:
        return f.filter("_n = 1").drop("_weak", "_good", "_score", "_n")
    keep = [c for c in facts.columns if c not in (id_, "field")]
    one = F.struct("_n", F.col("value").alias("value"), F.col("method").alias("method"), F.col("confidence").alias("confidence"))
    g = f.groupBy(id_, "field").agg(F.min_by(F.struct(*keep), "_n").alias("_w"), F.array_sort(F.collect_list(one)).alias("_all"))
    rest = F.transform(F.filter("_all", lambda x: x["_n"] > 1), lambda x: F.struct(x["value"].alias("value"), x["method"].alias("method"), x["confidence"].alias("confidence")))
    name = F.when(F.size("_all") > 1, F.when(naming, "title_quality_then_method").otherwise(policy))
    return g.select(id_, "field", "_w.*", rest.alias("conflict_values"), name.alias("policy"))


def missing(pages: DataFrame, facts: DataFrame, fields: dict[str, dict], id_: str = "page_id") -> DataFrame:
    """(id, missing, required_missing, n_facts): one aggregate of the facts joined to the pages; no cross product."""
    have = facts.groupBy(id_).agg(F.collect_set("field").alias("_have"), F.count(F.lit(1)).alias("n_facts"))
    every = F.array(*[F.lit(x) for x in fields])
    need = F.array(*[F.lit(x) for x, s in fields.items() if not s.get("optional")]).cast("array<string>")
    got = F.coalesce(F.col("_have"), F.array().cast("array<string>"))
    j = pages.select(id_).join(have, id_, "left")
    return j.select(id_, F.array_except(every, got).alias("missing"), F.array_except(need, got).alias("required_missing"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def status(bot_wall: Column, n_missing: Column, n_facts: Column) -> Column:
    return F.when(bot_wall, "failed").when((n_missing == 0) & (n_facts > 0), "success").when(n_facts > 0, "partial").otherwise("unresolved")


def without_challenge(facts: DataFrame, walls: DataFrame, id_: str = "page_id") -> DataFrame:
    """facts without the titles that challenge pages show: on pages in `walls` weak names and titles leave."""
    weak = F.col("field").isin("title", "name") & tx.weak_title(F.col("value"))
    marked = facts.join(walls.select(F.col(id_).alias("_wall")).distinct(), F.col(id_) == F.col("_wall"), "left")
    return marked.filter(F.col("_wall").isNull() | ~weak).drop("_wall")


def normalised(facts: DataFrame) -> DataFrame:
    """facts with the values of availability and currency in their one form, other texts without stray white space."""
    value = F.when(F.col("field") == "availability", tx.availability(F.col("value"))).when(F.col("field") == "currency", tx.currency_code(F.col("value"))).when(F.col("field") == "main_text", F.col("value")).otherwise(F.trim("value"))
    return facts.withColumn("value", value)


def validated(facts: DataFrame) -> DataFrame:
    """facts with `validation_status` and a datatype that agrees with the value: a number that cannot be read as one becomes a
    string; blank values and flags that are none are invalid; what came from embedded state or a model is unverified."""
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    no_number = F.col("datatype").isin("number", "integer") & tx.price_number(F.col("value")).isNull()
    no_flag = (F.col("datatype") == "boolean") & ~F.coalesce(F.lower("value").isin("true", "false"), F.lit(False))
    state = F.when(blank | no_flag, "invalid").when(F.col("method").isin("embedded_state", "llm_fill"), "unverified").otherwise("valid")
    return facts.withColumn("validation_status", state).withColumn("datatype", F.when(no_number, "string").otherwise(F.col("datatype")))


def failure_reason(error: Column, message: Column) -> Column:
    """An acquisition error, by its name and message, as a short reason."""
    low = F.lower(F.coalesce(message, F.lit("")))
    policy = F.when(low.contains("robots"), "robots_disallowed").when(low.contains("mime"), "wrong_mime_type").when(low.contains("max_bytes"), "no_html:too_large").when(low.rlike("private|blocked"), "policy_blocked")
    return (
        F.when(error.contains("Policy"), F.coalesce(policy, F.concat(F.lit("policy_error: "), F.coalesce(message, F.lit("")))))
        .when(error.isin("ConnectError", "ConnectTimeout", "ReadTimeout", "TimeoutException", "TimeoutError"), "no_html:timeout")
        .when(error == "HTTPStatusError", "no_html:http_error")
        .when(low.contains("max_bytes"), "no_html:too_large")
        .when(error.isNotNull(), F.concat(error, F.lit(": "), F.coalesce(message, F.lit(""))))
    )


def predicted_confidence(sig: Column) -> Column:
    """How far an extraction without a browser is trusted before any decision."""
    return F.when(sig["likely_spa"] | sig["browser_hint"], 0.3).otherwise(0.8)


def should_escalate(route_: Column) -> Column:
    return route_["backend"] == "L3_browser"


def run_warnings(sig: Column, n: dict[str, Column]) -> Column:
    """What a run has to say, in a fixed order. sig: a signature; n: tactic, browser_hint, missing, filled (fields that a model
    gave), route and, of the response, header (a header profile) and canonical; each may be a null of its type."""
    say = lambda tag, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(tag), x))
    listed = lambda x: F.array_join(x, ",")
    h = n["header"]
    return F.array_compact(
        F.array(
            F.when(sig["likely_spa"], "likely_spa: low confidence in L1 extraction"),
            F.when(sig["has_jsonld"], "jsonld_detected"),
            say("generator:", sig["generator"]),
            say("cdn:", h["cdn"]),
            say("frameworks:", listed(sig["frameworks"])),
            say("embedded:", listed(sig["embedded_blobs"])),
            F.when(h["static_hint"], "static_hint:cache_hit"),
            say("etag:", h["etag"]),
            F.when(sig["tracker_count"] > 0, F.concat(F.lit("trackers:"), sig["tracker_count"].cast("string"))),
            say("spa_score:", sig["spa_score"].cast("string")),
            say("canonical:", n["canonical"]),
            say("ab_cookies:", listed(h["ab_cookies"])),
            say("page_class:", sig["page_class"]),
            say("tactic:", n["tactic"]),
            F.when(n["browser_hint"], F.concat(F.lit("needs_browser:"), n["tactic"], F.lit("_low_yield"))),
            F.when(sig["bot_wall"], "bot_wall_detected"),
            F.when(~sig["bot_wall"] & (F.size(n["missing"]) > 0), F.concat(F.lit("missing_fields: "), F.array_join(n["missing"], ", "))),
            F.when(F.size(n["filled"]) > 0, F.concat(F.lit("l2_llm_fill:+"), F.array_join(n["filled"], ", "))),
            F.concat(F.lit("route:"), n["route"]["backend"], F.lit(":"), n["route"]["reason"]),
        )
    )


def route(mode: Column, rule: Column, failure: Column, missing_: Column, sig: Column, tactic: Column, host: Column) -> Column:
    """struct(backend, confidence, reason): the first rule that fires."""

    def to(backend, confidence: float, reason) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(backend).alias("backend"), F.lit(confidence).alias("confidence"), as_col(reason).alias("reason"))

    any_missing = F.size(missing_) > 0
    hinted = tactic.isin(*[k for k, p in sg.PROFILES.items() if p[1]])
    web_, http = "L3_browser", "L1_http"
    return (
        F.when(mode == "http", to(http, 1.0, "mode=http"))
        .when(rule == web_, to(web_, 0.9, F.concat(F.lit("domain_rule:"), host)))
        .when(rule.isNotNull(), to(rule, 0.7, F.concat(F.lit("domain_rule:"), host)))
        .when(mode == "browser", to(web_, 1.0, "mode=browser"))
        .when(failure == "bot_wall", to(web_, 0.95, "bot_wall"))
        .when(failure.startswith("needs_browser"), to(web_, 0.9, F.concat(F.lit("failure:"), failure)))
        .when(any_missing & sig["browser_hint"], to(web_, 0.85, "browser_hint+missing"))
        .when(F.array_contains(missing_, "price") & (sig["spa_score"] >= 0.5), to(web_, 0.8, "price_missing+spa_score"))
        .when(any_missing & sig["likely_spa"] & (mode == "auto"), to(web_, 0.75, "likely_spa+missing"))
        .when(hinted, to(http, 0.55, F.concat(F.lit("tactic:"), tactic, F.lit(":browser_hint"))))
        .when(tactic == "docs", to(http, 0.9, "tactic:docs"))
        .otherwise(to(http, 0.7, F.concat(F.lit("tactic:"), tactic)))
    )


def value_warnings(field: Column, value: Column) -> Column:
    """What is odd about a value: an array of short reasons, empty if nothing."""
    n = tx.price_number(value)
    price = field == "price"
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(value), F.lit("")) == "", "empty"),
            F.when(price & n.isNull(), "no_number"),
            F.when(price & (n <= 0), "not_positive"),
            F.when(price & (n > 1_000_000), "very_high"),
            F.when((field == "currency") & ~F.coalesce(value.rlike(r"^[A-Z]{3}$"), F.lit(False)), "no_code"),
            F.when((field == "availability") & ~F.coalesce(tx.availability(value).isin("true", "false", "preorder"), F.lit(False)), "unknown_word"),
            F.when(field.isin("title", "name") & tx.weak_title(value), "weak_title"),
        )
    )


def auto_truth(claims: DataFrame, key: list[str], least: float = 0.5, value: str = "value", rank: str = "source_rank") -> DataFrame:
    """Consensus values whose agreement reaches `least`, with their warnings; the last key column is the field."""
    c = consensus(claims, key, value, rank).filter(F.col("agreement") >= least)
    return c.withColumn("warnings", value_warnings(F.col(key[-1]), F.col(value)))


def candidate_map(facts: DataFrame, id_: str = "page_id") -> DataFrame:
    """(id, candidates): field to value of each page's facts."""
    one = facts.groupBy(id_, "field").agg(F.min_by("value", "seq").alias("value")) if "seq" in facts.columns else facts.groupBy(id_, "field").agg(F.min("value").alias("value"))
    return one.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("candidates"))


def consensus(claims: DataFrame, key: list[str], value: str = "value", rank: str = "source_rank") -> DataFrame:
    """The most frequent value per key, case aside; ties go to the best-ranked source. Adds votes, agreement and the
    number of distinct values."""
    per = claims.filter(F.col(value).isNotNull()).groupBy(*key, F.lower(F.trim(value)).alias("_v")).agg(F.count(F.lit(1)).alias("votes"), F.min(rank).alias("_r"), F.min_by(value, rank).alias(value))
    w = W.partitionBy(*key)
    best = per.withColumn("_n", F.row_number().over(w.orderBy(F.desc("votes"), "_r", "_v"))).withColumn("_all", F.sum("votes").over(w)).withColumn("distinct_values", F.count(F.lit(1)).over(w))
    return best.filter("_n = 1").select(*key, value, "votes", F.round(F.col("votes") / F.col("_all"), 3).alias("agreement"), "distinct_values")
