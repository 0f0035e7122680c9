"""Run metrics, telemetry reports and evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import text as tx
from factloom.operators.ordered import ranked

LOCAL = ["L0", "L1", "L2"]
BROWSER = ["L3", "L4"]


def rate(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def run_metrics(runs: DataFrame, facts: DataFrame, n_fields: int) -> DataFrame:
    """Per run: facts per asked field (raw and capped), and whether it did without browser and model."""
    n = facts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_facts"))
    r = runs.join(n, "run_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    share = F.col("n_facts") / n_fields
    return r.select(
        "run_id", "n_facts", F.round(share, 4).alias("completeness"), F.round(F.least(share, F.lit(1.0)), 4).alias("completeness_capped"),
        F.coalesce((F.col("level") == "L1") & F.col("status").isin("success", "partial"), F.lit(False)).alias("deterministic"),
        F.coalesce(F.col("level").isin(*LOCAL), F.lit(False)).alias("no_browser"), F.coalesce(F.col("level").isin("L0", "L1"), F.lit(False)).alias("no_model"), "bytes_downloaded",
    )


def picked(df: DataFrame, value: str, id_: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(n * share) of the sorted values, found by distributed ranks: no list of all
    values is ever built. An empty table gives no row."""
    rows, parts = ranked(df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.col(id_).alias("_id")), [], [F.col("_v"), F.col("_id")])
    n = parts.agg(F.sum("_n").alias("_all")).filter("_all > 0")
    at = n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.least(F.floor(F.col("_all") * s), F.col("_all") - 1).alias("_at")) for s in shares])).alias("t")).select("t.*")
    return rows.join(F.broadcast(at), F.col("_rank") == F.col("_at")).select("share", F.col("_v").alias("value"))


def overview(runs: DataFrame) -> DataFrame:
    """One row of rates over all runs."""
    s = F.coalesce(F.col("status"), F.lit("unknown"))
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.round(rate(s == "success"), 4).alias("success_rate"), F.round(rate(s == "partial"), 4).alias("partial_rate"), F.round(rate(s == "failed"), 4).alias("failure_rate"),
        F.round(F.avg("bytes_downloaded"), 2).alias("avg_bytes"), F.round(rate(F.coalesce(F.col("level").isin(*BROWSER), F.lit(False))), 4).alias("browser_fallback_rate"),
    )


def economics(runs: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: avoidance of browser and model, and coverage of facts by evidence, by run and by fact."""
    model = F.coalesce(F.col("warnings").contains("l2_llm_fill") | F.col("warnings").contains("l2_failed"), F.lit(False))
    browser = F.coalesce(F.col("level").isin(*BROWSER), F.lit(False))
    r = runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(browser).alias("browser_runs"), F.count_if(model).alias("llm_runs"))
    f = facts.agg(F.count(F.lit(1)).alias("facts_total"), F.count_if(F.size("evidence_ids") > 0).alias("facts_with_ids"))
    c = facts.join(evidence.select("run_id").distinct(), "run_id", "left_semi").agg(F.count(F.lit(1)).alias("facts_with_evidence"))
    x = r.withColumns({"facts_total": f.select("facts_total").scalar(), "facts_with_ids": f.select("facts_with_ids").scalar(), "facts_with_evidence": c.scalar()})
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 3)
    return x.select(
        "total_runs", "browser_runs", "llm_runs", (1 - part("browser_runs", "total_runs")).alias("browser_avoidance_rate"), (1 - part("llm_runs", "total_runs")).alias("llm_avoidance_rate"),
        "facts_total", "facts_with_evidence", part("facts_with_evidence", "facts_total").alias("provenance_coverage"), part("facts_with_ids", "facts_total").alias("fact_coverage"),
    )


def histogram(runs: DataFrame) -> DataFrame:
    """(level, status, runs) with totals per level and of all in one pass; null keys are `unknown`, totals `all`."""
    k = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("level", "status")]
    g = runs.select(*k).rollup("level", "status").agg(F.count(F.lit(1)).alias("runs"))
    return g.select(*[F.coalesce(F.col(c), F.lit("all")).alias(c) for c in ("level", "status")], "runs")


def warning_counts(runs: DataFrame, prefix: str | None = None) -> DataFrame:
    """(warning, runs) of the warnings' kinds (the part before the first colon), or of whole warnings with a prefix."""
    w = runs.select(F.explode(F.from_json("warnings", "array<string>")).alias("w"))
    w = w.filter(F.col("w").startswith(prefix)).withColumn("warning", F.col("w")) if prefix else w.withColumn("warning", F.substring_index("w", ":", 1))
    return w.groupBy("warning").agg(F.count(F.lit(1)).alias("runs"))


def method_stats(facts: DataFrame) -> DataFrame:
    """Per method: facts, distinct fields, mean of the valid confidences, summed as decimals: the same in whatever order."""
    ok = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return facts.groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("field").alias("fields"), F.round(F.try_divide(F.sum(ok.cast("decimal(20,10)")).cast("double"), F.count(ok)), 6).alias("mean_confidence"))


def scores(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Per item: tp, fp, fn by the strength of the rules, and fields nobody asked for. rules: item_id, field, kind and the
    typed rule columns; facts: item_id, field, value. Asked and found fields meet in one full outer join."""
    f = facts.select(F.col("item_id").alias("_i"), F.col("field").alias("_f"), "value")
    j = rules.join(f, (F.col("item_id") == F.col("_i")) & (F.col("field") == F.col("_f")), "full_outer")
    asked = F.col("item_id").isNotNull()
    ok = tx.rule_holds(F.col("kind"), F.col("value"), F.col("equals"), F.col("contains"), F.col("in_set"), F.col("lo"), F.col("hi"), F.col("min_len"))
    found = F.col("value").isNotNull()
    return j.select(
        F.coalesce("item_id", "_i").alias("item_id"), F.when(asked, tx.rule_strength(F.col("kind"))).otherwise("extra").alias("strength"),
        (asked & found & ok).cast("int").alias("tp"), (asked & found & ~ok).cast("int").alias("fp"), (asked & ~found).cast("int").alias("fn"), (~asked).cast("int").alias("extra"),
    ).groupBy("item_id", "strength").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "extra")])


def summary(per_item: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the precision that counts unasked fields, per strength and overall, in one rollup."""
    g = per_item.rollup("strength").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "extra")], F.countDistinct("item_id").alias("items"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, extra = (F.col(c) for c in ("tp", "fp", "fn", "extra"))
    return g.select(
        F.coalesce("strength", F.lit("all")).alias("strength"), "items", "tp", "fp", "fn", "extra", F.round(div(tp, tp + fp), 6).alias("precision"), F.round(div(tp, tp + fn), 6).alias("recall"),
        F.round(div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(div(tp, tp + fp + extra), 6).alias("effective_precision"),
    )


def completeness(items: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Share of required fields that were found, per class and overall. items: item_id, class, field, optional."""
    need = items.filter(~F.col("optional")).select("item_id", F.col(by), "field")
    f = facts.filter(F.length(F.trim("value")) > 0).select(F.col("item_id").alias("_i"), F.col("field").alias("_f")).distinct()
    j = need.join(f, (F.col("item_id") == F.col("_i")) & (F.col("field") == F.col("_f")), "left")
    g = j.rollup(by).agg(F.count(F.lit(1)).alias("required"), F.count("_f").alias("found"), F.countDistinct("item_id").alias("items"))
    return g.select(F.coalesce(F.col(by), F.lit("all")).alias(by), "items", "required", "found", F.round(F.col("found") / F.col("required"), 6).alias("completeness"))


def compare_arms(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: means of two arms over the same items, their difference, wins, losses and ties."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    d = F.signum(F.col("_a") - F.col("_b"))
    return j.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("_a"), 6).alias("mean_a"), F.round(F.avg("_b"), 6).alias("mean_b"), F.round(F.avg("_a") - F.avg("_b"), 6).alias("delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def evidence_validity(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, facts, valid): facts whose every cited evidence exists in the same run; facts citing nothing are not valid."""
    cited = facts.select("run_id", "fact_id", F.explode_outer("evidence_ids").alias("_e"))
    e = evidence.select(F.col("run_id").alias("_r"), F.col("evidence_id").alias("_i")).distinct()
    j = cited.join(e, (F.col("run_id") == F.col("_r")) & (F.col("_e") == F.col("_i")), "left")
    per = j.groupBy("run_id", "fact_id").agg(F.bool_and(F.col("_i").isNotNull()).alias("_ok"))
    return per.groupBy("run_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if("_ok").alias("valid"))


def verdicts(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with a person's decision: accepted, rejected, edited (value replaced) or skipped where there is none."""
    d = decisions.select(*keys, F.col("verdict").alias("_v"), F.col("edited_value").alias("_e"))
    j = candidates.join(d, keys, "left")
    return j.withColumn("verdict", F.coalesce("_v", F.lit("skipped"))).withColumn("value", F.when(F.col("_v") == "edited", F.col("_e")).otherwise(F.col("value"))).drop("_v", "_e")


def recent_change(runs: DataFrame, key: str, signature: str, at: str) -> DataFrame:
    """Runs whose signature differs from the one before at the same address, runs without time first. Neighbours come from
    distributed ranks and an equi-join, so an address with most of the runs is no single task."""
    rows, _ = ranked(runs.filter(F.col(key).isNotNull()), [key], [F.col(at).asc_nulls_first(), F.col("run_id")])
    before = rows.select(F.col(key).alias("_k"), (F.col("_rank") + 1).alias("_r"), F.col(signature).alias("previous_signature"))
    j = rows.join(before, (F.col(key) == F.col("_k")) & (F.col("_rank") == F.col("_r")))
    return j.filter(F.col("previous_signature") != F.col(signature)).drop("_k", "_r", "_rank", "_block")


def class_precision(rules: DataFrame, facts: DataFrame, latency: DataFrame, by: str) -> DataFrame:
    """Per class: items, asked and matched values, precision and two latencies (the values at half and at 95 % of the sorted
    list). rules and facts as in `scores`; latency: item_id, class, latency_ms. Latencies come from distributed ranks."""
    s = scores(rules, facts).groupBy("item_id").agg(F.sum("tp").alias("tp"), (F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("asked"))
    items = latency.select("item_id", F.coalesce(by, F.lit("unknown")).alias(by), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))
    g = items.join(s, "item_id").groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.sum("tp").alias("correct"), F.sum("asked").alias("asked"))
    rows, parts = ranked(items.join(s.select("item_id"), "item_id", "left_semi"), [by], [F.col("latency_ms"), F.col("item_id")])
    n = parts.groupBy(F.col(by).alias("_c")).agg(F.sum("_n").alias("_all"))
    at = lambda share: F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
    picks = rows.join(n, F.col(by) == F.col("_c")).groupBy(F.col(by).alias("_c")).agg(*[F.max(F.when(F.col("_rank") == at(q), F.col("latency_ms"))).alias(name) for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95))])
    return g.join(picks, F.col(by) == F.col("_c")).select(by, "items", "asked", "correct", F.round(F.coalesce(F.try_divide("correct", "asked"), F.lit(0.0)), 6).alias("precision"), "p50_ms", "p95_ms")
