"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import signature
from factloom.llm import lookalike, mainbody, mixing, packing, percentiles, repetition, residue, survivor, tokens
from factloom.session import stage
from factloom.sources.tables import table

# -- 1: best representative ------------------------------------------------------------------------------------------


def claims_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Facts with the page and time of their run, canonical field and trust. Aliases and trust are fixed small tables."""
    alias = table(spark, d, "field_aliases").select("field", "canonical_field")
    trust = table(spark, d, "method_trust")
    runs = table(spark, d, "runs").select("run_id", "normalized_url", "retrieved_at").filter(F.col("normalized_url").isNotNull())
    facts = table(spark, d, "facts").select("run_id", "fact_id", "field", "value", "confidence", "extraction_method")
    return facts.join(alias, "field").join(trust, "extraction_method", "left").join(runs, "run_id")


def p1_method(spark: SparkSession, d: str) -> DataFrame:
    return survivor.latest_values(claims_of_pages(spark, d), "normalized_url", "canonical_field", "value", "retrieved_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of_pages(spark, d)
    return survivor.best_facts(c, ["normalized_url", "canonical_field"], "fact_id", "value", "trust", "confidence", "retrieved_at").select("fact_id")


P1_SQL = r"""
WITH c AS (
  SELECT DISTINCT r.normalized_url AS u, a.canonical_field AS k, f.fact_id, f.value, coalesce(t.trust, 0) AS trust,
         CASE WHEN f.confidence BETWEEN 0 AND 1 THEN f.confidence ELSE -1 END AS conf, r.retrieved_at AS ts
  FROM facts f JOIN field_aliases a ON a.field = f.field
  JOIN (SELECT DISTINCT run_id, normalized_url, retrieved_at FROM runs) r ON r.run_id = f.run_id
  LEFT JOIN method_trust t ON t.extraction_method = f.extraction_method
), g AS (SELECT u, k FROM c GROUP BY u, k HAVING count(DISTINCT fact_id) > 1),
o AS (
  SELECT c.fact_id, row_number() OVER (PARTITION BY c.u, c.k ORDER BY
    CASE WHEN regexp_matches(c.value, '(…|\.\.\.)$') THEN 1 ELSE 0 END, trust DESC, conf DESC, ts DESC NULLS LAST, fact_id) AS n
  FROM c JOIN g ON g.u = c.u AND g.k = c.k
  WHERE c.value IS NOT NULL AND NOT regexp_full_match(c.value, '[\s\p{Z}]*')
) SELECT fact_id FROM o WHERE n = 1
"""

# -- 4: percentiles --------------------------------------------------------------------------------------------------


def measured_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").select("run_id", "level", "status", "latency_ms", "retrieved_at").distinct()
    # UTC days, whatever the session's zone
    return runs.withColumn("day", F.date_from_unix_date(F.floor(F.unix_micros("retrieved_at") / 86_400_000_000).cast("int")))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles.exact_percentiles(measured_runs(spark, d), ["level", "status"], "latency_ms", "run_id", [0.5, 0.9, 0.95, 0.99])
    return p.select("level", "status", "quantile", "n", F.round("value", 4).alias("latency_ms"))


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles from parts, one per day, that were stored and put together."""
    days = stage(percentiles.partial_counts(measured_runs(spark, d), ["level", "status", "day"], "latency_ms"), "parts")
    p = percentiles.combined_percentiles(days, ["level", "status"], "latency_ms", [0.5, 0.9, 0.95, 0.99])
    return p.select("level", "status", "quantile", "n", F.round("value", 4).alias("latency_ms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.wrong_claims(measured_runs(spark, d), table(spark, d, "latency_claims"), "latency_ms", "run_id", "day", ["level", "status"])


P4_RUNS = "(SELECT DISTINCT run_id, level, status, latency_ms, CAST(retrieved_at AT TIME ZONE 'UTC' AS DATE) AS day FROM runs WHERE latency_ms >= 0 AND NOT isnan(latency_ms))"
P4_SQL = f"""
SELECT level, status, quantile, count(*) AS n, round(quantile_cont(latency_ms, quantile), 4) AS latency_ms
FROM {P4_RUNS} r JOIN (VALUES (0.5), (0.9), (0.95), (0.99)) AS q(quantile) ON true GROUP BY level, status, quantile
"""
P4_SQL = "SELECT level, status, CAST(quantile AS DOUBLE) AS quantile, n, latency_ms FROM (" + " UNION ALL ".join(f"SELECT level, status, {q} AS quantile, count(*) AS n, round(quantile_cont(latency_ms, {q}), 4) AS latency_ms FROM {P4_RUNS} r GROUP BY level, status" for q in (0.5, 0.9, 0.95, 0.99)) + ")"
P4_FOUND_SQL = f"""
WITH s AS (
  SELECT c.claim_id, c.quantile, avg(CASE WHEN r.latency_ms < c.claimed_ms THEN 1.0 ELSE 0 END) AS lo, avg(CASE WHEN r.latency_ms <= c.claimed_ms THEN 1.0 ELSE 0 END) AS hi
  FROM latency_claims c JOIN {P4_RUNS} r ON (c.level IS NULL OR c.level = r.level) AND (c.status IS NULL OR c.status = r.status)
   AND (c.day_from IS NULL OR r.day >= CAST(c.day_from AS DATE)) AND (c.day_to IS NULL OR r.day <= CAST(c.day_to AS DATE))
  GROUP BY c.claim_id, c.quantile
) SELECT claim_id FROM s WHERE quantile < lo - 0.02 OR quantile > hi + 0.02
"""

# -- 6: look-alike texts ---------------------------------------------------------------------------------------------


def texts_to_compare(spark: SparkSession, d: str) -> DataFrame:
    """kind, scope (run and field), key, text: values of text facts and evidence texts."""
    alias = table(spark, d, "field_aliases").filter(F.col("kind") == "text").select("field")
    f = table(spark, d, "facts").join(alias, "field", "left_semi").select(F.lit("fact").alias("kind"), "run_id", "field", F.col("fact_id").alias("key"), F.col("value").alias("text"))
    e = table(spark, d, "evidence").select(F.lit("evidence").alias("kind"), "run_id", F.lit("").alias("field"), F.col("evidence_id").alias("key"), F.col("evidence_text").alias("text"))
    return f.unionAll(e).filter(F.col("text").isNotNull())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = lookalike.consistent_form(texts_to_compare(spark, d), "text")
    pairs = [lookalike.same_look_pairs(t.filter(F.col("kind") == k), ["run_id", "field"], "key", "text").select(F.lit(k).alias("kind"), "key_a", "key_b") for k in ("fact", "evidence")]
    return pairs[0].unionAll(pairs[1])


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each fact or evidence with a look-alike in its scope: its class and its number of links."""
    t = lookalike.consistent_form(texts_to_compare(spark, d), "text")
    return lookalike.same_look_classes(t, ["kind", "run_id", "field"], "key", "text")


# -- 9: repetition ---------------------------------------------------------------------------------------------------


def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    return repetition.line_first(distinct_documents(spark, d), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(distinct_documents(spark, d), "doc_id", "text").filter(F.col("share") >= 0.3).select("doc_id").distinct()


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(distinct_documents(spark, d), "doc_id", "text").withColumn("share", F.round("share", 6))


P9_SHARES = r"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
g AS (SELECT id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
r AS (SELECT id, i, min(i) OVER (PARTITION BY id, k) AS f FROM g),
c AS (SELECT id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2), (3), (4)) AS t(j) WHERE i > f GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_repeated, coalesce(n, 0) / greatest(len(ws), 1) AS share FROM w LEFT JOIN c USING (id)
"""
P9_METHOD_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT row_number() OVER () AS id, * FROM d),
l AS (SELECT id, regexp_replace(unnest(string_split(text, chr(10))), '[\s\p{Z}]+$', '') AS x FROM n), f AS (SELECT id, x, len(regexp_extract_all(x, '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS w FROM l WHERE trim(x) <> ''),
k AS (SELECT id, x, min(w) AS w, count(*) AS times, regexp_replace(lower(trim(x)), '[0-9]+', '9', 'g') AS h FROM f GROUP BY id, x),
b AS (SELECT h FROM (SELECT DISTINCT id, h FROM k) GROUP BY h HAVING count(*) >= 5 AND count(*) >= 0.0005 * (SELECT count(DISTINCT id) FROM k)),
ok AS (SELECT id, count(*) AS n_kept, sum(w) AS n_words_kept FROM k WHERE h NOT IN (SELECT h FROM b)
  AND NOT (w < 3 AND NOT regexp_matches(x, '[.!?…:;»”"。！？]$') AND NOT regexp_matches(x, '^(\s{4}|\t)')) AND NOT regexp_matches(x, '^[^|·»/>]*([|·»]|[\s\p{Z}][/>][\s\p{Z}])[^|·»/>]*([|·»]|[\s\p{Z}][/>][\s\p{Z}])') GROUP BY id),
t AS (SELECT id, count(*) AS n_lines, sum(w) AS n_words FROM f GROUP BY id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_kept, 0) AS INT) AS n_kept, CAST(coalesce(n_words, 0) AS INT) AS n_words, CAST(coalesce(n_words_kept, 0) AS INT) AS n_words_kept,
 CASE WHEN n_words > 0 THEN round(1 - coalesce(n_words_kept, 0) / n_words, 6) ELSE 0.0 END AS lost, coalesce(CASE WHEN n_words > 0 THEN 1 - coalesce(n_words_kept, 0) / n_words ELSE 0.0 END > 0.3, false) AS rejected
FROM n LEFT JOIN t USING (id) LEFT JOIN ok USING (id)
"""

QUERIES = {
    "p1_method": p1_method,
    "p1_found": p1_found,
    "p4_percentiles": p4_percentiles,
    "p4_combined": p4_combined,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p9_method": p9_method,
    "p9_found": p9_found,
    "p9_repetition": p9_repetition,
}
SQL: dict[str, str] = {"p1_found": P1_SQL, "p4_percentiles": P4_SQL, "p4_combined": P4_SQL, "p4_found": P4_FOUND_SQL, "p9_method": P9_METHOD_SQL}
SQL["p9_repetition"] = f"SELECT doc_id, n_words, n_repeated, round(share, 6) AS share FROM ({P9_SHARES})"
SQL["p9_found"] = f"SELECT DISTINCT doc_id FROM ({P9_SHARES}) WHERE share >= 0.3"

# -- 5: residue ------------------------------------------------------------------------------------------------------


def records_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Evidence texts, and the status and each warning of the runs, with the address of their page."""
    runs = table(spark, d, "runs").select("run_id", "normalized_url", "status", "warnings")
    e = table(spark, d, "evidence").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("rec_id"), F.col("source_url").alias("url"), F.lit(False).alias("own"), F.col("evidence_text").alias("text"))
    said = F.coalesce(F.from_json("warnings", "array<string>"), F.array("warnings"))
    r = runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("rec_id"), F.col("normalized_url").alias("url"), F.lit(True).alias("own"), F.explode(F.concat(F.array("status"), F.coalesce(said, F.array()))).alias("text"))
    return e.unionAll(r)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetched_documents").select("url", signature.title_guess(F.col("text")).alias("title"))
    return residue.residue(records_with_text(spark, d), pages)


QUERIES["p5_found"] = p5_found

# -- 2: main body ----------------------------------------------------------------------------------------------------


def texts_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages and evidence texts of two or more lines."""
    p = table(spark, d, "fetched_documents").select(F.lit("page").alias("src"), F.col("page_id").cast("string").alias("rec_id"), "url", "text", F.lit(True).alias("page"))
    e = table(spark, d, "evidence").filter(F.instr("evidence_text", "\n") > 0)
    e = e.select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("rec_id"), F.col("source_url").alias("url"), F.col("evidence_text").alias("text"), F.lit(False).alias("page"))
    return p.unionAll(e)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_body(texts_of_pages(spark, d)).distinct()


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """Wrapper induction alone over the whole table: texts without containers are aligned as sequences of lines."""
    return mainbody.main_body(texts_of_pages(spark, d), plain_rule=False).distinct()


QUERIES |= {"p2_method": p2_method, "p2_found": p2_found}

# -- 7: packing ------------------------------------------------------------------------------------------------------


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their token counts, each once, written once for both uses of the counts."""
    n = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", ("source",))
    return stage(n.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "tokens")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(counted(spark, d), table(spark, d, "pack_sizes"), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d), table(spark, d, "pack_sizes"))


# -- 8: mixing -------------------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix with as many tokens as the corpus has: sources at their cap are filled up by the others."""
    n = counted(spark, d)
    total = n.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    return mixing.mix(n, table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens", total=total)


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mix in which every source with texts keeps its target."""
    return mixing.mix(counted(spark, d), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")[1]


QUERIES |= {"p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_exact": p8_exact}
