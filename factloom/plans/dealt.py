"""Queries of the general data-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.timestamps import instant_classes, normalise_timestamps, same_instant_pairs
from factloom.sources.tables import table


def time_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of kind time with page, locale and zone of their run, repeated rows as often as they are stored. The alias table
    is fixed and small."""
    alias = table(spark, d, "field_aliases").filter(F.col("kind") == "time").select("field", "canonical_field")
    runs = table(spark, d, "runs").select("run_id", "normalized_url", "locale", "timezone")
    facts = table(spark, d, "facts").select("run_id", "fact_id", "field", "value", "source_id")
    return facts.join(alias, "field").join(runs, "run_id").select("fact_id", "normalized_url", "canonical_field", "source_id", "value", "locale", "timezone")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    facts = time_facts(spark, d).filter(F.col("normalized_url").isNotNull() & F.col("value").isNotNull())
    done = normalise_timestamps(facts).filter(F.col("ts_status") == "resolved")
    return same_instant_pairs(done, ["normalized_url", "canonical_field"], "fact_id").select(F.col("a").alias("fact_a"), F.col("b").alias("fact_b"))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    """One row per fact of kind time: the instant, or why there is none; local times that occur twice keep both readings."""
    done = normalise_timestamps(time_facts(spark, d), twice=True)
    options = F.array_join(F.transform("ts_options", lambda x: F.unix_micros(x).cast("string")), ",").alias("options_us")
    return done.select("fact_id", "value", F.col("ts_utc"), "ts_status", "ts_reading", F.round("ts_posterior", 6).alias("ts_posterior"), options).distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """For each fact with an instant the class of facts of its page and field that name the same one, and its links."""
    facts = time_facts(spark, d).filter(F.col("normalized_url").isNotNull() & F.col("value").isNotNull())
    done = normalise_timestamps(facts).filter(F.col("ts_status") == "resolved")
    return instant_classes(done, ["normalized_url", "canonical_field"], "fact_id")


#: Values of fixed forms, which SQL can read too: ISO dates with clock and, if any, `Z` or an offset; no zone of the run.
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def p3_iso(spark: SparkSession, d: str) -> DataFrame:
    """The instants of all values that are written in the ISO form with a zone."""
    done = normalise_timestamps(time_facts(spark, d).filter(F.col("value").rlike(_ISO)))
    return done.filter("ts_status = 'resolved'").select("fact_id", F.unix_micros("ts_utc").alias("us")).distinct()


QUERIES = {"p3_found": p3_found, "p3_normalised": p3_normalised, "p3_classes": p3_classes, "p3_iso": p3_iso}
SQL: dict[str, str] = {
    "p3_iso": f"""SELECT DISTINCT f.fact_id, epoch_us(TRY_CAST(f.value AS TIMESTAMPTZ)) AS us FROM facts f JOIN field_aliases a ON a.field = f.field AND a.kind = 'time' JOIN (SELECT DISTINCT run_id FROM runs) r USING (run_id)
 WHERE regexp_matches(f.value, '{_ISO}') AND TRY_CAST(f.value AS TIMESTAMPTZ) IS NOT NULL"""
}
