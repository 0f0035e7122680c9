"""The same operators over unbounded tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import signature as sg


def runs_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Stored runs as they arrive, from a folder of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(runs: DataFrame, keys: list[str], at: str = "retrieved_at", late: str = "1 hour") -> DataFrame:
    """Each key once: repeated crawls of unchanged content pass only the first time within the watermark."""
    return runs.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def telemetry(runs: DataFrame, at: str = "retrieved_at", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs, failures and latency per level and window; rows later than the watermark are left out."""
    w = runs.withWatermark(at, late).groupBy(F.window(at, window), "level")
    return w.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg("latency_ms").alias("mean_ms")).select("window.start", "window.end", "level", "runs", "failed", "mean_ms")


def cached_runs(runs: DataFrame, ttl_s: int = 3600, late: str = "1 day") -> DataFrame:
    """(key, run_id, hit, cached_run): a run is a hit if one with the same key was seen within the ttl. The state is one time
    stamp and id per key; it leaves when the watermark passes its ttl, and runs later than the watermark are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, run = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "run_id"]).itertuples():
            hit = at is not None and r.at - at <= ttl_s
            out.append((key[0], r.run_id, bool(hit), run if hit else None))
            if not hit:
                at, run = int(r.at), r.run_id
        state.update((at, run))
        state.setTimeoutTimestamp(max((at + ttl_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "run_id", "hit", "cached_run"])

    rows = runs.withWatermark("retrieved_at", late).select(F.concat_ws("|", "normalized_url", "schema_hash", "content_signature").alias("key"), "run_id", "retrieved_at", F.unix_timestamp("retrieved_at").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, run_id string, hit boolean, cached_run string", "at bigint, run string", "append", "EventTimeTimeout")


def page_signatures(pages: DataFrame, page: str = "text") -> DataFrame:
    """Signatures of pages as they arrive: stateless."""
    return pages.withColumn("signature", sg.signature(F.col(page)))


def append_to(stream: DataFrame, path: str, checkpoint: str, by: str | None = None):
    """Start an append-only parquet sink."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.partitionBy(by) if by else w).trigger(availableNow=True).start()


def materialised(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The state of an aggregate over all input so far, as a table: every micro-batch appends the groups it changed with its
    number to a parquet folder; of each group the last batch counts. Nothing passes through the driver."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/_batch_no={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(add).trigger(availableNow=True).start()
    q.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = spark.read.schema(f"{fields}, _batch bigint").option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    rest = [c for c in stream.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}") for c in rest])


def upsert_each(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Start a sink that merges each micro-batch by a function of (batch, id); ids make repeated batches harmless."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
