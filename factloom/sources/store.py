"""The run store: tables, upserts, look-ups, snapshots, schemas and policies."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from factloom.functions import web

RUNS = "run_id string, url string, normalized_url string, schema_hash string, level string, status string, latency_ms double, bytes_downloaded bigint, content_hash string, content_signature string, retrieved_at timestamp, missing_fields string, warnings string, payload string"
FACTS = "run_id string, fact_id string, field string, value string, datatype string, confidence double, extraction_method string, validation_status string, payload string"
EVIDENCE = "run_id string, evidence_id string, source_id string, source_url string, evidence_text string, selector string, content_hash string, content_signature string, retrieved_at timestamp, extraction_backend string, payload string"


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables of runs, facts and evidence in a folder; those that are there stay as they are."""
    for name, schema in (("runs", RUNS), ("facts", FACTS), ("evidence", EVIDENCE)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")


def hash_json(x) -> str:
    """First 16 hex digits of the SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str, changed: list[str] | None = None) -> DataFrame:
    """stored with new rows merged in, one row per key: the latest by `order` wins; with `changed`, only these columns are
    updated and the others keep the earliest value. One shuffle on the keys."""
    both = stored.unionByName(new, allowMissingColumns=True)
    if changed is None:
        n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        return both.withColumn("_n", n).filter("_n = 1").drop("_n")
    rest = [c for c in both.columns if c not in keys]
    pick = [(F.max_by if c in changed or c == order else F.min_by)(c, order).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*pick)


def frozen(df: DataFrame) -> DataFrame:
    """df as it is now: its list of files is taken once, so rows that others append later are not read, in however many queries
    it is used. For tables of files that are only added to."""
    files = df.inputFiles()
    return df.sparkSession.read.schema(df.schema).parquet(*files) if files else df.limit(0)


def save(df: DataFrame, path: str, by: str | None = None, mode: str = "append", key: list[str] | None = None) -> None:
    """Write a table as parquet, partitioned by a column of few values where one is given. key: rows are range-partitioned and
    sorted by these columns, so that look-ups by key read few files and row groups."""
    if key:
        df = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in key]).sortWithinPartitions(*key)
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).parquet(path)


def by_url(runs: DataFrame, url: str | Column, limit: int = 10) -> DataFrame:
    """The latest runs of an address, a text or a scalar subquery: the filter reaches the scan, the limit is a top-k."""
    return runs.filter(F.col("normalized_url") == url).orderBy(F.desc_nulls_last("retrieved_at"), "run_id").limit(limit)


def by_signature(runs: DataFrame, signature: str | Column) -> DataFrame:
    return runs.filter(F.col("content_signature") == signature).orderBy(F.desc_nulls_last("retrieved_at"), "run_id")


def by_id(runs: DataFrame, run_id: str | Column) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def latest_per_url(runs: DataFrame, k: int) -> DataFrame:
    """The latest k runs of every address."""
    w = W.partitionBy("normalized_url").orderBy(F.desc_nulls_last("retrieved_at"), "run_id")
    return runs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def save_snapshots(shots: DataFrame, path: str) -> None:
    """Snapshots by the first four digits of their hash."""
    shots.withColumn("shard", F.substring("hash", 8, 4)).write.mode("append").partitionBy("shard").parquet(path)


def load_snapshot(spark: SparkSession, path: str, hash_: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("shard") == hash_[7:11]) & (F.col("hash") == hash_))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def record_fallbacks(routes: DataFrame, path: str) -> None:
    """Append the decisions that left the plain backend as JSON lines: time, host, asked and chosen backend, reason."""
    f = routes.filter(F.col("route.backend") != "L1_http")
    f.select(F.current_timestamp().alias("ts"), web.site(F.col("url")).alias("host"), F.lit("L1_http").alias("attempted"), F.col("route.backend").alias("actual"), F.col("route.reason").alias("reason")).write.mode("append").json(path)


def fallbacks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "ts timestamp, host string, attempted string, actual string, reason string")


def cache_key(url: Column, schema_hash: Column, signature: Column, etag: Column | None = None) -> Column:
    return F.concat_ws("|", url, schema_hash, signature, *([etag] if etag is not None else []))


def cached(requests: DataFrame, runs: DataFrame, keys: list[str], at: str = "requested_at", seen: str = "retrieved_at", ttl_s: int = 3600) -> DataFrame:
    """requests with the latest usable run of the same key that is no older than the ttl (`cached_run`, null if none).
    An interval join as equi-join on the key plus time bounds: both sides are cut into buckets of the ttl, so a key with
    many runs meets only those of two buckets; the latest is an aggregate."""
    r = runs.filter(F.col("status").isin("success", "partial") & F.col(seen).isNotNull())
    r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(seen).alias("_seen"), F.col("run_id").alias("_run"))
    r = r.withColumn("_bucket", F.explode(F.array(*[F.floor(F.unix_timestamp("_seen") / ttl_s) + i for i in (0, 1)])))
    q = requests.withColumn("_b", F.floor(F.unix_timestamp(at) / ttl_s))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_b") == F.col("_bucket"), F.col("_seen") <= F.col(at), F.unix_timestamp(at) - F.unix_timestamp("_seen") <= ttl_s]
    j = q.join(r, on, "left")
    g = j.groupBy(*requests.columns).agg(F.max_by("_run", F.struct("_seen", "_run")).alias("cached_run"), F.max("_seen").alias("cached_at"))
    return g


@dataclass(frozen=True)
class TrustedPolicy:
    """Which domains may be asked, and named schemas. Without a file everything is allowed (version `none`)."""

    version: str = "none"
    allow_domains: tuple[str, ...] = ("*",)
    schemas: dict = field(default_factory=dict)
    strict: bool = False

    @staticmethod
    def load(path: str | None) -> TrustedPolicy:
        if not path or not Path(path).exists():
            return TrustedPolicy()
        x = json.loads(Path(path).read_text())
        return TrustedPolicy(str(x.get("version", "none")), tuple(x.get("allow_domains", ("*",))), x.get("schemas", {}), bool(x.get("strict", False)))

    def hash(self) -> str:
        x = {"version": self.version, "allow_domains": list(self.allow_domains), "schemas": self.schemas, "strict": self.strict}
        return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def schema_for(self, preset: str) -> dict:
        if preset not in self.schemas:
            raise KeyError(f"unknown preset {preset}")
        return self.schemas[preset]

    def allowed(self, url: Column) -> Column:
        """Exact hosts, `*.suffix` (not its apex), or everything."""
        h = web.host(url)
        ok = F.lit("*" in self.allow_domains)
        for d in self.allow_domains:
            if d.startswith("*."):
                ok = ok | h.endswith(d[1:].lower())
            elif d != "*":
                ok = ok | (h == d.lower())
        return F.coalesce(ok, F.lit(False))


def allowed_join(urls: DataFrame, domains: DataFrame, url: str = "url", pattern: str = "pattern", most: int = 100_000) -> DataFrame:
    """Rows whose host matches a table of patterns: exact by equi-join, `*.suffix` by equi-join on every suffix of the host,
    so there is no nested loop however long the table is. A pattern `*` lets all pass."""
    h = urls.withColumn("_host", web.host(F.col(url))).withColumn("_row", F.monotonically_increasing_id())
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = h.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array("_host"), suffixes, F.array(F.lit("*"))))))
    d = domains.select(F.lower(F.col(pattern)).alias("_p")).distinct()
    hit = keys.join(d, F.col("_key") == F.col("_p"), "left_semi")
    return hit.dropDuplicates(["_row"]).drop("_host", "_row", "_key")
