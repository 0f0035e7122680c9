"""A tamper-evident chain of runs: digests and verification in parallel, appending as a fold per chain."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators.ordered import blocks

GENESIS = "0" * 64


def evidence_digest(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, evidence_digest): SHA-256 over the run's sorted (field, value, backend, selector, content hash) rows as
    JSON; the evidence of a fact is its smallest evidence id. Runs without facts are missing."""
    f = facts.select("run_id", "fact_id", "field", F.coalesce("value", F.lit("None")).alias("value"), F.array_min("evidence_ids").alias("_e")).distinct()
    # several rows of one evidence id: the smallest, so that a digest is the same in every run
    e = evidence.groupBy(F.col("run_id").alias("_run"), "evidence_id").agg(F.min(F.struct("extraction_backend", "selector", "content_hash")).alias("_x")).select("_run", "evidence_id", "_x.*")
    rows = f.join(e, (F.col("_e") == F.col("evidence_id")) & (F.col("run_id") == F.col("_run")), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.array(F.coalesce("field", F.lit("")), "value", blank("extraction_backend"), blank("selector"), blank("content_hash"))

    @F.arrow_udf("string")
    def digest(x: pa.Array) -> pa.Array:
        return pa.array(["sha256:" + hashlib.sha256(json.dumps(sorted(r), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in x.to_pylist()])

    return rows.groupBy("run_id").agg(F.collect_list(row).alias("r")).select("run_id", digest("r").alias("evidence_digest"))


def canonical(entry: dict) -> bytes:
    """Sorted keys, compact, without hash and signature."""
    core = {k: v for k, v in entry.items() if k not in ("hash", "signature")}
    return json.dumps(core, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def entry_hash(entry: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical(entry)).hexdigest()


def hash_column(fields: list[str]) -> Column:
    """`entry_hash` of rows, as a Column: the same function that `append` calls, so both escape alike."""

    @F.arrow_udf("string")
    def own(rows: pa.Array) -> pa.Array:
        return pa.array([entry_hash({c: "" if v is None else v for c, v in r.items()}) for r in rows.to_pylist()], pa.string())

    return own(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]))


def append(entries: DataFrame, chain_id: str, seq: str, fields: list[str], heads: dict | None = None) -> DataFrame:
    """entries with prev_hash and hash. A link needs its predecessor's hash, so a chain is folded in order in one task;
    there are as many parallel folds as chains, and a fold holds one entry at a time (sorted iteration, no gathering). A log
    that outgrows one task is to be kept as one chain per shard and day, with `heads` carrying the last hash of each."""
    heads = heads or {}
    cols = list(dict.fromkeys([chain_id, seq, *fields]))

    def fold(batches):
        head: dict = {}
        for b in batches:
            prev, own = [], []
            for r in b.to_pylist():
                k = r[chain_id]
                p = head.get(k, heads.get(k, GENESIS))
                h = entry_hash({c: "" if r[c] is None else str(r[c]) for c in fields} | {"prev_hash": p})
                prev.append(p)
                own.append(h)
                head = {k: h}  # a partition is sorted by chain, so one head suffices
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], [*b.schema.names, "prev_hash", "hash"])

    schema = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in cols) + ", prev_hash string, hash string"
    ordered = entries.select(*cols).repartition(F.col(chain_id)).sortWithinPartitions(chain_id, seq)
    return ordered.mapInArrow(fold, schema)


def verify(chain: DataFrame, chain_id: str, seq: str, fields: list[str]) -> DataFrame:
    """(chain, ok, verified, error) per chain: the entries before the first one whose link or hash is wrong.

    The chain is sorted over the cluster in blocks, so a chain with most entries spreads over many tasks: an entry's
    predecessor is the row before it in its block, or the last row of the chain's block before, of which there is one per
    chain and block. The first error is an aggregate."""
    b = blocks(chain.select(chain_id, seq, "prev_hash", "hash", hash_column([*fields, "prev_hash"]).alias("_own")), [chain_id], [F.col(seq), F.col("hash")])
    ends = b.groupBy(F.col(chain_id).alias("_c"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct(seq, "hash")).alias("_last"))
    earlier = W.partitionBy("_c").orderBy("_b")
    ends = ends.withColumn("_off", F.coalesce(F.sum("_k").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_link", F.coalesce(F.lag("_last.hash").over(earlier), F.lit(GENESIS)))
    here = W.partitionBy("_block", chain_id).orderBy(seq, "hash")
    c = b.withColumn("_i", F.row_number().over(here)).withColumn("_lag", F.lag("hash").over(here))
    c = c.join(ends.select("_c", "_b", "_off", "_link"), F.col(chain_id).eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    wrong = F.when(F.col("prev_hash") != F.when(F.col("_i") == 1, F.col("_link")).otherwise(F.col("_lag")), "broken link").when(F.col("hash") != F.col("_own"), "hash mismatch")
    c = c.select(chain_id, (F.col("_off") + F.col("_i")).alias("_n"), F.when(F.col("prev_hash").isNull() | F.col("hash").isNull(), "malformed").otherwise(wrong).alias("_wrong"))
    g = c.groupBy(chain_id).agg(F.count(F.lit(1)).alias("_all"), F.min(F.when(F.col("_wrong").isNotNull(), F.struct("_n", "_wrong"))).alias("_e"))
    return g.select(chain_id, F.col("_e").isNull().alias("ok"), F.coalesce(F.col("_e._n") - 1, F.col("_all")).cast("bigint").alias("verified"), F.col("_e._wrong").alias("error"))
