"""Mixing sources to target weights, by Pfair scheduling.

The quotas follow from the sources' token sums: the total is the largest that all sources with texts can follow at their
target weights without a text being used more often than allowed. A source's texts are drawn in passes in a fixed random
order. The draws of a source are cut into blocks of equal size; block k of a source of weight w is released at k / w and due at
(k + 1) / w, and earliest deadline first orders the blocks, so at every moment each source has received its share of
the stream to within less than one block.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from factloom.operators.ordered import ranked


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, dict]:
    """{source: weight, quota, ...}. Weights are the targets of the sources that have tokens, scaled to 1. total None:
    as much as all of them can follow. With a larger total, sources at their cap give what is missing to the others in
    proportion to their weights."""
    have = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    scale = sum(w for w, _ in have.values())
    cap = {s: available[s] * r for s, (_, r) in have.items()}
    weight = {s: w / scale for s, (w, _) in have.items()}
    if not have:
        total = 0
    elif total is None:
        total = int(min(cap[s] / weight[s] for s in have))
    quota = dict.fromkeys(have, 0.0)
    open_, left = set(have), float(min(total, sum(cap.values()))) if have else 0.0
    while open_ and left > 1e-9:
        share = sum(weight[s] for s in open_)
        full = {s for s in open_ if quota[s] + left * weight[s] / share >= cap[s]}
        if not full:
            for s in open_:
                quota[s] += left * weight[s] / share
            break
        for s in full:
            left -= cap[s] - quota[s]
            quota[s] = float(cap[s])
        open_ -= full
    return {s: {"weight": weight[s], "quota": int(quota[s]), "capped": s not in open_ and quota[s] >= cap[s]} for s in have}


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of the blocks {source: number}: earliest deadline first among the released ones. Weights are the sources'
    shares of all blocks."""
    n = sum(blocks.values())
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]  # (release, source, k)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * n // blocks[s]), s, k))
        if not ready:  # cannot happen while the shares sum to one; then the next release comes early
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * n // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * n // blocks[s], s, k + 1))
    return out


def mix(docs: DataFrame, targets: DataFrame, id_: str, source: str, size: str, total: int | None = None, block_tokens: int = 4096, most_blocks: int = 262_144, seed: int = 0, most_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(draws, shares). draws: (slot, place, source, pass, id, tokens): slot is the block's place in the stream, place the
    first token of the text within its block, so (slot, place) orders the whole stream; passes count from 0. shares: per
    target source the target and reached share, tokens, draws, and whether its cap limits it.

    docs holds an id once; repeated ids are texts of their own. Sources without target, null sources and texts without
    tokens are not drawn; a target without texts is reported with share 0. total: tokens of the whole stream; None is the most
    that every source with texts can follow, a larger one fills up capped sources from the others. block_tokens: the size of a
    block, larger only where the stream would have more than most_blocks, whose order is planned on the driver and
    broadcast. most_sources bounds the table of targets, which is held on the
    driver; texts are only aggregated, ranked and joined."""
    known = targets.select("source", "target_share", "max_repeats").distinct().limit(most_sources + 1).collect()
    if len(known) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in known if r["source"] is not None}
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in want], "source string")
    d = docs.filter(F.col(size) > 0).select(F.col(source).alias("source"), F.col(id_).alias("_id"), F.col(size).cast("bigint").alias("_size")).join(F.broadcast(names), "source", "left_semi")
    rows, parts = ranked(d, ["source"], [F.xxhash64(F.col("_id"), F.lit(seed)), F.col("_id")], size="_size")
    available = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("_sum").alias("n")).collect()}
    plan = quotas(available, want, total)
    all_tokens = sum(p["quota"] for p in plan.values())
    block = max(1, block_tokens, -(-all_tokens // most_blocks))
    order = schedule({s: -(-p["quota"] // block) for s, p in plan.items()})
    kind = T.StructType([T.StructField("_s", T.StringType()), T.StructField("_have", T.LongType()), T.StructField("_quota", T.LongType())])
    q = spark.createDataFrame([(s, available[s], p["quota"]) for s, p in plan.items()], kind)
    slots = spark.createDataFrame([(s, k, i) for i, (s, k) in enumerate(order)], "_bs string, _bk bigint, slot bigint")
    rows = rows.join(F.broadcast(q), F.col("source") == F.col("_s"))
    # a text is drawn in a pass if the quota covers more than half of it
    reach = F.floor((F.col("_quota") - F.col("_before") - F.col("_size") / 2) / F.col("_have"))
    rows = rows.withColumn("_last", reach.cast("int")).filter("_last >= 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    at = F.least(F.col("pass").cast("bigint") * F.col("_have") + F.col("_before"), F.col("_quota") - 1)
    rows = rows.withColumn("_k", F.floor(at / block)).join(F.broadcast(slots), (F.col("source") == F.col("_bs")) & (F.col("_k") == F.col("_bk")))
    draws = rows.select("slot", (at - F.col("_k") * block).alias("place"), "source", "pass", F.col("_id").alias(id_), F.col("_size").alias("tokens"))
    said = spark.createDataFrame([(s, w, r, s in plan and plan[s]["capped"], s in plan) for s, (w, r) in want.items()], "source string, target_share double, max_repeats int, capped boolean, has_texts boolean")
    got = draws.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("draws"), F.max("pass").alias("_p"))
    got = got.withColumn("_all", F.sum("tokens").over(W.partitionBy()))  # a row per source
    shares = said.join(got, "source", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = shares.select("source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("_all"), 6), F.lit(0.0)).alias("reached_share"), z("tokens").alias("tokens"), z("draws").alias("draws"), F.coalesce(F.col("_p") + 1, F.lit(0)).alias("repeats"), "max_repeats", "capped", "has_texts")
    return draws, shares
