"""Exact percentiles per group over a distributed sort.

All rows are sorted by value across the cluster (range partitions with a unique tie-breaker, so a value that holds a third
of the rows spreads over many tasks). Per-partition counts per cell give the offset of every partition, target
positions are located from the offsets alone, and only the neighbouring order statistics are read. The error is zero.
`partial_counts` is a part that can be stored: how often each value of a group stands in a day or a partition. Parts add up,
and `combined_percentiles` finds the positions in the sum, without the rows and with error zero; where values are
rounded first, by a stated step, a part holds a bounded number of rows and the error is half a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.ordered import blocks, ranked


def measured(value) -> F.Column:
    """Whether a latency was measured: not null, not NaN, not negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def exact_percentiles(df: DataFrame, group: list[str], value: str, id_: str, quantiles: list[float]) -> DataFrame:
    """(group, quantile, n, value): the quantiles of each group, interpolated linearly between neighbouring order
    statistics. Unmeasured values are left out; null group keys form groups of their own; a group without measured
    values has no row; an empty table gives an empty result. Rows with equal id count as often as they stand there."""
    rows = df.filter(measured(F.col(value))).select(*group, F.col(value).cast("double").alias("_v"), F.col(id_).alias("_id"))
    rows, parts = ranked(rows, group, [F.col("_v"), F.col("_id")])
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("quantile")
    n = parts.groupBy(*group).agg(F.sum("_n").alias("n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "n", q)
    pos = F.col("quantile") * (F.col("n") - 1)
    n = n.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos))))).withColumn("_pos", pos)
    on = F.col("_rank") == F.col("_at")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    near = rows.join(n, on)
    weight = 1 - F.abs(F.col("_pos") - F.col("_at"))
    return near.groupBy(*group, "quantile", "n").agg(F.sum(F.col("_v") * weight).alias("value"))


def partial_counts(df: DataFrame, group: list[str], value: str, step: float | None = None) -> DataFrame:
    """(group, value, n) of the measured values of one part (a day, a partition, a table), to be stored and added to others.
    step: values are rounded to multiples of it, which bounds a part's rows by (range / step) per group and the error of
    every percentile by step / 2; None keeps the values and the error zero. Combined map-side. Null group keys form groups of
    their own; an empty table gives an empty part."""
    v = F.col(value).cast("double")
    return df.filter(measured(F.col(value))).groupBy(*group, (v if step is None else F.round(v / step) * step).alias(value)).agg(F.count(F.lit(1)).alias("n"))


def combined_percentiles(parts: DataFrame, group: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(group, quantile, n, value) as `exact_percentiles`, from the union of stored parts. Equal values of all parts are added
    first; running counts come from the distributed sort of the distinct values, so a group of any size spreads over tasks.
    Repeated parts count as often as they stand there."""
    c = parts.groupBy(*group, F.col(value).alias("_v")).agg(F.sum("n").cast("bigint").alias("_w"))
    rows, sums = ranked(c, group, [F.col("_v")], size="_w")
    n = sums.groupBy(*group).agg(F.sum("_sum").alias("n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "n", F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("quantile"))
    n = n.withColumn("_pos", F.col("quantile") * (F.col("n") - 1))
    n = n.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    on = (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_w"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    near = rows.join(n, on)
    return near.groupBy(*group, "quantile", "n").agg(F.sum(F.col("_v") * (1 - F.abs(F.col("_pos") - F.col("_at")))).alias("value"))


def interval_shares(df: DataFrame, claims: DataFrame, value: str, id_: str, day: str, keys: list[str]) -> DataFrame:
    """For each claim (claim_id, keys with null for any, day_from, day_to, claimed_ms) over its group of rows: `n`, the
    numbers of rows `below` and `upto` (at or below) the claimed value. Claims whose group is empty have no row.

    Partitions that lie wholly on one side of the claimed value count by their cell counts; rows are read only of the
    partitions that hold the value between their ends."""
    cell = [*keys, day]
    rows = blocks(df.filter(measured(F.col(value))).select(*cell, F.col(value).cast("double").alias("_v"), F.col(id_).alias("_id")), [], [F.col("_v"), F.col("_id")])
    parts = rows.groupBy("_block", *cell).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    c = claims.select("claim_id", *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("day_from").cast("date").alias("_from"), F.col("day_to").cast("date").alias("_to"), F.col("claimed_ms").cast("double").alias("_claimed"))
    inside = (F.col("_from").isNull() | (F.col(day) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(day) <= F.col("_to")))

    def matched(x: DataFrame, extra: list | None = None) -> DataFrame:
        """x with its claims: each row stands for its own keys and for any, so the join is one of equal keys."""
        for i, k in enumerate(keys):
            x = x.withColumn(f"_x{i}", F.explode(F.array_distinct(F.array(F.col(k), F.lit(None).cast("string")))))
        on = [F.col(f"_x{i}").eqNullSafe(F.col(f"_c{i}")) for i in range(len(keys))]
        return x.join(c, [*on, inside, *(extra or [])])

    at = matched(parts)
    sums = at.groupBy("claim_id").agg(F.sum("_n").alias("n"))
    # a cell's end that equals the claim is neither wholly below nor above: its rows are read, too
    ends = (F.col("_lo") <= F.col("_claimed")) & (F.col("_hi") >= F.col("_claimed")) & (F.col("_lo") < F.col("_hi"))
    look = at.filter(ends).select("claim_id", "_claimed", F.col("_block").alias("_bb"), *[F.col(k).alias(f"_r{i}") for i, k in enumerate(cell)])
    same = F.col("_block") == F.col("_bb")
    for i, k in enumerate(cell):
        same &= F.col(k).eqNullSafe(F.col(f"_r{i}"))
    seen = rows.join(look, same).groupBy("claim_id").agg(F.count_if(F.col("_v") < F.col("_claimed")).alias("_b2"), F.count_if(F.col("_v") <= F.col("_claimed")).alias("_u2"))
    whole = at.filter(~ends).groupBy("claim_id").agg(F.coalesce(F.sum(F.when(F.col("_hi") < F.col("_claimed"), F.col("_n"))), F.lit(0)).alias("_b1"), F.coalesce(F.sum(F.when(F.col("_hi") <= F.col("_claimed"), F.col("_n"))), F.lit(0)).alias("_u1"))
    out = sums.join(whole, "claim_id", "left").join(seen, "claim_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select("claim_id", "n", (z("_b1") + z("_b2")).alias("below"), (z("_u1") + z("_u2")).alias("upto"))


def wrong_claims(df: DataFrame, claims: DataFrame, value: str, id_: str, day: str, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """Ids of the claims whose quantile lies more than `tolerance` outside [share below, share at or below]."""
    s = interval_shares(df, claims, value, id_, day, keys).join(claims.select("claim_id", "quantile"), "claim_id")
    low, high = F.col("below") / F.col("n") - tolerance, F.col("upto") / F.col("n") + tolerance
    return s.filter((F.col("quantile") < low) | (F.col("quantile") > high)).select("claim_id")
