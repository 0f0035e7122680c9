"""Filling containers of fixed capacity with texts, whole where they fit.

What a plan needs to know of the texts is how many there are of each length, and there are at most as many lengths as the
capacity has tokens. So the histogram is aggregated over the cluster, the plan is made for it on the driver (its size
depends on the capacity, not on the number of texts), and every text finds its container from its rank among the texts of
its length: ranks come from a distributed sort, the plan's intervals from a binary search.

The plan: exact-complement hashing. For each length, largest first, the gap it leaves is looked up among single lengths,
then among pair sums, then triple sums, and combinations that fill it exactly are consumed as often as all their lengths
are available. What remains is placed by best fit, largest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.operators.ordered import ranked


class Plan:
    """Patterns (multisets of lengths) and how many containers follow each."""

    def __init__(self) -> None:
        self.patterns: list[tuple[dict[int, int], int]] = []

    def add(self, lengths: dict[int, int], times: int) -> None:
        if times:
            self.patterns.append((lengths, times))

    def containers(self) -> int:
        return sum(m for _, m in self.patterns)


def _consume(count: np.ndarray, lengths: list[int], plan: Plan) -> int:
    """Take the combination as often as it is available."""
    need: dict[int, int] = {}
    for x in lengths:
        need[x] = need.get(x, 0) + 1
    m = min(int(count[x]) // k for x, k in need.items())
    if m > 0:
        for x, k in need.items():
            count[x] -= m * k
        plan.add(need, m)
    return m


def _pair(count: np.ndarray, total: int, largest: int) -> tuple[int, int] | None:
    """The most even available pair of lengths with this sum, each at most `largest`."""
    lo = max(1, total - largest)
    hi = total // 2
    if lo > hi:
        return None
    a = np.arange(hi, lo - 1, -1)
    ok = (count[a] > 0) & (count[total - a] > (a == total - a))
    i = int(ok.argmax())
    return (int(a[i]), int(total - a[i])) if ok[i] else None


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan for histogram {length: number}; lengths are 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        if not 1 <= x <= capacity:
            raise ValueError(f"length {x} is outside 1..{capacity}")
        count[x] = n
    plan = Plan()
    plan.add({capacity: 1}, int(count[capacity]))
    count[capacity] = 0
    for first in range(capacity - 1, 0, -1):  # singles
        gap = capacity - first
        if gap <= first and count[first] and count[gap]:
            _consume(count, [first, gap], plan)
    for first in range(capacity - 2, 0, -1):  # pairs
        gap = capacity - first
        while count[first] > 0 and (p := _pair(count, gap, first)):
            if not _consume(count, [first, *p], plan):
                break
    sums = _pair_sums(count)
    for first in range(capacity - 3, 0, -1):  # triples: a length and a pair sum that complements it
        gap, at, stale = capacity - first, first, 0
        while count[first] > 0:
            second = np.arange(min(at, gap - 2), 0, -1)
            second = second[(count[second] > 0) & sums[gap - second]]
            if not len(second):
                break
            for at in map(int, second):
                while count[first] > 0 and count[at] > 0 and (p := _pair(count, gap - at, at)):
                    if not _consume(count, [first, at, *p], plan):
                        break
                stale += 1
                if count[first] <= 0 or stale >= 32:  # the index holds sums of lengths that are used up
                    break
            at -= 1
            if stale >= 32:
                sums, stale = _pair_sums(count), 0
    _best_fit(count, capacity, plan)
    return plan


def _pair_sums(count: np.ndarray) -> np.ndarray:
    """Which sums, up to the capacity, two available lengths have: the index of pairs."""
    n = 2 * len(count)
    have = np.fft.rfft((count > 0).astype(float), n)
    return np.fft.irfft(have * have, n)[: len(count)] > 0.5


def _best_fit(count: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best fit of the rest, largest first, over groups of equal containers."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: dict[int, int], m: int) -> None:
        if not m:
            return
        if gap == 0:
            plan.add(pattern, m)
        elif gap in open_:
            open_[gap].append((pattern, m))
        else:
            open_[gap] = [(pattern, m)]
            insort(gaps, gap)

    for x in range(capacity, 0, -1):
        left = int(count[x])
        while left:
            i = bisect_left(gaps, x)
            if i == len(gaps):
                per = capacity // x
                put(capacity - per * x, {x: per}, left // per)
                put(capacity - (left % per) * x, {x: left % per}, int(left % per > 0))
                left = 0
                break
            gap = gaps[i]
            pattern, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            # as many of this length as the gap takes go into each container of the group
            per = min(gap // x, max(1, left // m))
            use = min(m, left // per) if left >= per else 0
            if not use:
                per, use = left, 1
            put(gap, pattern, m - use)
            put(gap - per * x, pattern | {x: pattern.get(x, 0) + per}, use)
            left -= per * use
    for groups in open_.values():
        for pattern, m in groups:
            plan.add(pattern, m)


def intervals(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, number per container) for each length of each pattern."""
    used: dict[int, int] = {}
    out, base = [], 0
    for pattern, m in plan.patterns:
        for x, k in pattern.items():
            at = used.get(x, 0)
            out.append((x, at, at + k * m, base, k))
            used[x] = at + k * m
        base += m
    return out


def pieces(docs: DataFrame, packs: list[tuple], pack_type: str, id_: str, size: str) -> DataFrame:
    """(pack_id, id, part, first, tokens): each text once per pack, split only if it exceeds the capacity: into full
    pieces and one rest. packs: (pack_id, capacity), a few."""
    p = F.array(*[F.struct(F.lit(k).cast(pack_type).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in packs])
    rows = docs.select(F.col(id_).alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n")).withColumn("_p", F.explode(p)).select("_id", "_n", "_p.*")
    last = F.greatest(F.ceil(F.col("_n") / F.col("capacity")), F.lit(1)).cast("int") - 1
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("part") * F.col("capacity")
    return rows.select("pack_id", F.col("_id").alias(id_), "part", first.alias("first"), F.least(F.col("_n") - first, F.col("capacity")).alias("tokens"))


def pack(docs: DataFrame, packs: DataFrame, id_: str, size: str, most_packs: int = 64) -> DataFrame:
    """(pack_id, container, id, part, first, tokens). Containers count from 0 per pack; `first` is the piece's first token.

    Every row of docs is packed, repeated ids as often as they stand there; texts without tokens take no room and go into
    container 0; an empty table gives an empty result. Capacities that are null or not positive are left out; without any
    other one ValueError is raised.
    most_packs bounds the table of capacities, which is held on the driver. Packs times capacity stay below 2**62, and the
    number of distinct lengths times that of texts of one length too; beyond that ValueError is raised."""
    packs = packs.select("pack_id", "capacity_tokens").filter(F.col("capacity_tokens") > 0).distinct()
    known = packs.limit(most_packs + 1).collect()
    if len(known) > most_packs:
        raise ValueError(f"more than {most_packs} capacities")
    order = {r["pack_id"]: i for i, r in enumerate(sorted(known, key=lambda r: r["pack_id"]))}
    if len(order) < len(known):
        raise ValueError("a pack_id has two capacities")
    capacity = {r["pack_id"]: int(r["capacity_tokens"]) for r in known}
    if not known:
        raise ValueError("no capacity")
    found = pieces(docs, sorted(capacity.items()), packs.schema["pack_id"].dataType.simpleString(), id_, size)
    rows, parts = ranked(found, ["pack_id", "tokens"], [F.col(id_), F.col("part")])
    count: dict = {k: {} for k in capacity}
    for r in parts.filter("tokens > 0").groupBy("pack_id", "tokens").agg(F.sum("_n").alias("n")).collect():  # at most one row per length and pack
        count[r["pack_id"]][r["tokens"]] = r["n"]
    table = [(order[k], *i) for k, h in count.items() for i in intervals(plan_containers(h, capacity[k]))]
    table.sort()
    # one sorted key of pack and length, numbered as they occur, and rank
    widest = max([1, *capacity.values()]) + 1
    if len(order) * widest >= 2**62:
        raise ValueError("packs times capacity exceed 2**62")
    kinds, kind_of = np.unique(np.array([p * widest + x for p, x, *_ in table], np.int64), return_inverse=True)
    bits = max([1, *(t[3].bit_length() for t in table)])  # of the ranks
    if len(kinds).bit_length() + bits > 62:
        raise ValueError(f"{len(kinds)} lengths of up to 2**{bits} texts each are more than one key holds")
    key = kind_of.astype(np.int64) << bits | np.array([t[2] for t in table], np.int64)
    end, base, per, start = (np.array([t[i] for t in table], np.int64) for i in (3, 4, 5, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([order[x] for x in b.column("pack_id").to_pylist()], np.int64)
            tokens, rank = b.column("tokens").to_numpy(), b.column("_rank").to_numpy()
            box = np.zeros(len(p), np.int64)
            some = tokens > 0
            if some.any():
                i = np.searchsorted(key, (np.searchsorted(kinds, p * widest + tokens) << bits | rank)[some], "right") - 1
                assert (rank[some] < end[i]).all()
                box[some] = base[i] + (rank[some] - start[i]) // per[i]
            yield pa.record_batch([b.column("pack_id"), pa.array(box), *(b.column(c) for c in (id_, "part", "first", "tokens"))], ["pack_id", "container", id_, "part", "first", "tokens"])

    t = rows.schema
    schema = f"pack_id {t['pack_id'].dataType.simpleString()}, container bigint, `{id_}` {t[id_].dataType.simpleString()}, part int, first bigint, tokens bigint"
    return rows.select("pack_id", id_, "part", "first", "tokens", "_rank").mapInArrow(run, schema)


def fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, share of the room that is filled, and the least number that could do."""
    c = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("_t"))
    c = c.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest"))
    c = c.join(F.broadcast(packs.select("pack_id", "capacity_tokens").distinct()), "pack_id")
    return c.select("pack_id", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
