"""One surviving record per group of duplicates.

`best_facts` is a preference order evaluated as one partial aggregate. `latest_values` is currency reasoning: transitions
between values are learnt from timestamped rows, become a partial order on the values of each group, and the
topologically latest value is taken where timestamps are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.ordered import ranked
from factloom.session import stage

BLANK = r"(?U)^\s*$"
CUT_OFF = r"(…|\.\.\.)$"


def usable(value) -> F.Column:
    """Neither null nor blank (white space of any script counts as blank)."""
    return value.isNotNull() & ~value.rlike(BLANK)


def best_facts(df: DataFrame, group: list[str], id_: str, value: str, trust: str, confidence: str, at: str) -> DataFrame:
    """The survivor's id for each group of two or more ids that has a usable value: whole before cut-off values, higher
    trust (null is 0), higher confidence (null or outside 0..1 is lowest), later `at` (null is earliest), smaller id.

    One aggregate of a few fixed-width fields per row, combined map-side, so a hot group costs what its distinct map
    partitions send. Repeated rows change nothing. Rows with a null group key form no group; an empty table gives an
    empty result; other columns are not read."""
    conf = F.when(F.col(confidence).between(0, 1) & ~F.isnan(confidence), F.col(confidence)).otherwise(-1.0)
    when = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62)))
    order = F.struct(F.col(value).rlike(CUT_OFF), -F.coalesce(F.col(trust), F.lit(0)), -conf, -when, F.col(id_).alias("id"))
    g = df.filter(F.lit(True) if not group else ~F.greatest(*[F.col(c).isNull() for c in group], F.lit(False)))
    g = g.groupBy(*group).agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi"), F.min(F.when(usable(F.col(value)), order)).alias("_best"))
    return g.filter((F.col("_lo") != F.col("_hi")) & F.col("_best").isNotNull()).select(*group, F.col("_best.id").alias(id_))


def transitions(values: DataFrame, group: str, kind: str, value: str, at: str) -> DataFrame:
    """(kind, earlier, later, n): how often, over all groups, a value was followed by another one. values: a row per
    group and value with the last time it was seen. Neighbours come from distributed ranks and an equi-join on the
    rank, so no group is gathered."""
    timed = values.filter(F.col(at).isNotNull()).select(group, F.col(kind).alias("_kind"), F.col(value).alias("_v"), F.col(at).alias("_t"))
    rows, _ = ranked(timed, [group], [F.col("_t"), F.col("_v")])
    a = rows.select(F.col(group).alias("_ga"), (F.col("_rank") + 1).alias("_ra"), F.col("_v").alias("earlier"), F.col("_t").alias("_t1"))
    b = rows.filter("_rank > 0").select(F.col(group).alias("_gb"), F.col("_rank").alias("_rb"), F.col("_kind").alias(kind), F.col("_v").alias("later"), F.col("_t").alias("_t2"))
    both = a.join(b, (F.col("_ga") == F.col("_gb")) & (F.col("_ra") == F.col("_rb")) & (F.col("_t1") < F.col("_t2")))
    return both.groupBy(kind, "earlier", "later").agg(F.count(F.lit(1)).alias("n"))


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node): the nodes that each key's seeds reach over one edge or more. seeds: key, node and, if there, `least`, the
    strength that every edge of a path must have. edges: a, b, n. Semi-naive: each round joins only what the round before
    found new, so a chain costs its length in rounds and a node is expanded once per key; cycles end by themselves."""
    keyed = "least" in seeds.columns
    rest = ["least"] if keyed else []
    strong = (F.col("n") >= F.col("least")) if keyed else F.lit(True)
    e = edges.select("a", F.col("b").alias("_to"), "n")
    step = lambda x: x.join(e, (F.col("node") == F.col("a")) & strong).select("key", F.col("_to").alias("node"), *rest).distinct()
    new = stage(step(seeds), "reach")
    seen = new
    while not new.isEmpty():
        old = seen.select(F.col("key").alias("_k"), F.col("node").alias("_n"))
        new = stage(step(new).join(old, (F.col("key") == F.col("_k")) & (F.col("node") == F.col("_n")), "left_anti"), "reach")
        seen = seen.unionAll(new)
    return seen.select("key", "node")


def _on_cycles(edges: DataFrame, most_rounds: int = 6) -> DataFrame:
    """A superset of the edges that lie on cycles: edges whose tail nothing enters or whose head nothing leaves are peeled
    off, in a few rounds. Peeling only saves work; what stays is judged exactly."""
    left = edges
    n = left.count()
    for _ in range(most_rounds):
        into, out = left.select(F.col("b").alias("_x")).distinct(), left.select(F.col("a").alias("_y")).distinct()
        left = stage(left.join(into, F.col("a") == F.col("_x"), "left_semi").join(out, F.col("b") == F.col("_y"), "left_semi"), "core")
        m = left.count()
        if m in (0, n):
            break
        n = m
    return left


def precedence(moves: DataFrame, support: int = 2) -> DataFrame:
    """The learnt order as edges (a, b, n) from an earlier to a later value: pairs seen at least `support` times more often in
    this direction than in the other, n times. Cycles are broken by the stronger evidence: an edge leaves if a path of edges
    at least as strong leads back from its head to its tail. Every cycle has a weakest edge, which the others contradict, so
    the result has no cycle, and no edge leaves but for stronger ones against it. moves: earlier, later, n."""
    pair = moves.select(F.least("earlier", "later").alias("_x"), F.greatest("earlier", "later").alias("_y"), F.when(F.col("earlier") < F.col("later"), F.col("n")).otherwise(-F.col("n")).alias("_s"))
    net = pair.groupBy("_x", "_y").agg(F.sum("_s").alias("_net")).filter((F.abs("_net") >= support) & (F.col("_x") != F.col("_y")))
    up = F.col("_net") > 0
    edges = stage(net.select(F.when(up, F.col("_x")).otherwise(F.col("_y")).alias("a"), F.when(up, F.col("_y")).otherwise(F.col("_x")).alias("b"), F.abs("_net").alias("n")), "order")
    core = _on_cycles(edges)
    if core.isEmpty():
        return edges
    # an edge asks whether its head leads back to its tail; strengths differ per edge, so the edge itself is the key
    asked = core.select(F.struct("a", "b").alias("key"), F.col("b").alias("node"), F.col("n").alias("least"))
    back = reach(asked, core).filter(F.col("node") == F.col("key.a")).select(F.col("key.a").alias("_a"), F.col("key.b").alias("_b"))
    return stage(edges.join(back, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "order")


def _marks(members: DataFrame, edges: DataFrame, pairs_up_to: int) -> DataFrame:
    """(_gu, _mv, _down, _up): which values of a group are followed by, and which follow, another value of it, over any number
    of values in between, these in the group or not. members: _g, _v, _timed. A relation counts if one of its ends has
    no time of its own.

    Values that the order does not know are left out first, then groups without a value to ask for. In a group of
    up to `pairs_up_to` such values the pairs are asked, each distinct pair once for all groups, so a value that stands
    in many groups is followed once. Larger groups are never paired: there the walk itself is kept per group."""
    ends = edges.select("a").unionAll(edges.select("b")).distinct()
    known = members.join(ends, F.col("_v") == F.col("a"), "left_semi")
    per = known.groupBy(F.col("_g").alias("_gs")).agg(F.count(F.lit(1)).alias("_k"), F.min(F.col("_timed").cast("int")).alias("_t")).filter("_k > 1 AND _t = 0")
    known = stage(known.join(per, F.col("_g") == F.col("_gs")).select("_g", "_v", "_timed", "_k"), "members")
    small, large = known.filter(F.col("_k") <= pairs_up_to), known.filter(F.col("_k") > pairs_up_to)
    # small groups
    g = small.groupBy("_g").agg(F.collect_list(F.struct("_v", "_timed")).alias("_m"))
    g = g.select("_g", F.explode("_m").alias("_s"), "_m").select("_g", "_s", F.explode(F.filter("_m", lambda x: (x["_v"] != F.col("_s._v")) & ~(x["_timed"] & F.col("_s._timed")))).alias("_t"))
    asked = stage(g.select("_g", F.col("_s._v").alias("_from"), F.col("_t._v").alias("_to")), "pairs")
    goals = asked.select("_from", "_to").distinct()
    goals = goals.join(edges.select("a").distinct(), F.col("_from") == F.col("a"), "left_semi").join(edges.select("b").distinct(), F.col("_to") == F.col("b"), "left_semi")
    goals = stage(goals, "goals")
    walked = reach(goals.select(F.col("_from").alias("key"), F.col("_from").alias("node")).distinct(), edges)
    true = goals.join(walked, (F.col("_from") == F.col("key")) & (F.col("_to") == F.col("node")), "left_semi").select(F.col("_from").alias("_f"), F.col("_to").alias("_o"))
    hit = asked.join(true, (F.col("_from") == F.col("_f")) & (F.col("_to") == F.col("_o")))
    marks = hit.select("_g", F.col("_from").alias("_v"), F.lit(1).alias("_down"), F.lit(0).alias("_up")).unionAll(hit.select("_g", "_to", F.lit(0), F.lit(1)))
    # large groups: walks per group, from timed and untimed values apart, with the order and against it
    if not large.isEmpty():
        for down, e in ((0, edges), (1, edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))):
            seen = reach(large.select(F.struct("_g", "_timed").alias("key"), F.col("_v").alias("node")), e)
            at = seen.join(large, (F.col("key._g") == F.col("_g")) & (F.col("node") == F.col("_v")) & ~(F.col("key._timed") & F.col("_timed")), "right").filter(F.col("key").isNotNull())
            marks = marks.unionAll(at.select("_g", "_v", F.lit(down), F.lit(1 - down)))
    return marks.groupBy(F.col("_g").alias("_gu"), F.col("_v").alias("_mv")).agg(F.max("_down").alias("_down"), F.max("_up").alias("_up"))


def latest_values(df: DataFrame, page: str, kind: str, value: str, at: str, support: int = 2, pairs_up_to: int = 16) -> DataFrame:
    """For each (page, kind) with a usable value the topologically latest one: `value`, `basis` and `n_values`.

    The order of a group is that of its time stamps and, where a value has none, the learnt order, closed over values in
    between. basis: `only` (one value), `timestamp` (the last one seen, and no untimed value comes after it), `precedence`
    (an untimed value that the learnt order puts after another value of the group) or `unordered` (no order reaches the
    choice: the most frequent value, then the smallest). Null or blank values and null keys are left out; repeated rows
    count once per time stamp; an empty table gives an empty result; other columns are not read. pairs_up_to changes how
    an answer is found, never the answer."""
    v = df.filter(usable(F.col(value)) & F.col(page).isNotNull() & F.col(kind).isNotNull()).groupBy(page, kind, value).agg(F.max(at).alias("_at"), F.count(F.lit(1)).alias("_n"))
    v = v.select(F.col(page).alias("_page"), F.col(kind).alias("_kind"), F.col(value).alias("_value"), F.unix_micros(F.col("_at").cast("timestamp")).alias("_at"), "_n")
    v = stage(v.withColumns({"_g": F.xxhash64("_page", "_kind"), "_v": F.xxhash64("_kind", "_value")}), "values")
    edges = precedence(stage(transitions(v.select("_g", "_kind", "_v", "_at"), "_g", "_kind", "_v", "_at"), "transitions"), support)
    marks = _marks(v.select("_g", "_v", F.col("_at").isNotNull().alias("_timed")), edges, pairs_up_to)
    rows = v.join(marks, (F.col("_g") == F.col("_gu")) & (F.col("_v") == F.col("_mv")), "left")
    # sinks first: not followed by another value; then values that are known to follow one, or the last seen
    up, down = F.coalesce(F.col("_up"), F.lit(0)), F.coalesce(F.col("_down"), F.lit(0))
    key = F.struct(
        down.alias("down"),
        (F.col("_at").isNull() & (up == 0)).cast("int").alias("loose"),
        (-up).alias("up"),
        F.coalesce(-F.col("_at"), F.lit(2**62)).alias("at"),
        (-F.col("_n")).alias("n"),
        F.col("_value").alias("value"),
    )
    best = rows.groupBy("_page", "_kind").agg(F.min(key).alias("_b"), F.count(F.lit(1)).alias("n_values"))
    basis = F.when(F.col("n_values") == 1, "only").when(F.col("_b.up") < 0, "precedence").when(F.col("_b.at") < 2**62, "timestamp").otherwise("unordered")
    return best.select(F.col("_page").alias(page), F.col("_kind").alias(kind), F.col("_b.value").alias("value"), basis.alias("basis"), "n_values")
