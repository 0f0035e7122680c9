"""Mixed time strings to UTC instants, by expectation-maximisation over the format mixture of each source.

Every value is read in all valid ways (functions.timeparse). Most values have one reading. For the others the rows are
counted per source by *signature*: the set of readings plus what the row itself declares (the locale's day/month order,
the run zone's offset). The signatures are a small closed vocabulary, so the counts of a source, however many rows it
has, are a few rows; EM runs over them, once per source. Its posteriors choose the reading; where the best posterior
stays below `decide`, the value is marked `ambiguous` instead of being guessed.

Defined cases: null value -> `null`; no date in it or relative -> `none`; only a day -> `day`; a date, clock or zone that
doesn't exist -> `invalid`; empty table -> empty result; null source forms a source of its own; null zone is UTC; null
locale is `default_locale`; repeated rows stay repeated. Extra columns pass through, whatever their names; columns that
bear the name of a result column are replaced.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions.timeparse import _zone, readings
from factloom.session import stage

ADDED = ("ts_utc", "ts_status", "ts_reading", "ts_posterior", "ts_options")


def _signature(found: list[tuple[str, int]], locale: str | None, tz: str | None) -> str:
    """Labels of the readings, joined; a reading that agrees with what the row declares carries `*`."""
    zone = _zone(tz) if tz else None
    out = []
    for label, us in found:
        star = False
        for part in label.split(","):
            if part in ("dmy", "mdy"):
                star = (part == "mdy") == (locale == "en-US")
            elif part.startswith("z:"):
                at = datetime.fromtimestamp(us // 1_000_000, timezone.utc)
                off = at.astimezone(zone).utcoffset().total_seconds() / 60 if zone else 0
                star = off == int(part.rsplit(":", 1)[1])
        out.append(label + "*" * star)
    return "|".join(out)


def _parser(default_locale: str, twice: bool):
    kind = pa.struct([("status", pa.string()), ("us", pa.list_(pa.int64())), ("sig", pa.string())])

    @F.arrow_udf("status string, us array<bigint>, sig string")
    def parse(value: pa.Array, locale: pa.Array, tz: pa.Array) -> pa.Array:
        memo: dict = {}
        out = []
        for key in zip(value.to_pylist(), locale.to_pylist(), tz.to_pylist()):
            if key not in memo:
                v, lo, z = key
                st, found = readings(v, z, twice)
                memo[key] = {"status": st, "us": [u for _, u in found], "sig": _signature(found, lo or default_locale, z) if found else None}
            out.append(memo[key])
        return pa.array(out, kind)

    return parse


def mixture(counts: dict[str, int], declared: float, rounds: int = 50, smooth: float = 0.5) -> dict[str, tuple[int, float]]:
    """EM over the signatures of one source: {signature: (index of the best reading, its posterior)}.
    A reading's likelihood is its label's weight in the source times `declared` or 1 - `declared`, as the row's own
    locale or zone agrees with it or not (one half where no reading does)."""
    rows = []
    for sig, n in counts.items():
        labels = sig.split("|")
        stars = [x.endswith("*") for x in labels]
        like = [(declared if s else 1 - declared) if any(stars) else 0.5 for s in stars]
        rows.append((sig, n, [x.rstrip("*") for x in labels], like))
    names = sorted({x for _, _, ls, _ in rows for x in ls})
    weight = {x: 1 / len(names) for x in names}
    post: dict[str, list[float]] = {}
    for _ in range(rounds):
        total = dict.fromkeys(names, smooth)
        for sig, n, ls, like in rows:
            p = [weight[x] * k for x, k in zip(ls, like)]
            s = sum(p)
            post[sig] = p = [x / s for x in p]
            for x, q in zip(ls, p):
                total[x] += n * q
        s = sum(total.values())
        new = {x: v / s for x, v in total.items()}
        moved = max(abs(math.log(new[x] / weight[x])) for x in names)
        weight = new
        if moved < 1e-9:
            break
    return {sig: max(enumerate(p), key=lambda t: (t[1], -t[0])) for sig, p in post.items()}


def normalise_timestamps(df: DataFrame, value: str = "value", source: str = "source_id", locale: str | None = "locale", tz: str | None = "timezone", default_locale: str = "en-US", declared: float = 0.999999, decide: float = 0.9, twice: bool = False) -> DataFrame:
    """df with `ts_utc` (timestamp), `ts_status` (`resolved`, `ambiguous`, `day`, `none`, `invalid`, `null`), `ts_reading`
    (the label chosen), `ts_posterior` and, where a value has several readings, `ts_options` (their instants). declared: how far the row's locale and zone are trusted against the
    source's mixture; decide: the least posterior at which a reading is taken. twice: a local time that the clock shows twice
    has two readings, which nothing in the row tells apart, so it is `ambiguous` unless the source's mixture decides; without
    it such a time is the earlier one by definition."""
    none = F.lit(None).cast("string")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source).alias("src"), F.col(value).cast("string").alias("v"), (F.col(locale) if locale else none).alias("lo"), (F.col(tz) if tz else none).alias("tz"))
    # parsed once and written: the counts and both branches below read it
    parsed = stage(row.select("row", "src", _parser(default_locale, twice)("v", "lo", "tz").alias("p")), "parsed")
    open_ = F.size("p.us") > 1
    timed = F.col("p.status") == "time"
    bare = lambda sig: F.regexp_replace(sig, r"\*", "")
    options = F.when(open_, F.transform("p.us", lambda x: F.timestamp_micros(x))).alias("ts_options")
    added = lambda us, status, reading, post: [F.timestamp_micros(us).alias("ts_utc"), status.alias("ts_status"), bare(reading).alias("ts_reading"), post.alias("ts_posterior"), options]
    # one reading: the posterior is 1, no join is needed
    sure = parsed.filter(F.coalesce(~open_, F.lit(True)))
    sure = sure.select("row", *added(F.when(timed, F.try_element_at("p.us", F.lit(1))), F.when(timed, "resolved").otherwise(F.col("p.status")), F.col("p.sig"), F.when(timed, 1.0)))

    counts = parsed.filter(timed).groupBy(F.col("src").alias("_src"), F.col("p.sig").alias("_sig")).agg(F.count(F.lit(1)).alias("_n"))

    def em(t: pa.Table) -> pa.Table:
        sigs = t["_sig"].to_pylist()
        best = mixture(dict(zip(sigs, t["_n"].to_pylist())), declared)
        keep = [(s, *best[s]) for s in sigs if "|" in s]
        src = pa.array([t["_src"][0].as_py()] * len(keep), t.schema.field("_src").type)
        return pa.table({"_src": src, "_sig": pa.array([k[0] for k in keep], pa.string()), "_i": pa.array([k[1] + 1 for k in keep], pa.int32()), "_post": pa.array([k[2] for k in keep], pa.float64())})

    kind = df.schema[source].dataType.simpleString()
    chosen = counts.groupBy("_src").applyInArrow(em, f"_src {kind}, _sig string, _i int, _post double")
    asked = parsed.filter(open_).join(chosen, F.col("src").eqNullSafe(F.col("_src")) & (F.col("p.sig") == F.col("_sig")), "left")
    taken = F.col("_post") >= decide
    asked = asked.select("row", *added(F.when(taken, F.element_at("p.us", F.col("_i"))), F.when(taken, "resolved").otherwise("ambiguous"), F.element_at(F.split("p.sig", r"\|"), F.col("_i")), F.col("_post")))
    return sure.unionAll(asked).select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ADDED], *ADDED)


def instant_classes(df: DataFrame, key: list[str], id_: str, instant: str = "ts_utc") -> DataFrame:
    """(id, class, links): for each id its class, the smallest id with equal key and instant, and how many other ids are in it:
    what the pairs below say, in a row per id. Repeated rows count once; a class of any size is one aggregate."""
    rows = df.filter(F.col(instant).isNotNull()).select(*key, instant, id_).distinct()
    per = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, instant])]).agg(F.min(id_).alias("class"), (F.count(F.lit(1)) - 1).alias("links"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*key, instant])]
    return rows.join(per, on).select(id_, "class", "links")


def same_instant_pairs(df: DataFrame, key: list[str], id_: str, instant: str = "ts_utc") -> DataFrame:
    """Pairs (a, b), a < b, of ids with equal key and instant; repeated rows count once. The join key holds the
    instant, so a hot page spreads by time, and what is left skewed AQE splits."""
    rows = df.filter(F.col(instant).isNotNull()).select(*key, instant, id_).distinct()
    a, b = (rows.select(*[F.col(k).alias(f"_{s}{i}") for i, k in enumerate([*key, instant])], F.col(id_).alias(s)) for s in "ab")
    on = [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(key) + 1)]
    return a.join(b, [*on, F.col("a") < F.col("b")]).select("a", "b")
