from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.functions.timeparse import readings
from factloom.operators.timestamps import instant_classes, mixture, normalise_timestamps, same_instant_pairs


def at(s):
    return round(datetime.fromisoformat(s).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "value,tz,want",
    [
        ("2024-04-12T00:33:00+03", None, "2024-04-12T00:33:00+03:00"),
        ("2024-02-14 09:48:45.297 America/Sao_Paulo", None, "2024-02-14T09:48:45.297-03:00"),
        ("2022-01-05T01:57-06:00[America/Chicago]", "UTC", "2022-01-05T07:57:00+00:00"),
        ("2023-02-24T15:57:00−03:00", None, "2023-02-24T18:57:00+00:00"),
        ("2020-W08-1T13:19:00Z", None, "2020-02-17T13:19:00+00:00"),
        ("2024-307T22:05:03Z", None, "2024-11-02T22:05:03+00:00"),
        ("20240422T100050.409+0100", None, "2024-04-22T09:00:50.409+00:00"),
        ("/Date(1683547920000-0700)/", None, "2023-05-08T12:12:00+00:00"),
        ("1718243160.000", None, "2024-06-13T01:46:00+00:00"),
        ("1586816163802000", None, "2020-04-13T22:16:03.802+00:00"),
        ("25 июня 2025 г., 03:45", "Europe/Moscow", "2025-06-25T00:45:00+00:00"),
        ("le 10 avril 2020 à 15:29:25", "Europe/Paris", "2020-04-10T13:29:25+00:00"),
        ("le 10 février 2024 à 15h38", "UTC", "2024-02-10T15:38:00+00:00"),
        ("10. Februar 2023, 18:25:58 Uhr", "Europe/Berlin", "2023-02-10T17:25:58+00:00"),
        ("April 19, 2022 at 2:54 AM GMT+03:00", None, "2022-04-18T23:54:00+00:00"),
        ("Wed Sep  4 04:56:22.932133 2024", None, "2024-09-04T04:56:22.932133+00:00"),
        ("Fri, 02 Apr 2021 03:27:31 GMT", "Asia/Tokyo", "2021-04-02T03:27:31+00:00"),
        ("September 12, 2024 9:58:16 p.m.", None, "2024-09-12T21:58:16+00:00"),
        ("2023-06-16 06:24:16.594 CEST", None, "2023-06-16T04:24:16.594+00:00"),
        ("2024-10-27T02:30:00", "Europe/Berlin", "2024-10-27T00:30:00+00:00"),  # twice: the earlier
        ("2024-03-31T02:30:00", "Europe/Berlin", "2024-03-31T01:30:00+00:00"),  # skipped: the offset before
    ],
)
def test_one_reading(value, tz, want):
    status, found = readings(value, tz)
    assert status == "time" and [u for _, u in found] == [at(want)]


@pytest.mark.parametrize("value,status", [(None, "null"), ("", "none"), ("soon", "none"), ("vor 3 Stunden", "none"), ("March 27, 2025", "day"), ("2023-02-30T10:00:00Z", "invalid"), ("0000-00-00 00:00:00", "invalid"), ("2024-01-01 25:00", "invalid"), ("x" * 100_000, "none")])
def test_no_reading(value, status):
    assert readings(value) == (status, [])


def test_orders():
    assert [x for x, _ in readings("03/10/2020 18:35")[1]] == ["dmy", "mdy"]
    assert [x for x, _ in readings("31/10/2020 18:35")[1]] == ["dmy"]


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1995, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["UTC", "Asia/Kathmandu", "America/New_York"]))
def test_round_trip(t, zone):
    z = t.replace(tzinfo=ZoneInfo(zone))
    assert readings(z.isoformat())[1][0][1] == round((z - datetime(1970, 1, 1, tzinfo=ZoneInfo("UTC"))).total_seconds() * 1e6 // 1) or abs(readings(z.isoformat())[1][0][1] - z.timestamp() * 1e6) < 2
    assert readings(t.strftime("%Y/%m/%d %H:%M:%S"), zone)[1][0][1] == round(z.replace(microsecond=0).timestamp()) * 1_000_000


def test_mixture_learns_from_the_source():
    # nothing declared: a source that mostly writes day first decides the open ones
    best = mixture({"dmy": 40, "dmy|mdy": 5}, 0.999)
    assert best["dmy|mdy"][0] == 0 and best["dmy|mdy"][1] > 0.9
    # no evidence at all stays open
    assert mixture({"dmy|mdy": 5}, 0.999)["dmy|mdy"][1] == pytest.approx(0.5)
    # what the row declares outweighs the mixture
    assert mixture({"dmy": 1000, "dmy|mdy*": 5}, 0.999999)["dmy|mdy*"][0] == 1


def test_table(spark):
    rows = [(1, "a", "03/10/2020 18:35", "en-US", None, "x"), (2, "a", "03/10/2020 18:35", "de-DE", None, "x"), (3, None, None, None, None, None), (4, "a", "10 Mar 2020 18:35 IST", None, "Asia/Kolkata", "y"), (4, "a", "10 Mar 2020 18:35 IST", None, "Asia/Kolkata", "y"), (5, "a", "x" * 50_000, None, "No/Where", "z")]
    df = spark.createDataFrame(rows, "id int, source_id string, value string, locale string, timezone string, p string").withColumn("ts_utc", F.lit("old")).withColumn("_sig", F.lit(1)).withColumn("row", F.lit(2))
    got = {r.id: r for r in normalise_timestamps(df).collect()}
    assert got[1].ts_utc == datetime(2020, 3, 10, 18, 35) and got[2].ts_utc == datetime(2020, 10, 3, 18, 35)
    assert got[3].ts_status == "null" and got[5].ts_status == "none" and got[4].ts_utc == datetime(2020, 3, 10, 13, 5)
    assert normalise_timestamps(df).count() == 6 and got[1]["_sig"] == 1 and got[1]["row"] == 2 and got[1].p == "x"
    assert normalise_timestamps(df.limit(0)).collect() == []


def test_ambiguous_is_marked(spark):
    df = spark.createDataFrame([(1, "s", "1 Mar 2020 10:00 CST")], "id int, source_id string, value string")
    r = normalise_timestamps(df, locale=None, tz=None).first()
    assert r.ts_status == "ambiguous" and r.ts_utc is None and r.ts_posterior == pytest.approx(0.5)


def test_pairs(spark):
    t = datetime(2020, 1, 1)
    df = spark.createDataFrame([("u", "b", t), ("u", "a", t), ("u", "a", t), ("u", "c", datetime(2020, 1, 2)), ("v", "d", t), (None, "e", t), (None, "f", t), ("v", "g", None)], "u string, id string, ts_utc timestamp")
    assert [tuple(r) for r in same_instant_pairs(df, ["u"], "id").collect()] == [("a", "b")]


def test_repeated_hours_are_ambiguous(spark):
    rows = [("a", "s", "2024-10-27 02:30:00", "Europe/Berlin"), ("b", "s", "2024-10-27 03:30:00", "Europe/Berlin"), ("c", "s", "2024-03-31 02:30:00", "Europe/Berlin"), ("d", "s", "2024-10-27 02:30:00+02:00", "Europe/Berlin"), ("e", "s", "05.11.24 10:00", None), ("f", "s", "31/12/99 10:00", None)]
    df = spark.createDataFrame(rows, "id string, source_id string, value string, timezone string").withColumn("locale", F.lit("de-DE"))
    both = {r.id: r for r in normalise_timestamps(df, twice=True).collect()}
    assert (both["a"].ts_status, both["a"].ts_utc, len(both["a"].ts_options)) == ("ambiguous", None, 2) and (both["a"].ts_options[1] - both["a"].ts_options[0]).seconds == 3600
    assert [both[x].ts_status for x in "bcdef"] == ["resolved"] * 5 and both["b"].ts_options is None
    one = {r.id: r for r in normalise_timestamps(df).collect()}
    assert one["a"].ts_status == "resolved" and one["a"].ts_utc == both["a"].ts_options[0]
    assert (one["e"].ts_utc.year, one["e"].ts_utc.month, one["f"].ts_utc.year) == (2024, 11, 1999)


def test_mixture_decides_where_the_row_says_nothing(spark):
    rows = [(f"u{i}", "dmy", f"{13 + i % 15}/0{1 + i % 9}/2024 10:00") for i in range(60)] + [("x", "dmy", "03/04/2024 10:00"), ("y", "lone", "03/04/2024 10:00")]
    rows += [(f"m{i}", "mixed", v) for i, v in enumerate(["13/02/2024 10:00", "02/13/2024 10:00"] * 20)] + [("z", "mixed", "03/04/2024 10:00")]
    df = spark.createDataFrame(rows, "id string, source_id string, value string").withColumn("locale", F.lit(None).cast("string")).withColumn("timezone", F.lit(None).cast("string"))
    got = {r.id: r for r in normalise_timestamps(df, declared=0.5).collect()}
    assert (got["x"].ts_status, got["x"].ts_reading, got["x"].ts_utc.month) == ("resolved", "dmy", 4)
    assert got["y"].ts_status == "ambiguous" and got["z"].ts_status == "ambiguous" and len(got["z"].ts_options) == 2


def test_classes_say_what_the_pairs_say(spark):
    rows = [("p", "a", 1), ("p", "b", 1), ("p", "c", 1), ("p", "d", 2), ("q", "e", 1), ("p", "a", 1), ("p", "n", None)]
    df = spark.createDataFrame(rows, "k string, id string, s long").withColumn("ts_utc", F.timestamp_seconds("s"))
    pairs = [(r.a, r.b) for r in same_instant_pairs(df, ["k"], "id").collect()]
    got = {r.id: (r["class"], r.links) for r in instant_classes(df, ["k"], "id").collect()}
    assert got == {x: (min([x] + [a for a, b in pairs if b == x]), sum(x in p for p in pairs)) for x in "abcde"}
