import random

from pyspark.sql import functions as F

from factloom.operators.ordered import ranked


def test_ranks_and_sums_with_a_hot_group(spark):
    random.seed(1)
    rows = [(g, i, random.randint(0, 5)) for i in range(3000) for g in [random.choice(["hot", "hot", "hot", "a", None])]]
    df = spark.createDataFrame(rows, "g string, id int, n int")
    got, parts = ranked(df, ["g"], [F.col("n"), F.col("id")], size="n", n=7)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.g, []).append((r.n, r.id, r["_rank"], r["_before"]))
    for g, xs in seen.items():
        xs.sort()
        before = 0
        for i, (n, _, rank, b) in enumerate(xs):
            assert (rank, b) == (i, before)
            before += n
    assert parts.agg(F.sum("_n")).first()[0] == len(rows)
    assert got.filter("g = 'hot'").select("_block").distinct().count() > 1


def test_empty(spark):
    got, parts = ranked(spark.createDataFrame([], "g string, id int"), ["g"], [F.col("id")])
    assert got.count() == 0 and parts.count() == 0
