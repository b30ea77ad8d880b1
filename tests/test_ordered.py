import random

from pyspark.sql import functions as F

from timedframe.operators import ordered as o


def rows(seed=1, n=120):
    r = random.Random(seed)
    # one key holds a third of all rows
    out = [("hot" if r.random() < 0.34 else f"k{r.randint(0, 4)}", i, r.choice([None, *range(-5, 9)])) for i in range(n)]
    r.shuffle(out)
    return out


def brute(data, keys_of):
    want = {}
    for k in {keys_of(d) for d in data}:
        group = sorted((d for d in data if keys_of(d) == k), key=lambda d: d[1])
        total, top, last = None, None, None
        for i, (_, pos, v) in enumerate(group):
            before = group[i - 1][2] if i else None
            top_before = top
            if v is not None:
                total, top, last = (total or 0) + v, v if top is None else max(top, v), v
            want[pos] = (i + 1, total, top_before, last, before, group[i + 1][2] if i + 1 < len(group) else None)
    return want


def test_scan_matches_brute_force(spark, grouping):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos int, v int").repartition(5)
    got = o.scan(
        df, ["k"], ["pos"],
        {"rn": o.run_count(), "total": o.run_sum(F.col("v")), "top": o.run_max(F.col("v"), False), "last": o.run_last(F.col("v"))},
    )
    got = o.lag_lead(got, ["k"], ["pos"], lags={"before": F.col("v")}, leads={"after": F.col("v")})
    found = {r.pos: (r.rn, r.total, r.top, r.last, r.before, r.after) for r in got.collect()}
    assert found == brute(data, lambda d: d[0])


def test_scan_without_keys(spark, grouping):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, pos int, v int").repartition(3)
    got = o.scan(df, [], ["pos"], {"total": o.run_sum(F.col("v"))})
    want = brute(data, lambda d: "all")
    assert {r.pos: r.total for r in got.collect()} == {p: w[1] for p, w in want.items()}


def test_descending_order(spark, grouping):
    data = rows(3)
    df = spark.createDataFrame(data, "k string, pos int, v int")
    got = o.number_rows(df, ["k"], [F.col("pos").desc()], "rn")
    for k in {d[0] for d in data}:
        mine = sorted((r for r in got.collect() if r.k == k), key=lambda r: -r.pos)
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))


def test_first_and_top(spark):
    df = spark.createDataFrame(rows(4), "k string, pos int, v int")
    firsts = {r.k: r.pos for r in o.first_per_key(df, ["k"], ["pos"]).collect()}
    tops = o.top_n(df, ["k"], [F.col("pos").asc()], 2).groupBy("k").agg(F.min("pos").alias("p"), F.count("*").alias("n")).collect()
    assert firsts == {r.k: r.p for r in tops}
    assert all(r.n == 2 for r in tops)


def test_shared_folder_follows_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert o.shared_folder(spark) == (setting or spark.sparkContext.getCheckpointDir())


def test_materialize_keeps_rows(spark):
    df = spark.createDataFrame(rows(5), "k string, pos int, v int")
    assert sorted(map(tuple, o.materialize(df).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
