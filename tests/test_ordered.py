import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gridsift.operators import describe as D
from gridsift.operators import ordered as O


@pytest.fixture
def many_slices(spark):
    """Keep AQE from merging the ranges, so that small data is cut into several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n=4000):
    # Two thirds of the rows share one key; one key is null.
    return spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        (F.hash("id") % 1000).alias("v"), "id", F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("mark"))


def test_running_equals_plain_window(spark, many_slices):
    df = rows(spark)
    got = O.running(df, ["key"], [("v", "desc"), ("id", "asc")], sums={"run": "v"}, totals=True)
    w = Window.partitionBy("key").orderBy(F.col("v").desc(), "id")
    want = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                     F.sum("v").over(Window.partitionBy("key")).alias("run_total"))
    assert got.select("id", "run", "run_total").exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_last_and_lag_cross_slices(spark, many_slices):
    df = rows(spark)
    got = O.running(df, ["key"], [("v", "asc"), ("id", "asc")], lasts={"seen": "mark"}, lags={"before": "id"})
    w = Window.partitionBy("key").orderBy("v", "id")
    want = df.select("id", F.last("mark", ignorenulls=True).over(w).alias("seen"), F.lag("id").over(w).alias("before"))
    assert got.select("id", "seen", "before").exceptAll(want).count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double").withColumn("k", F.lit(1))
    got = {r.v: r["rank"] for r in O.average_ranks(df, ["k"], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_latest_before(spark, many_slices):
    rng = random.Random(3)
    samples = [("a", rng.randrange(1000), f"s{i:04d}") for i in range(300)]
    changes = [("a", rng.randrange(100, 1000), f"c{i:02d}", f"p{i}") for i in range(20)]
    got = O.latest_before(spark.createDataFrame(samples, "run string, ts int, tie string"),
                          spark.createDataFrame(changes, "run string, ts int, tie string, phase string"), ["run"], "ts", "phase", "baseline", "tie")
    want = {}
    for run, ts, tie in samples:
        earlier = [(c[1], c[2], c[3]) for c in changes if c[1] <= ts]
        want[tie] = max(earlier)[2] if earlier else "baseline"
    assert {r.tie: r.phase for r in got.collect()} == want


def test_nearest_on_circle(spark, many_slices):
    rng = random.Random(5)
    queries = [("a", i, rng.uniform(-400, 400)) for i in range(200)]
    refs = [("a", rng.uniform(-400, 400)) for _ in range(15)]
    got = O.nearest_on_circle(spark.createDataFrame(queries, "k string, id int, angle double"),
                              spark.createDataFrame(refs, "k string, angle double"), ["k"], "angle", 180.0, "id")
    for r in got.collect():
        want = min(min((r.angle - b) % 180, 180 - (r.angle - b) % 180) for _, b in refs)
        assert r.nearest == pytest.approx(want, abs=1e-9)


def test_quantiles_match_numpy(spark, many_slices):
    values = np.random.default_rng(1).integers(0, 300, 2000).astype(float)
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, value double")
    row = D.quantiles(df, ["k"], [.05, .5, .95, .99]).head()
    assert [row.p05, row.p50, row.p95, row.p99] == pytest.approx(np.quantile(values, [.05, .5, .95, .99]).tolist())
    ranked = D.quantiles(df, ["k"], [.5, .99], nearest_rank=True).head()
    ordered = np.sort(values)
    assert (ranked.p50, ranked.p99) == (ordered[999], ordered[1979])


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 3), (1, 9.0, 0), (1, 4.0, 1)], "k int, value double, w long")
    row = D.quantiles(df, ["k"], [.5, .95], weight="w").head()
    assert (row.n, row.p50) == (5, 2.0) and row.p95 == pytest.approx(np.quantile([1, 2, 2, 2, 4], .95))


def test_latency_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, value double")
    row = D.quantiles(df, ["k"], [.5, .95]).head()
    assert row.p50 == 2.5 and row.p95 == pytest.approx(3.85)


def test_scan_goes_on_over_batches_and_slices(spark, many_slices):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = rows(spark, 900).withColumn("x", F.col("v") / 8.0)
        got = O.running(df, ["key"], [("v", "asc"), ("id", "asc")], sums={"run": "v", "real": "x"}, lasts={"seen": "mark"}, lags={"before": "id"}, totals=True)
        w = Window.partitionBy("key").orderBy("v", "id")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select(*df.columns, F.sum("v").over(upto).alias("run"), F.sum("x").over(upto).alias("real"), F.last("mark", ignorenulls=True).over(upto).alias("seen"),
                         F.lag("id").over(w).alias("before"), F.sum("v").over(Window.partitionBy("key")).alias("run_total"), F.sum("x").over(Window.partitionBy("key")).alias("real_total"))
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scan_of_one_hot_key_and_of_nothing(spark, many_slices):
    df = spark.range(5000).select(F.lit("k").alias("key"), "id")
    got = O.numbered(df, ["key"], [("id", "desc")])
    assert got.where("position <> 5000 - id").count() == 0 and got.count() == 5000
    assert O.running(df.where("id < 0"), ["key"], [("id", "asc")], sums={"s": "id"}, lags={"b": "id"}, totals=True).collect() == []


def test_quantiles_of_hard_values(spark):
    rng = np.random.default_rng(4)
    parts = {"tiny": rng.normal(0, 1e-300, 500), "wide": 10.0 ** rng.uniform(-300, 300, 800) * rng.choice([-1, 1], 800), "close": 1 + np.arange(300) * 2.0 ** -52,
             "one": np.full(50, -3.5), "zeros": np.array([0.0, -0.0, 0.0, 5e-324, -5e-324]), "ends": np.array([np.inf, -np.inf, 1.0, 2.0, 3.0]), "single": np.array([7.25])}
    data = [(k, float(v), int(w)) for k, values in parts.items() for v, w in zip(values, rng.integers(1, 4, len(values)))] + [("none", None, 1), (None, 2.0, 1)]
    df = spark.createDataFrame(data, "k string, value double, w long").repartition(5)
    p = [0, .05, .5, .9, .95, 1]
    got = {r.k: r for r in D.quantiles(df.where("value is not null"), ["k"], p, nearest_rank=True).collect()}
    heavy = {r.k: r for r in D.quantiles(df.where("value is not null"), ["k"], p, weight="w", nearest_rank=True).collect()}
    assert set(got) == {*parts, None}
    for k, values in parts.items():
        for found, ordered in ((got[k], np.sort(values)), (heavy[k], np.sort(np.repeat(values, [w for a, _, w in data if a == k])))):
            assert found.n == len(ordered) and (found.min, found.max) == (ordered[0], ordered[-1])
            assert [found[D._label(q)] for q in p] == [ordered[max(int(np.ceil(q * len(ordered))) - 1, 0)] for q in p], k
