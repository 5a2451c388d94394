import random

import pytest
from pyspark.sql import functions as F

from gridsift.operators import evaluate as E


def board(spark, scores, regions, key="c"):
    areas = {r: regions.count(r) for r in set(regions) if r}
    rows = [(key, float(s), 1.0 / areas[r] if r else 0.0, bool(r)) for s, r in zip(scores, regions)]
    return spark.createDataFrame(rows, "category string, score double, weight double, hit boolean")


def metrics(spark, scores, regions):
    row = E.localisation(board(spark, scores, regions), ["category"]).head()
    return row.pixel_auroc, row.aupro030


def curve_at(spark, scores, regions, sample):
    return E.pro_curve(board(spark, scores, regions), ["category"]).where(F.col("sample") == sample).head().pro


def test_tiny_board(spark):
    assert metrics(spark, [3, 2, 1, 0], [1, 1, 0, 0]) == (1.0, 1.0)
    assert metrics(spark, [0, 1, 2, 3], [1, 1, 0, 0]) == (0.0, 0.0)
    auc, pro = metrics(spark, [1, 1, 1, 1], [1, 1, 0, 0])
    assert auc == .5 and pro == pytest.approx(.15)
    assert curve_at(spark, [1, 1, 1, 1], [1, 1, 0, 0], 300) == pytest.approx(.3)


def test_two_regions_weigh_the_same(spark):
    auc, pro = metrics(spark, [9, 1, 1, 1, 5, 5, 5], [1, 2, 2, 2, 0, 0, 0])
    assert auc == pytest.approx(.25) and pro == pytest.approx(.5)


def test_random_ties_equal_pair_counting(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for b in range(20):
        scores = [rng.randrange(-4, 4) for _ in range(40)]
        hits = [i % 3 == 0 for i in range(40)]
        rows += [(f"b{b}", float(s), h) for s, h in zip(scores, hits)]
        pairs = [(1 if p > n else .5 if p == n else 0) for p, hp in zip(scores, hits) if hp for n, hn in zip(scores, hits) if not hn]
        want[f"b{b}"] = sum(pairs) / len(pairs)
    df = spark.createDataFrame(rows, "category string, score double, anomaly boolean")
    got = {r.category: r.auroc for r in E.auroc(df, ["category"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_one_class_is_null(spark):
    df = spark.createDataFrame([("c", 1.0, True)], "category string, score double, anomaly boolean")
    assert E.auroc(df, ["category"]).head().auroc is None


def test_upsampling(spark):
    maps = spark.createDataFrame([("a", [-10.0, 10.0, 30.0, 50.0])], "image string, map array<double>")
    got = [r.score for r in E.upsampled(maps, 2, 2, 4, 4).orderBy("px").collect()]
    assert got == [-10, -5, 5, 10, 0, 5, 15, 20, 20, 25, 35, 40, 30, 35, 45, 50]
    assert [r.score for r in E.upsampled(maps, 2, 2, 1, 1).collect()] == [20]


def test_labelled_pixels_and_support(spark):
    arrays = spark.createDataFrame([("c", "a", [1.0, 2.0, 3.0, 4.0]), ("c", "b", [0.0] * 4)], "category string, image string, map array<double>")
    masks = spark.createDataFrame([("c", "a", [1, 1, 0, 2])], "category string, image string, regions array<int>")
    px = E.labelled_pixels(arrays, masks, ["category", "image"], 2, 2, 2, 2)
    assert {(r.image, r.px): r.weight for r in px.collect() if r.hit} == {("a", 0): .5, ("a", 1): .5, ("a", 3): 1.0}
    inner = E.labelled_pixels(arrays, masks, ["category", "image"], 2, 2, 2, 2, lambda p: p % 2 == 1)
    assert {(r.image, r.px): r.weight for r in inner.collect() if r.hit} == {("a", 1): 1.0, ("a", 3): 1.0}
    assert inner.count() == 4


def test_missing_stays_null_with_a_reason(spark):
    rows = [("a", "x", .5, None), ("a", "y", None, "failed"), ("b", "x", 1.5, None)]
    metrics_table = spark.createDataFrame(rows, "method string, category string, auroc double, reason string")
    categories = spark.createDataFrame([("x",), ("y",)], "category string")
    got = E.expected_results(categories, ["a", "b"], metrics_table, ["auroc"])
    by = {(r.method, r.category): (r.status, r.auroc, r.reason) for r in got.collect()}
    assert by["a", "y"] == ("missing", None, "failed") and by["b", "x"][0] == "missing" and by["b", "y"][2] == "not measured"
    macro = {r.method: r.auroc for r in E.macro(got, ["method"], ["auroc"]).collect()}
    assert macro == {"a": .5, "b": None}


def test_categories_weigh_the_same(spark):
    rows = spark.createDataFrame([("m", "one", "texture", 1.0), ("m", "nine", "object", 9.0)], "method string, category string, kind string, v double")
    got = {r.grp: r.v for r in E.macro_groups(rows, ["method"], "kind", ["v"]).collect()}
    assert got == {"all": 5.0, "texture": 1.0, "object": 9.0}


def test_supports_leave_out_the_border(spark):
    """Nominal: the pixel's own cell is inner. Strict: no border cell contributes to its interpolation."""
    from gridsift.operators.reports import nominal_support, strict_support
    size, cells = 18, 6
    df = spark.range(size * size).select(F.col("id").cast("int").alias("px"))
    got = df.select("px", nominal_support(size, size, cells, cells)(F.col("px")).alias("n"), strict_support(size, size, cells, cells)(F.col("px")).alias("s")).collect()
    for r in got:
        axis = [r.px // size, r.px % size]
        assert r.n == all(1 <= v * cells // size <= cells - 2 for v in axis)
        at = [min(max((v + .5) * cells / size - .5, 0), cells - 1) for v in axis]
        touched = {c for a in at for c in ({int(a)} | ({int(a) + 1} if a > int(a) else set()))}
        assert r.s == (0 not in touched and cells - 1 not in touched)


def test_no_background_is_null_not_an_error(spark):
    row = E.localisation(board(spark, [1, 2], [1, 1]), ["category"]).head()
    assert row.pixel_auroc is None and row.negative_pixels == 0


def test_defects_share_one_curve_of_good_pixels(spark):
    """The merged curves equal the plain sweep over a copy of the good pixels for each defect."""
    rng = random.Random(12)
    rows = []
    for key in ("a", "b", "none good"):
        for defect in ("good", "d1", "d2", "d3"):
            if (key, defect) == ("none good", "good"):
                continue
            for _ in range(rng.choice([1, 30, 200])):
                hit = defect != "good" and defect != "d3" and rng.random() < 0.3
                rows.append((key, defect, float(rng.randrange(-9, 12 if hit else 5)), rng.choice([0.5, 0.25]) if hit else 0.0, hit))
    df = spark.createDataFrame(rows, "category string, defect string, score double, weight double, hit boolean")
    got = {(r.category, r.defect): r for r in E.localisation_by_defect(df, ["category"]).collect()}
    assert set(got) == {(k, d) for k in ("a", "b", "none good") for d in ("d1", "d2", "d3")}
    copies = [(k, d, *rest) for k, d, *rest in rows if d != "good"] + [(k, d, *rest) for k, g, *rest in rows if g == "good" for d in ("d1", "d2", "d3")]
    want = E.localisation(spark.createDataFrame(copies, df.schema), ["category", "defect"]).collect()
    for w in want:
        g = got[w.category, w.defect]
        assert (g.regions, g.positive_pixels, g.negative_pixels) == (w.regions, w.positive_pixels, w.negative_pixels)
        if not g.positive_pixels:  # nothing to find: no value
            assert g.pixel_auroc is g.aupro030 is None
            continue
        for a, b in ((g.pixel_auroc, w.pixel_auroc), (g.aupro030, w.aupro030)):
            assert a == pytest.approx(b, abs=1e-12), (w, g)
