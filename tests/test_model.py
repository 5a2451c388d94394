import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.functions import vectors as V
from gridsift.operators import correspondence as C
from gridsift.operators import moments as M
from gridsift.operators import projection as P

CELLS, CHANNELS = 4, 96


def basis(spark, images, cells=CELLS):
    """Image k has a one in channel k at every cell."""
    data = [("c", f"i{k}", cell, [1.0 if c == k else 0.0 for c in range(CHANNELS)]) for k in images for cell in range(cells)]
    return spark.createDataFrame(data, "category string, image string, cell int, u array<double>")


def test_fit_and_raw(spark):
    model = M.position_model(basis(spark, [0, 1]))
    row = model.head()
    assert row["mean"][0] == .5 and row.std[0] == pytest.approx(math.sqrt(.5)) and row.std[2] == 1e-6
    raw = {(r.image, r.cell): r.raw for r in M.raw_maps(basis(spark, [0, 2]), model).collect()}
    assert raw["i0", 0] == pytest.approx(1 / 96)
    assert raw["i2", 3] == pytest.approx((1e12 + 1) / 96, abs=1e-5)


def test_one_image_is_refused(spark):
    with pytest.raises(Exception, match="at least two"):
        M.position_model(basis(spark, [0])).collect()


@pytest.mark.parametrize("bad", [0.0, float("nan"), float("inf")])
def test_bad_descriptors_are_refused(spark, bad):
    df = spark.createDataFrame([(0, [bad] * 3)], "cell int, x array<float>")
    with pytest.raises(Exception, match="descriptor"):
        M.units(df).collect()


def test_norm_three(spark):
    df = spark.createDataFrame([(0, [3.0, 0.0])], "cell int, x array<float>")
    assert M.units(df).head().u == [1.0, 0.0]


def test_guards(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([0.6, float("nan")],), ([1.0, 1.0],)], "u array<double>")
    got = df.select(V.all_finite(F.col("u")).alias("f"), V.is_unit(F.col("u")).alias("u")).collect()
    assert [(r.f, r.u) for r in got][0] == (True, True) and not got[1].f and not got[2].u
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("nan"),)], "z double").select(V.finite(F.col("z"))).collect()


def test_visual_thresholds(spark):
    maps = spark.createDataFrame([("c", float(v)) for _ in range(3) for v in (-2, -1, 0, 1)], "category string, raw double")
    row = M.visual_thresholds(maps, nominal=.5, anomaly=.75).head()
    assert (row.lower, row.upper) == (-1.0, 0.0)
    got = maps.limit(1).select(M.visual_score(F.lit(-.5), F.lit(row.lower), F.lit(row.upper)).alias("v")).head().v
    assert got == .5
    flat = M.visual_thresholds(maps.withColumn("raw", F.lit(2.0))).head()
    assert flat.upper == pytest.approx(2.0 + 1e-6)


def test_first_index_wins(spark):
    maps = spark.createDataFrame([("c", "a", i, float(v)) for i, v in enumerate([1, 5, 5, 2])], "category string, image string, cell int, z double")
    assert M.map_summary(maps).head().argmax == 1
    assert [r.cell for r in M.top_cells(maps, 3).orderBy("place").collect()] == [1, 2, 3]


# Correspondence --------------------------------------------------------------------------------------------------------

def packed_model(spark, mean_cell, h, w):
    mean = [1.0 if c == mean_cell else 0.0 for c in range(h * w) for _ in range(2)]
    return spark.createDataFrame([("c", mean, [1.0] * len(mean))], "category string, mean array<double>, std array<double>")


def test_lowest_reference_on_ties(spark):
    grid = spark.createDataFrame([("c", "a", [0.0] * (14 * 14 * 2))], "category string, image string, grid array<double>")
    pack = packed_model(spark, 5, 14, 14)
    near = {r.cell: r for r in C.correspondence_maps(grid, pack, 14, 14, ["N1"]).collect()}
    far = {r.cell: r for r in C.correspondence_maps(grid, pack, 14, 14, ["G"]).collect()}
    assert near[0].reference == 0 and near[100].reference == 85 and near[5].reference == 4 and near[5].raw == 0
    assert all(r.reference == 0 for r in far.values())


def test_neighbours_of_the_first_cell(spark):
    from gridsift.functions.grid import neighbours
    got = spark.range(1).select(neighbours(F.lit(0), 14, 14).alias("n")).head().n
    assert got == [0, 1, 14, 15]


def test_coherence_of_three_images(spark):
    directions = [0, 1, 0]
    data = [("c", f"i{k}", cell, [1.0 if c == d else 0.0 for c in range(3)]) for k, d in enumerate(directions) for cell in range(9)]
    u = spark.createDataFrame(data, "category string, image string, cell int, u array<double>")
    rows = C.coherence(M.channel_moments(u, ["category", "cell"])).collect()
    assert all(r.cosine_mean == pytest.approx(1 / 3) for r in rows)
    drift = C.drift_summary(C.template_drift(C.grids(u, ["category", "image"]), M.channel_moments(u, ["category", "cell"]), 3, 3), ["category"], 3)
    assert drift.head().drift == 0


# Projection ------------------------------------------------------------------------------------------------------------

def test_sign_order():
    """The generator's top bit per draw, channel by channel: checked against a direct re-computation."""
    got = P.signs(42, 3, 5)
    state, mask, want = 42 ^ 0x5DEECE66D, (1 << 48) - 1, np.zeros((5, 3))
    for c in range(3):
        for d in range(5):
            state = (state * 0x5DEECE66D + 11) & mask
            want[d, c] = 1 if state >> 47 else -1
    assert (got == want).all()


def test_compiled_equals_explicit_for_zero_and_tiny_vectors(spark):
    rng = np.random.default_rng(7)
    data = [("c", f"i{k}", cell, rng.normal(size=6).tolist()) for k in range(6) for cell in range(4)]
    data += [("c", "zero", 0, [0.0] * 6), ("c", "tiny", 1, (rng.normal(size=6) * 1e-8).tolist())]
    f = spark.createDataFrame(data, "category string, image string, cell int, x array<double>")
    u = f.withColumn("u", V.unit_clamped("x", F.lit(1e-6))).drop("x")
    r = P.signs(3, 6, 64)
    stats = P.projection_statistics(P.cross_products(u, ["category"]), r)
    bank = P.archetypes(M.channel_moments(u, ["category", "cell"]), stats, r)
    filters = P.compiled_filters(bank, stats, r)
    a = {(r.image, r.cell): r.raw for r in P.filter_maps(u, filters).collect()}
    b = {(r.image, r.cell): r.raw for r in P.explicit_maps(u, bank, stats, r).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    archetype = bank.head().a
    assert math.isclose(sum(v * v for v in archetype), 1.0, abs_tol=1e-12)


def test_one_path_with_and_without_broadcast_and_no_row_lost(spark):
    """Scores do not depend on how the model is joined; a cell without model or calibration is an error."""
    rng = np.random.default_rng(3)
    data = [("c", f"i{k}", cell, rng.normal(size=5).tolist()) for k in range(8) for cell in range(3)]
    f = spark.createDataFrame(data, "category string, image string, cell int, x array<double>")
    model = M.position_model(M.units(f))
    forms = P.dispersion_model(P.cross_products(M.units(f), ["category", "cell"]), P.signs(3, 5, 16))

    def scores():
        a = {(r.image, r.cell): r.raw for r in M.feature_maps(f, model).collect()}
        b = {(r.image, r.cell): r.raw for r in P.dispersion_maps(M.units(f), forms).collect()}
        return a, b

    usual, before = scores(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sorted_joins = scores()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for s, l in zip(usual, sorted_joins):
        assert len(s) == 24 and s == l
    other = f.unionByName(f.limit(1).withColumn("cell", F.lit(99)))
    with pytest.raises(Exception, match="no model for c, 99"):
        M.feature_maps(other, model).collect()
    maps = M.feature_maps(f, model)
    with pytest.raises(Exception, match="no calibration for c, 2"):
        M.calibrated(maps, M.position_calibration(maps).where("cell < 2")).collect()
