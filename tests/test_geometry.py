"""Geometric changes against a plain loop, and matching of cells against its definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.operators import correspondence as C
from gridsift.operators import geometry as G


def plain(image, family, level):
    """Bilinear reading of the source place of each pixel, borders going on outwards."""
    h, w = image.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            sx, sy = x, y
            if family == "ROTATION":
                c, s = math.cos(math.radians(level)), math.sin(math.radians(level))
                sx, sy = c * (x - cx) + s * (y - cy) + cx, -s * (x - cx) + c * (y - cy) + cy
            elif family == "SCALE":
                sx, sy = (x - cx) / level + cx, (y - cy) / level + cy
            elif family == "TRANSLATION_X":
                sx = x - level
            else:
                sy = y - level
            sx, sy = min(max(sx, 0), w - 1), min(max(sy, 0), h - 1)
            x0, y0 = int(sx), int(sy)
            x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
            top = image[y0, x0] * (1 - (sx - x0)) + image[y0, x1] * (sx - x0)
            low = image[y1, x0] * (1 - (sx - x0)) + image[y1, x1] * (sx - x0)
            out[y, x] = math.floor(top * (1 - (sy - y0)) + low * (sy - y0) + 0.5)
    return out


def test_changes_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    images = rng.integers(0, 256, (6, 5, 7))
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(images)], "image int, pixels array<int>")
    levels = {"ROTATION": (*G.ROTATION, 0.0, 90.0), "SCALE": (*G.SCALE, 1.0), "TRANSLATION_X": (-2.0, 0.5), "TRANSLATION_Y": (1.0, 9.0)}
    rows = G.changed(df, levels, 5, 7, back=True).collect()
    assert len(rows) == 6 * sum(map(len, levels.values()))
    for r in rows:
        there = plain(images[r.image], r.family, r.level)
        assert np.abs(np.array(r.changed) - there.ravel()).max() <= 1 and np.mean(np.array(r.changed) != there.ravel()) < 0.02  # halves may round either way
        home = plain(np.array(r.changed).reshape(5, 7), r.family, 1 / r.level if r.family == "SCALE" else -r.level)
        assert np.abs(np.array(r.corrected) - home.ravel()).max() <= 1
        if r.level == G.IDENTITY[r.family]:
            assert r.changed == r.corrected == images[r.image].ravel().tolist()


def test_odd_levels_are_refused(spark):
    df = spark.createDataFrame([(0, [1] * 4)], "image int, pixels array<int>")
    with pytest.raises(Exception, match="scales are positive"):
        G.changed(df, {"SCALE": (-1.0,)}, 2, 2, back=True).collect()
    with pytest.raises(Exception, match="unknown family SHEAR"):
        G.changed(df, {"SHEAR": (1.0,)}, 2, 2).collect()


@pytest.mark.parametrize("model_bytes", [1 << 20, 0])
def test_matching_by_products_equals_its_definition(spark, model_bytes):
    """Also with deviations so small that the product alone would be wrong, equal references, and models that are joined."""
    rng = np.random.default_rng(2)
    h, w, c = 3, 4, 5
    models = {}
    for name in ("a", "b"):
        mean, std = rng.normal(size=(h * w, c)), 10.0 ** rng.uniform(-6, 0, (h * w, c))
        mean[7], std[7] = mean[2], std[2]
        models[name] = mean, std
    grids = {}
    for i in range(40):
        mean, std = models["ab"[i % 2]]
        grids[i] = mean[rng.permutation(h * w)] + std * rng.normal(size=(h * w, c)) * rng.choice([0, 1e-3, 1])
    pack = spark.createDataFrame([(k, m.ravel().tolist(), s.ravel().tolist()) for k, (m, s) in models.items()], "category string, mean array<double>, std array<double>")
    rows = [("ab"[i % 2], i, g.ravel().tolist()) for i, g in grids.items()] + [("none", 99, [0.0] * h * w * c)]
    df = spark.createDataFrame(rows, "category string, image int, grid array<double>").repartition(3)
    got = {(r.mode, r.image, r.cell): (r.raw, r.reference) for r in C.correspondence_maps(df, pack, h, w, ("P", "N1", "G"), model_bytes=model_bytes).collect()}
    assert len(got) == 3 * 40 * h * w  # an image without a model has no rows
    for i, g in grids.items():
        mean, std = models["ab"[i % 2]]
        for p in range(h * w):
            d = ((((g[p] - mean) / std) ** 2).mean(axis=1))
            for mode in ("P", "N1", "G"):
                allowed = [q for q in range(h * w) if mode == "G" or p == q or (mode == "N1" and abs(p // w - q // w) <= 1 and abs(p % w - q % w) <= 1)]
                best = min(allowed, key=lambda q: (d[q], q))
                raw, reference = got[mode, i, p]
                assert reference == best and raw == pytest.approx(d[best], rel=1e-12)


def test_units_are_made_on_the_way(spark):
    rng = np.random.default_rng(3)
    g = rng.normal(size=(4, 3))
    pack = spark.createDataFrame([("a", rng.normal(size=12).tolist(), [0.5] * 12)], "category string, mean array<double>, std array<double>")
    unit = (g / np.linalg.norm(g, axis=1, keepdims=True)).ravel().tolist()
    made = [C.correspondence_maps(spark.createDataFrame([("a", x)], "category string, grid array<double>"), pack, 2, 2, ("G",), normalise=n).orderBy("cell").collect()
            for x, n in ((g.ravel().tolist(), True), (unit, False))]
    assert [r.reference for r in made[0]] == [r.reference for r in made[1]]
    assert [r.raw for r in made[0]] == pytest.approx([r.raw for r in made[1]])


def test_lengths_and_signs_of_a_large_projection(spark):
    """10,000 dimensions of 96 channels: neither operator forms a vector of that length per row more than it returns."""
    from gridsift.operators import projection as P
    r = P.signs(7, 96, 10_000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 96))
    x[0] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    got = {a.id: a.rho for a in df.select("id", P.length_ratio(r)("x").alias("rho")).collect()}
    want = np.linalg.norm(x @ r.T.astype(float), axis=1) / (100 * np.maximum(np.linalg.norm(x, axis=1), 1e-300))
    assert got[0] is None and [got[i] for i in range(1, 300)] == pytest.approx(want[1:].tolist())
    report = P.isometry_report(df.withColumn("k", F.lit(1)), ["k"], r).head()
    assert (report.used, report.excluded) == (299, 1) and report.mean_ratio == pytest.approx(want[1:].mean()) and report.max_error == pytest.approx(abs(want[1:] - 1).max())
    few = r[:40]
    rows = df.where("id < 50").withColumn("w", P.sign_words("x", 96)).select("id", F.size("w").alias("words"), P.sign_products("w", P.packed_signs(few), 96).alias("y")).collect()
    signs = np.where(x < 0, -1, 1)
    assert all(a.words == 2 and a.y == (few.astype(int) @ signs[a.id]).tolist() for a in rows)
