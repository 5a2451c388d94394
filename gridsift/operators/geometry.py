"""Geometric changes of small grey images as columns.

A change is an affine map from output to source places: six coefficients per row. Every output pixel gathers its four
neighbours from the image's own array by indices computed from them, so a change is a projection: no kernel, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridsift.session import kept

# Families of changes with their levels; the level that changes nothing is 0 for shifts and rotations, 1 for scales.
ROTATION = (-20.0, -10.0, -5.0, 5.0, 10.0, 20.0)
SCALE = (0.90, 0.95, 1.05, 1.10)
IDENTITY = {"TRANSLATION_X": 0.0, "TRANSLATION_Y": 0.0, "ROTATION": 0.0, "SCALE": 1.0}


def inverse(family: Column, level: Column) -> Column:
    """Level that takes a change back: the negative of a shift or an angle, the reciprocal of a scale (an error if it is not positive)."""
    return F.when(family == "SCALE", F.when(level > 0, 1 / level).otherwise(F.raise_error(F.lit("scales are positive")).cast("double"))).otherwise(-level)


def coefficients(family: Column, level: Column, height: int, width: int) -> Column:
    """Struct (a, b, c, d, e, f): source x = a x + b y + c, source y = d x + e y + f, about the centre of the image.

    A positive angle, in degrees, turns the content clockwise as images are drawn; a scale above 1 makes it larger.
    """
    cx, cy = F.lit((width - 1) / 2), F.lit((height - 1) / 2)
    one, none = F.lit(1.0), F.lit(0.0)
    cos, sin = F.cos(F.radians(level)), F.sin(F.radians(level))
    made = {
        "TRANSLATION_X": (one, none, -level, none, one, none),
        "TRANSLATION_Y": (one, none, none, none, one, -level),
        "ROTATION": (cos, sin, cx - cos * cx - sin * cy, -sin, cos, cy + sin * cx - cos * cy),
        "SCALE": (one / level, none, cx - cx / level, none, one / level, cy - cy / level)}
    out = F.raise_error(F.concat(F.lit("unknown family "), family)).cast("struct<a: double, b: double, c: double, d: double, e: double, f: double>")
    for name, values in made.items():
        out = F.when(family == name, F.struct(*[v.alias(n) for v, n in zip(values, "abcdef")])).otherwise(out)
    return out


def places(affine: Column, height: int, width: int) -> Column:
    """For every output pixel its four neighbours in the source (row major) and the fractions between them; borders go on outwards."""
    def at(i: Column) -> Column:
        x, y = (i % width).cast("double"), F.floor(i / F.lit(width)).cast("double")
        sx = F.least(F.greatest(affine["a"] * x + affine["b"] * y + affine["c"], F.lit(0.0)), F.lit(float(width - 1)))
        sy = F.least(F.greatest(affine["d"] * x + affine["e"] * y + affine["f"], F.lit(0.0)), F.lit(float(height - 1)))
        x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
        x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
        return F.struct((y0 * width + x0).alias("nw"), (y0 * width + x1).alias("ne"), (y1 * width + x0).alias("sw"), (y1 * width + x1).alias("se"),
                        (sx - x0).alias("dx"), (sy - y0).alias("dy"))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)


def gathered(pixels: str, where: str) -> Column:
    """Image of whole grey values read at ``where`` (an array of ``places``): bilinear, rounded half up."""
    p = lambda i: F.get(F.col(pixels), i)
    return F.transform(F.col(where), lambda w: F.floor(
        (p(w["nw"]) * (1 - w["dx"]) + p(w["ne"]) * w["dx"]) * (1 - w["dy"]) + (p(w["sw"]) * (1 - w["dx"]) + p(w["se"]) * w["dx"]) * w["dy"] + 0.5).cast("int"))


def changed(rows: DataFrame, levels: Mapping[str, Sequence[float]], height: int, width: int, *, back: bool = False) -> DataFrame:
    """Every row (with ``pixels``) under every level: columns family, level, ``changed``, and with ``back`` also ``corrected``.

    ``changed`` are the pixels after the change, ``corrected`` those after the inverse change of ``changed``. The places are made once for each
    level, a short table, and meet the images by a join.
    """
    spark, family, level = rows.sparkSession, F.col("family"), F.col("level")
    steps = spark.createDataFrame([(f, float(v)) for f, values in levels.items() for v in values], "family string, level double")
    made = {"_there": coefficients(family, level, height, width)} | ({"_home": coefficients(family, inverse(family, level), height, width)} if back else {})
    table = steps.select("family", "level", *[c.alias(n) for n, c in made.items()]).select("family", "level", *[places(F.col(n), height, width).alias(n) for n in made])
    table = kept(table, "places")
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(float(v)).alias("level")) for f, values in levels.items() for v in values])
    spread = rows.select(*rows.columns, F.explode(grid).alias("_g")).select(*rows.columns, "_g.family", "_g.level")
    out = spread.join(table, ["family", "level"]).withColumn("changed", gathered("pixels", "_there"))
    if back:
        out = out.withColumn("corrected", gathered("changed", "_home"))
    return out.drop(*made)
