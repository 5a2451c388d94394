"""Exact ranking quality: image AUROC, pixel AUROC, AUPRO and the PRO curve.

Everything is one descending sweep over distinct scores. Equal scores are
merged first (map side), so ties form one step, and the running counts come
from range slices, so a category of any size is swept by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from gridsift.operators.ordered import running
from gridsift.session import kept

FPR_LIMIT = 0.30
CURVE_POINTS = 301


def score_steps(rows: DataFrame, keys: Sequence[str], score: str, positive: str,
                weight: str | None = None) -> DataFrame:
    """Positives, negatives and region weight of every distinct score."""
    hit = F.col(positive).cast("long")
    extra = [F.sum(weight).alias("w")] if weight else []
    return rows.groupBy(*keys, score).agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp"), *extra)


def swept(steps: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Running and total counts by descending score."""
    sums = {"tps": "tp", "fps": "fp"} | ({"ws": "w"} if "w" in steps.columns else {})
    return running(steps, keys, [(score, "desc")], sums=sums, totals=True)


def _roc_area() -> Column:
    """Trapezoids of the ROC curve; null unless both classes are present."""
    pairs = F.max("tps_total").cast("double") * F.max("fps_total")
    return F.when(pairs > 0, F.sum(F.col("fp") * (2 * F.col("tps") - F.col("tp")) / F.lit(2.0)) / pairs)


def auroc(rows: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "anomaly") -> DataFrame:
    """Exact area under the ROC curve per key, ties counting one half."""
    sweep = swept(score_steps(rows, keys, score, positive), keys, score)
    return sweep.groupBy(*keys).agg(F.max("tps_total").alias("positives"), F.max("fps_total").alias("negatives"),
                                    _roc_area().alias("auroc"))


def auroc_by_defect(rows: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "anomaly",
                    defect: str = "defect") -> DataFrame:
    """AUROC of each defect against the good rows it shares with the others.

    The good rows are ranked once per key; each defect then sums the number of
    good rows below its own scores. Nothing is copied per defect.
    """
    hit = F.col(positive).cast("long")
    counts = kept(rows.groupBy(*keys, defect, score).agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("neg")), "counts")
    good = counts.groupBy(*keys, score).agg(F.sum("neg").alias("neg"))
    ranked = running(good, keys, [(score, "asc")], sums={"upto": "neg"}, totals=True)
    hits = counts.where("hits > 0").select(*keys, defect, score, "hits")
    below = F.col("upto") - F.col("neg") / F.lit(2.0)
    return hits.join(ranked, [*keys, score]).groupBy(*keys, defect).agg(
        F.sum("hits").alias("positives"), F.max("upto_total").alias("negatives"),
        F.try_divide(F.sum(F.col("hits") * below), F.sum("hits") * F.max("upto_total")).alias("auroc"))


# Pixels ----------------------------------------------------------------------------------------------------------------

def map_arrays(maps: DataFrame, keys: Sequence[str], value: str = "z") -> DataFrame:
    """One row per image with its map as an array in cell order (a map is one bounded grid)."""
    cells = F.array_sort(F.collect_list(F.struct("cell", value)))
    return maps.groupBy(*keys).agg(F.transform(cells, lambda c: c[value]).alias("map"))


def _source(index: Column, out: int, size: int) -> tuple[Column, Column, Column]:
    """Lower and upper source index and fraction for half-pixel centres with replicated borders."""
    at = F.least(F.greatest((index + F.lit(0.5)) * F.lit(size / out) - F.lit(0.5), F.lit(0.0)), F.lit(float(size - 1)))
    low = F.floor(at).cast("int")
    return low, F.least(low + 1, F.lit(size - 1)), at - low


def upsampled(arrays: DataFrame, height: int, width: int, out_height: int, out_width: int,
              carry: Sequence[str] = ()) -> DataFrame:
    """Bilinear pixels of every map, row major: columns px, score, then the exploded ``carry`` arrays.

    ``carry`` names per-pixel arrays of the same image (a label map), so pixels
    meet their labels without a join on pixels. All of it is generated code.
    """
    # Rows, then columns: two short constant sequences instead of one as long as the image.
    others = [c for c in arrays.columns if c != "map" and c not in carry]
    lines = arrays.select(*others, "map", *carry, F.explode(F.sequence(F.lit(0), F.lit(out_height - 1))).alias("_y"))
    p = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(out_width - 1))).alias("_x"))
    y0, y1, fy = _source(F.col("_y"), out_height, height)
    x0, x1, fx = _source(F.col("_x"), out_width, width)
    at = lambda y, x: F.get(F.col("map"), y * width + x)
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    bottom = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    px = F.col("_y") * out_width + F.col("_x")
    return p.select(*others, px.alias("px"), (top * (1 - fy) + bottom * fy).alias("score"), *[F.get(F.col(c), px).alias(c) for c in carry])


def inverse_areas(size: int):
    """Arrow UDF: 1 / area of the region of each pixel, 0 on the background (region 0, or an image without a mask)."""

    @arrow_udf(ArrayType(DoubleType()))
    def weigh(regions: pa.Array) -> pa.Array:
        out = []
        for labels in regions.to_numpy(zero_copy_only=False):
            if labels is None:
                out.append(np.zeros(size))
                continue
            if len(labels) != size:
                raise ValueError("mask and map sizes differ")
            labels = np.asarray(labels, dtype=np.int64)
            areas = np.bincount(labels, minlength=1).astype(np.float64)
            areas[0] = np.inf
            out.append(1.0 / areas[labels])
        return pa.array(out, pa.list_(pa.float64()))

    return weigh


def labelled_pixels(arrays: DataFrame, masks: DataFrame, keys: Sequence[str], height: int, width: int,
                    out_height: int, out_width: int,
                    support: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pixels with score, region weight and foreground flag; images without a mask row are background.

    ``masks(keys, regions ARRAY<INT>)`` holds region ids, 0 outside. A
    ``support`` (pixel index -> condition) drops pixels, and areas are those inside it.
    """
    regions = F.col("regions")
    if support is not None:
        regions = F.transform(regions, lambda v, i: F.when(support(i), v).otherwise(F.lit(0)))
    joined = arrays.join(masks, list(keys), "left")
    weighted = joined.withColumn("weight", inverse_areas(out_height * out_width)(regions)).drop("regions")
    pixels = upsampled(weighted, height, width, out_height, out_width, carry=["weight"])
    if support is not None:
        pixels = pixels.where(support(F.col("px")))
    return pixels.withColumn("hit", F.col("weight") > 0)


def _inside(support: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda v, i: F.when(support(i), v).otherwise(F.lit(0))


def localisation_by_support(arrays: DataFrame, masks: DataFrame, keys: Sequence[str], height: int, width: int, out_height: int, out_width: int,
                            supports: Mapping[str, Callable[[Column], Column] | None], by: Sequence[str]) -> DataFrame:
    """Pixel metrics per (support, ``by``) of all supports from one pass over the pixels.

    Each support has its own region areas, hence its own weights; they travel with the image and its pixels are made once. Distinct
    scores, not pixels, are then taken apart by support.
    """
    joined = arrays.join(masks, list(keys), "left")
    weigh, names = inverse_areas(out_height * out_width), {name: f"_weight{i}" for i, name in enumerate(supports)}
    for name, support in supports.items():
        regions = F.col("regions")
        if support is not None:
            regions = F.transform(regions, _inside(support))
        joined = joined.withColumn(names[name], weigh(regions))
    pixels = upsampled(joined.drop("regions"), height, width, out_height, out_width, carry=list(names.values()))
    sums = []
    for name, support in supports.items():
        weight, inside = F.col(names[name]), F.lit(True) if support is None else support(F.col("px"))
        sums.append(F.struct(F.lit(name).alias("support"), F.count_if(inside & (weight > 0)).alias("tp"), F.count_if(inside & ~(weight > 0)).alias("fp"),
                             F.sum(F.when(inside, weight).otherwise(F.lit(0.0))).alias("w")))
    steps = pixels.groupBy(*by, "score").agg(*[x.alias(names[name]) for x, name in zip(sums, supports)])
    apart = steps.select(*by, "score", F.explode(F.array(*names.values())).alias("_s")).select("_s.support", *by, "score", "_s.tp", "_s.fp", "_s.w")
    return localisation_of(apart.where("tp + fp > 0"), ["support", *by])


def localisation(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel AUROC and AUPRO@0.30 with equal region weights."""
    steps = score_steps(pixels, keys, "score", "hit", "weight")
    return localisation_of(steps, keys)


def _segments(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    sweep = swept(steps, keys, "score")
    n, w = F.col("fps_total"), F.col("ws_total")
    # Null, not an error, where a key lacks background or foreground.
    return sweep.withColumn("x1", F.try_divide("fps", n)).withColumn("x0", F.try_divide(F.col("fps") - F.col("fp"), n)).withColumn(
        "y1", F.try_divide("ws", w)).withColumn("y0", F.try_divide(F.col("ws") - F.col("w"), w))


def _pro_at(x: Column) -> Column:
    return F.col("y0") + (F.col("y1") - F.col("y0")) * ((x - F.col("x0")) / (F.col("x1") - F.col("x0")))


def localisation_of(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    stop = F.least(F.col("x1"), F.lit(FPR_LIMIT))
    piece = F.when((F.col("fp") > 0) & (F.col("x0") < FPR_LIMIT),
                   (stop - F.col("x0")) * (F.col("y0") + _pro_at(stop)) / F.lit(2.0)).otherwise(F.lit(0.0))
    return _segments(steps, keys).groupBy(*keys).agg(
        F.round(F.max("ws_total"), 0).cast("long").alias("regions"), F.max("tps_total").alias("positive_pixels"),
        F.max("fps_total").alias("negative_pixels"), _roc_area().alias("pixel_auroc"),
        (F.sum(piece) / F.lit(FPR_LIMIT)).alias("aupro030"))


def pro_curve(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PRO at 301 false positive rates 0, .001, ... .300, each from the first segment beyond it."""
    segments = _segments(score_steps(pixels, keys, "score", "hit", "weight"), keys).where("fp > 0").where(
        F.col("x0") <= (CURVE_POINTS - 1) * .001)
    first = F.greatest(F.floor(F.col("x0") * 1000), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("x1") * 1000), F.lit(CURVE_POINTS - 1)).cast("int")
    points = segments.withColumn("sample", F.explode(F.sequence(first, last))).withColumn("x", F.col("sample") * F.lit(.001))
    inside = points.where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return inside.select(*keys, "sample", F.col("x").alias("fpr"), _pro_at(F.col("x")).alias("pro"))


def localisation_by_defect(pixels: DataFrame, keys: Sequence[str], defect: str = "defect",
                           good: str = "good") -> DataFrame:
    """Pixel metrics of each defect together with the pixels of the good images, which are background all over.

    The good pixels are one step function per key, swept once; it is read at the scores that defects have. A defect's
    curve is its own steps merged into it: between two of them only good pixels lie, so their share of the area is a
    rectangle as wide as the number of them, and nothing is copied per defect.
    """
    steps = kept(score_steps(pixels, [*keys, defect], "score", "hit", "weight"), "steps")
    own = steps.where(F.col(defect) != good)
    background = steps.where(F.col(defect) == good).select(*keys, "score", F.col("fp").alias("good"))
    marks = own.select(*keys, "score", F.lit(0).cast("long").alias("good"))
    curve = running(background.unionByName(marks).groupBy(*keys, "score").agg(F.sum("good").alias("good")), keys, [("score", "desc")],
                    sums={"upto": "good"}, totals=True)
    merged = own.join(curve, [*keys, "score"])
    by = [*keys, defect]
    sweep = running(merged, by, [("score", "desc")], sums={"tps": "tp", "fps": "fp", "ws": "w"}, lags={"seen": "upto"}, totals=True)
    n, w, seen = F.col("fps_total") + F.col("upto_total"), F.col("ws_total"), F.coalesce("seen", F.lit(0))
    above = F.col("fps") - F.col("fp")
    placed = sweep.withColumn("n", n).withColumn("gap", F.col("upto") - F.col("good") - seen).withColumn("x", F.try_divide(above + seen, n)).withColumn(
        "x0", F.try_divide(above + F.col("upto") - F.col("good"), n)).withColumn("x1", F.try_divide(F.col("fps") + F.col("upto"), n)).withColumn(
        "y1", F.try_divide("ws", w)).withColumn("y0", F.try_divide(F.col("ws") - F.col("w"), w))
    flat = F.when((F.col("gap") > 0) & (F.col("x") < FPR_LIMIT), (F.least("x0", F.lit(FPR_LIMIT)) - F.col("x")) * F.col("y0")).otherwise(F.lit(0.0))
    stop = F.least(F.col("x1"), F.lit(FPR_LIMIT))
    piece = F.when((F.col("fp") + F.col("good") > 0) & (F.col("x0") < FPR_LIMIT),
                   (stop - F.col("x0")) * (F.col("y0") + _pro_at(stop)) / F.lit(2.0)).otherwise(F.lit(0.0))
    # Good pixels below the last step of the defect, where every region is found.
    rest = F.when(F.max("ws_total") > 0, F.greatest(F.lit(FPR_LIMIT) - F.max("x1"), F.lit(0.0)))
    pairs = F.max("tps_total").cast("double") * F.max("n")
    below = F.col("n") - F.col("fps") - F.col("upto") + (F.col("fp") + F.col("good")) / F.lit(2.0)
    return placed.groupBy(*by).agg(
        F.round(F.max("ws_total"), 0).cast("long").alias("regions"), F.max("tps_total").alias("positive_pixels"), F.max("n").alias("negative_pixels"),
        F.when(pairs > 0, F.sum(F.col("tp") * below) / pairs).alias("pixel_auroc"), ((F.sum(flat + piece) + rest) / F.lit(FPR_LIMIT)).alias("aupro030"))


# Macro averages --------------------------------------------------------------------------------------------------------

def macro(metrics: DataFrame, by: Sequence[str], values: Sequence[str], status: str = "status") -> DataFrame:
    """Equal weight per category over verified rows; null when there is none."""
    verified = F.col(status) == "verified"
    return metrics.groupBy(*by).agg(F.count_if(verified).alias("verified"), F.count(F.lit(1)).alias("expected"),
                                    *[F.avg(F.when(verified, F.col(v))).alias(v) for v in values])


def macro_groups(metrics: DataFrame, by: Sequence[str], group: str, values: Sequence[str]) -> DataFrame:
    """Macro average over all categories and over each of their groups."""
    spread = metrics.withColumn("grp", F.explode(F.array(F.lit("all"), F.col(group))))
    return spread.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("categories"),
                                          *[F.avg(v).alias(v) for v in values])


def expected_results(categories: DataFrame, methods: Sequence[str], metrics: DataFrame,
                     values: Sequence[str]) -> DataFrame:
    """Every method of every category; a missing or invalid measurement stays null with a reason."""
    grid = categories.select("category", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    joined = grid.join(metrics, ["method", "category"], "left")
    valid = F.lit(True)
    for v in values:
        valid = valid & F.coalesce(F.col(v).between(0, 1 + 1e-10), F.lit(False))
    return joined.select(
        "method", "category", F.when(valid, F.lit("verified")).otherwise(F.lit("missing")).alias("status"),
        *[F.when(valid, F.col(v)).alias(v) for v in values],
        F.when(~valid, F.coalesce(F.col("reason"), F.lit("not measured"))).alias("reason"))
