"""Poses, cell regions and framing: geometry joined to maps and poses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridsift.functions import grid as G
from gridsift.operators.describe import describe

# Angular period of each pose strategy in degrees; a centre has none.
PERIODS = {"H4": 90.0, "AXIS": 180.0, "AXIS_WITH_POLARITY": 360.0}


def pose_groups(poses: DataFrame, keys: Sequence[str], group: str, normal: str, states: Sequence[str],
                fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(counts with a state histogram, field distributions) per group and for NORMAL / ANOMALY as a whole."""
    whole = F.when(F.col(group) == normal, "NORMAL").otherwise("ANOMALY")
    spread = poses.withColumn("grp", F.explode(F.array(F.col(group), whole)))
    counts = spread.groupBy(*keys, "grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == s).alias(f"state_{s.lower()}") for s in states],
        F.count_if("border").alias("border"), F.count_if(F.col("clipped_fraction") > 0).alias("clipped"),
        F.count_if((F.col("state") != "SEGMENTATION_FAILURE") & (F.col("polarity") < 0)).alias("negative_polarity"))
    valid = spread.where("state <> 'SEGMENTATION_FAILURE'")
    return counts, describe(valid, [*keys, "grp"], fields, [.25, .5, .75, .9, .95])


def change_groups(changes: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Trusted pairs, failures, flips and comparable pairs per level and over ALL levels."""
    spread = changes.withColumn(level, F.explode(F.array(F.col(level), F.lit("ALL"))))
    return spread.groupBy(*keys, level).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("state0") == "OK") & (F.col("state1") == "OK")).alias("trusted_pairs"),
        F.count_if(F.col("state1") != "OK").alias("weak_or_failure"), F.count_if("border1").alias("source_border"),
        F.count_if("polarity_flip").alias("polarity_flips"), F.count("angular_error").alias("comparable_pairs"),
        F.avg("centroid_error").alias("mean_centroid_error"), F.max("centroid_error").alias("max_centroid_error"),
        F.avg("angular_error").alias("mean_angular_error"), F.max("angular_error").alias("max_angular_error"))


def expected_centre(cx: Column, cy: Column, dx: Column, dy: Column, degrees: Column, size: float) -> tuple[Column, Column]:
    """Where a centre goes when the image is turned about its middle and shifted by fractions of its size."""
    middle = F.lit((size - 1) / 2.0)
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    x, y = cx - middle, cy - middle
    return c * x - s * y + middle + dx * size, s * x + c * y + middle + dy * size


def outside_ranges(poses: DataFrame, fit: DataFrame, keys: Sequence[str], fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Flags (name -> fields) set where any field lies outside the FIT minimum..maximum of its key."""
    names = sorted({f for fs in fields.values() for f in fs})
    box = fit.groupBy(*keys).agg(*[F.min(n).alias(f"_lo_{n}") for n in names], *[F.max(n).alias(f"_hi_{n}") for n in names])
    j = poses.join(box, list(keys))
    flags = []
    for name, fs in fields.items():
        out = F.lit(False)
        for f in fs:
            out = out | ~F.col(f).between(F.col(f"_lo_{f}"), F.col(f"_hi_{f}"))
        flags.append(out.alias(name))
    return j.select(*poses.columns, *flags)


def branch_crossings(angle0: str, angle1: str, period: float) -> Column:
    """Pairs whose angles fall into different branches of width ``period`` centred on zero."""
    half = period / 2
    return F.count_if(F.floor((F.col(angle0) + half) / period) != F.floor((F.col(angle1) + half) / period))


def symmetry_order(geometry: DataFrame, keys: Sequence[str], order: str = "order") -> DataFrame:
    """Most frequent dominant order per key; the smallest on ties."""
    counts = geometry.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg((-F.max(F.struct("_n", (-F.col(order)).alias("_o")))["_o"]).alias(order),
                                     F.sum("_n").alias("n"))


def angle_histogram(angles: DataFrame, keys: Sequence[str], angle: str, period: float, bins: int = 18) -> DataFrame:
    at = F.least(F.floor(F.pmod(F.col(angle), F.lit(float(period))) / F.lit(period / bins)), F.lit(bins - 1))
    return angles.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("images"))


# Cell transport and bands ----------------------------------------------------------------------------------------------

def transported(maps: DataFrame, transform: str, cell_size: float, height: int, width: int) -> DataFrame:
    """Cell of the source frame under the centre of each canonical cell (null outside): a computed equi-join key."""
    x = G.cell_centre(G.column_of(F.col("cell"), width), cell_size)
    y = G.cell_centre(G.row_of(F.col("cell"), width), cell_size)
    t = F.col(transform)
    return maps.withColumn("source_cell", G.cell_at(G.backward_x(t, x, y), G.backward_y(t, x, y), cell_size, height, width))


def calibration_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """z of b minus z of a at matched cells, split into raw, centring and scale terms.

    Both sides carry raw, alpha, beta. The identity is checked on every row.
    """
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("raw", "alpha", "beta")])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("raw", "alpha", "beta")])
    j = left.join(right, list(keys))
    raw = (F.col("b_raw") - F.col("a_raw")) / F.col("a_beta")
    centring = -(F.col("b_alpha") - F.col("a_alpha")) / F.col("a_beta")
    scale = (F.col("b_raw") - F.col("b_alpha")) * (1 / F.col("b_beta") - 1 / F.col("a_beta"))
    delta = (F.col("b_raw") - F.col("b_alpha")) / F.col("b_beta") - (F.col("a_raw") - F.col("a_alpha")) / F.col("a_beta")
    checked = F.when(F.abs(delta - raw - centring - scale) <= 1e-8 * F.greatest(F.abs(delta), F.lit(1.0)), delta).otherwise(
        F.raise_error(F.lit("calibration terms do not add up")).cast("double"))
    return j.select(*keys, raw.alias("raw_term"), centring.alias("centring_term"), scale.alias("scale_term"), checked.alias("delta"))


def bands(supports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Head, neck and thread boxes from the medians of the normal supports: last quarter, third quarter, first half."""
    d = describe(supports, keys, ["min_x", "max_x", "min_y", "max_y"], [.5])
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("p50"))).alias(f)
    box = d.groupBy(*keys).agg(pick("min_x"), pick("max_x"), pick("min_y"), pick("max_y"))
    half = (F.col("min_x") + F.col("max_x")) / 2
    quarter = F.col("min_x") + 0.75 * (F.col("max_x") - F.col("min_x"))
    rows = F.array(F.struct(F.lit("head").alias("region"), quarter.alias("x0"), F.col("max_x").alias("x1")),
                   F.struct(F.lit("neck").alias("region"), half.alias("x0"), quarter.alias("x1")),
                   F.struct(F.lit("thread").alias("region"), F.col("min_x").alias("x0"), half.alias("x1")))
    return box.select(*keys, F.explode(rows).alias("_r"), F.col("min_y").alias("y0"), F.col("max_y").alias("y1")).select(
        *keys, "_r.*", "y0", "y1")


def in_band(maps: DataFrame, bands: DataFrame, keys: Sequence[str], transform: str, cell_size: float, width: int) -> DataFrame:
    """Cells with the band their transformed centre lies in (half-open boxes), ``other`` without one.

    Three band rows per key are joined by the key; the boxes are disjoint, so each cell keeps one row.
    """
    x = G.cell_centre(G.column_of(F.col("cell"), width), cell_size)
    y = G.cell_centre(G.row_of(F.col("cell"), width), cell_size)
    t = F.col(transform)
    placed = maps.withColumn("_x", G.forward_x(t, x, y)).withColumn("_y", G.forward_y(t, x, y))
    packed = bands.groupBy(*keys).agg(F.collect_list(F.struct("region", "x0", "x1", "y0", "y1")).alias("_bands"))
    j = placed.join(packed, list(keys))
    hit = F.filter("_bands", lambda b: (F.col("_x") >= b["x0"]) & (F.col("_x") < b["x1"]) & (F.col("_y") >= b["y0"]) & (F.col("_y") < b["y1"]))
    return j.withColumn("region", F.coalesce(F.get(hit, F.lit(0))["region"], F.lit("other"))).drop("_x", "_y", "_bands")


def region_response(maps: DataFrame, keys: Sequence[str], region: str) -> DataFrame:
    """Global and regional peak of each map, rank of the regional peak and its gap to the global one.

    The rank counts larger cells of the same map: the map is one bounded grid kept as an array.
    """
    peak = lambda c: F.max(F.when(c, F.struct("z", (-F.col("cell")).alias("c"))))
    out = maps.groupBy(*keys).agg(peak(F.lit(True)).alias("_g"), peak(F.col("region") == region).alias("_r"),
                                  F.collect_list("z").alias("_all"))
    return out.where("_r IS NOT NULL").select(
        *keys, F.col("_g.z").alias("global_max"), (-F.col("_g.c")).alias("argmax"), F.col("_r.z").alias("region_max"),
        (-F.col("_r.c")).alias("region_argmax"),
        (F.size(F.filter("_all", lambda v: v > F.col("_r.z"))) + 1).alias("region_rank"),
        (F.col("_r.z") - F.col("_g.z")).alias("region_minus_global"))


def weighted_state(membership: DataFrame, state: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Distribution of cell state per region, each cell counted as often as normal images placed it there."""
    weights = membership.groupBy(*keys, "region", "cell").agg(F.count(F.lit(1)).alias("weight"))
    return describe(weights.join(state, [*keys, "cell"]), [*keys, "region"], fields, [.05, .5, .95], weight="weight")


# Framing ---------------------------------------------------------------------------------------------------------------

def extents(points: DataFrame, keys: Sequence[str], radius: str) -> DataFrame:
    """Support box of every silhouette: extreme points widened by the support radius."""
    return points.groupBy(*keys).agg(
        (F.min("x") - F.max(radius)).alias("min_x"), (F.max("x") + F.max(radius)).alias("max_x"),
        (F.min("y") - F.max(radius)).alias("min_y"), (F.max("y") + F.max(radius)).alias("max_y"), F.count(F.lit(1)).alias("points"))


def envelope(supports: DataFrame, keys: Sequence[str], image: str = "image") -> DataFrame:
    """Extreme bounds over all supports with the image that owns each."""
    low = lambda c: F.min(F.struct(F.col(c).alias("v"), F.col(image).alias("i")))
    high = lambda c: F.max(F.struct(F.col(c).alias("v"), F.col(image).alias("i")))
    out = supports.groupBy(*keys).agg(low("min_x").alias("_a"), high("max_x").alias("_b"), low("min_y").alias("_c"), high("max_y").alias("_d"))
    return out.select(*keys, *[F.col(f"{s}.v").alias(n) for s, n in (("_a", "min_x"), ("_b", "max_x"), ("_c", "min_y"), ("_d", "max_y"))],
                      *[F.col(f"{s}.i").alias(f"{n}_image") for s, n in (("_a", "min_x"), ("_b", "max_x"), ("_c", "min_y"), ("_d", "max_y"))])


def framing(envelope: DataFrame, size: float, margin: float) -> DataFrame:
    """Largest safe scale centred and movable, and the feasible target interval at the movable scale."""
    last = size - 1
    reach = F.greatest(-F.col("min_x"), F.col("max_x"), -F.col("min_y"), F.col("max_y"))
    centred = F.least(F.lit(1.0), (last / 2 - margin) / reach)
    movable = F.least(F.lit(1.0), (last - 2 * margin) / (F.col("max_x") - F.col("min_x")), (last - 2 * margin) / (F.col("max_y") - F.col("min_y")))
    e = envelope.withColumn("centred_scale", centred).withColumn("movable_scale", movable)
    s = F.col("movable_scale")
    return e.withColumn("lo_x", margin - s * F.col("min_x")).withColumn("hi_x", last - margin - s * F.col("max_x")).withColumn(
        "lo_y", margin - s * F.col("min_y")).withColumn("hi_y", last - margin - s * F.col("max_y")).withColumn(
        "feasible", (F.col("lo_x") <= F.col("hi_x") + 1e-10) & (F.col("lo_y") <= F.col("hi_y") + 1e-10)).withColumn(
        "target_x", (F.col("lo_x") + F.col("hi_x")) / 2).withColumn("target_y", (F.col("lo_y") + F.col("hi_y")) / 2)


def framed(points: DataFrame, contract: DataFrame, keys: Sequence[str], group: Sequence[str], size: float, radius: str) -> DataFrame:
    """How each silhouette sits in the frame under a (scale, target) contract: clipping, clearance, occupancy."""
    last = size - 1
    j = points.join(contract.select(*group, F.col("movable_scale").alias("_s"), "target_x", "target_y"), list(group))
    x, y = F.col("_s") * F.col("x") + F.col("target_x"), F.col("_s") * F.col("y") + F.col("target_y")
    rr = F.col("_s") * F.col(radius)
    out = (x < 0) | (x > last) | (y < 0) | (y > last)
    clipped = (x - rr < 0) | (x + rr > last) | (y - rr < 0) | (y + rr > last)
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(out).alias("outside"), F.count_if(clipped).alias("support_outside"),
        F.least(F.min(x - rr), last - F.max(x + rr), F.min(y - rr), last - F.max(y + rr)).alias("clearance"),
        (F.max(x + rr) - F.min(x - rr)).alias("width"), (F.max(y + rr) - F.min(y - rr)).alias("height"),
        (F.count(F.lit(1)) * F.max(F.col("_s") * F.col("_s")) / (size * size)).alias("occupancy"))
