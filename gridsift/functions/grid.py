"""Grid geometry as column expressions: cell = row * width + column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def row_of(cell: Column, width: int) -> Column:
    return F.floor(cell / F.lit(width)).cast("int")


def column_of(cell: Column, width: int) -> Column:
    return F.pmod(cell, F.lit(width)).cast("int")


def interior(cell: Column, height: int, width: int) -> Column:
    """Cells not on the outer ring."""
    return row_of(cell, width).between(1, height - 2) & column_of(cell, width).between(1, width - 2)


def neighbours(cell: Column, height: int, width: int) -> Column:
    """The 3x3 neighbourhood clipped at the borders, ascending, as an array of cells."""
    row, column = row_of(cell, width), column_of(cell, width)
    around = F.array(*[F.struct((row + dr).alias("r"), (column + dc).alias("c"))
                       for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    inside = F.filter(around, lambda p: p["r"].between(0, height - 1) & p["c"].between(0, width - 1))
    return F.transform(inside, lambda p: (p["r"] * width + p["c"]).cast("int"))


def displacement(cell: Column, reference: Column, width: int) -> Column:
    return F.hypot((column_of(cell, width) - column_of(reference, width)).cast("double"),
                   (row_of(cell, width) - row_of(reference, width)).cast("double"))


def cell_groups(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Bridge of spatial groups: a cell belongs to several (fixed size: the grid)."""
    cells = spark.range(height * width, numPartitions=1).select(F.col("id").cast("int").alias("cell"))
    row, column = row_of(F.col("cell"), width), column_of(F.col("cell"), width)
    border = (row == 0) | (row == height - 1) | (column == 0) | (column == width - 1)
    ring = (row.between(1, height - 2) & column.between(1, width - 2)
            & ((row == 1) | (row == height - 2) | (column == 1) | (column == width - 2)))
    names = F.array_compact(F.array(
        F.when(border, F.lit("outer_border")), F.when(ring, F.lit("second_ring")),
        F.when(~border & ~ring, F.lit("interior")), F.when(row == 0, F.lit("top_row")),
        F.when(row == height - 1, F.lit("bottom_row")), F.when(column == 0, F.lit("left_col")),
        F.when(column == width - 1, F.lit("right_col"))))
    return cells.select("cell", F.explode(names).alias("grp"))


# Rigid transforms: struct(cos, sin, tx, ty), canonical = R * source + t ---------------------------------------------

def rigid(angle: Column, tx: Column, ty: Column) -> Column:
    return F.struct(F.cos(angle).alias("cos"), F.sin(angle).alias("sin"), tx.alias("tx"), ty.alias("ty"))


def rigid_about(angle: Column, cx: Column, cy: Column, to_x: Column, to_y: Column) -> Column:
    """Rotation by ``angle`` that carries (cx, cy) onto (to_x, to_y)."""
    c, s = F.cos(angle), F.sin(angle)
    return F.struct(c.alias("cos"), s.alias("sin"),
                    (to_x - (c * cx - s * cy)).alias("tx"), (to_y - (s * cx + c * cy)).alias("ty"))


def forward_x(t: Column, x: Column, y: Column) -> Column:
    return t["cos"] * x - t["sin"] * y + t["tx"]


def forward_y(t: Column, x: Column, y: Column) -> Column:
    return t["sin"] * x + t["cos"] * y + t["ty"]


def backward_x(t: Column, x: Column, y: Column) -> Column:
    return t["cos"] * (x - t["tx"]) + t["sin"] * (y - t["ty"])


def backward_y(t: Column, x: Column, y: Column) -> Column:
    return -t["sin"] * (x - t["tx"]) + t["cos"] * (y - t["ty"])


def cell_centre(index: Column, size: float) -> Column:
    """Pixel coordinate of the centre of the index-th cell of ``size`` pixels."""
    return (index + F.lit(0.5)) * F.lit(float(size)) - F.lit(0.5)


def cell_at(x: Column, y: Column, size: float, height: int, width: int) -> Column:
    """Cell that contains the pixel coordinate, null outside the grid."""
    column = F.floor((x + 0.5) / F.lit(float(size))).cast("int")
    row = F.floor((y + 0.5) / F.lit(float(size))).cast("int")
    return F.when(column.between(0, width - 1) & row.between(0, height - 1), row * width + column)


# Circular statistics -------------------------------------------------------------------------------------------------

def circular_error(difference: Column, period: float) -> Column:
    """|difference| on a circle of the given period."""
    d = F.pmod(difference, F.lit(float(period)))
    return F.least(d, F.lit(float(period)) - d)


def circular_deviation(value: Column, centre: Column, period: float) -> Column:
    """Distance to a centre in [0, period/2]."""
    half = F.lit(period / 2.0)
    return F.abs(F.pmod(value - centre + half, F.lit(float(period))) - half)


def circular_moments(value: str, period: float) -> Sequence[Column]:
    """Mean direction and circular standard deviation of ``value`` modulo ``period``, as aggregates."""
    phase = F.col(value) * F.lit(2 * math.pi / period)
    c, s = F.avg(F.cos(phase)), F.avg(F.sin(phase))
    mean = F.pmod(F.atan2(s, c) * F.lit(period / (2 * math.pi)), F.lit(float(period)))
    resultant = F.least(F.hypot(c, s), F.lit(1.0))
    spread = F.when(resultant <= 1e-12, F.lit(float("inf"))).otherwise(
        F.sqrt(F.lit(-2.0) * F.ln(resultant)) * F.lit(period / (2 * math.pi)))
    return [mean.alias("circular_mean"), spread.alias("circular_std"), resultant.alias("resultant")]
