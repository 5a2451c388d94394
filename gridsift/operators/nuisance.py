"""How one change of the input moves the winning cell: records, decomposition and sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridsift.operators.describe import describe

CONDITION = ("family", "level", "variant")


def winners(maps: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The first cell with the largest z of each map, its raw score and counts above 3, 5 and 10."""
    best = F.max(F.struct(F.col("z").alias("z"), (-F.col("cell")).alias("c"), F.col("raw").alias("raw"),
                          *[F.col(c).alias(c) for c in carry]))
    out = maps.groupBy(*keys).agg(best.alias("_w"), F.max("raw").alias("max_raw"), *[
        F.count_if(F.col("z") > t).alias(f"cells_above_{t}") for t in (3, 5, 10)])
    return out.select(*keys, F.col("_w.z").alias("max_z"), (-F.col("_w.c")).cast("int").alias("max_cell"),
                      F.col("_w.raw").alias("raw_at_winner"), *[F.col(f"_w.{c}").alias(f"{c}_at_winner") for c in carry],
                      "max_raw", "cells_above_3", "cells_above_5", "cells_above_10")


def winner_records(changed: DataFrame, baseline: DataFrame, calibration: DataFrame,
                   keys: Sequence[str] = ("variant", "category", "image")) -> DataFrame:
    """Growth of the changed map at its winner against the baseline of the same image and variant.

    delta_max_z = (raw - raw0) / beta at the winner + (z0 at the winner - max z0).
    """
    keys = list(keys)
    won = winners(changed, [*keys, "family", "level"])
    top = baseline.groupBy(*keys).agg(F.max("z").alias("baseline_max_z"), F.max("raw").alias("baseline_max_raw"))
    at = baseline.select(*keys, F.col("cell").alias("max_cell"), F.col("raw").alias("raw0"), F.col("z").alias("z0"))
    beta = calibration.select("variant", "category", F.col("cell").alias("max_cell"), F.col("alpha").alias("alpha_at_winner"),
                              F.col("beta").alias("beta_at_winner"))
    joined = won.join(beta, ["variant", "category", "max_cell"]).join(top, keys).join(at, [*keys, "max_cell"])
    growth = F.col("raw_at_winner") - F.col("raw0")
    return joined.withColumn("delta_max_z", F.col("max_z") - F.col("baseline_max_z")).withColumn(
        "delta_max_raw", F.col("max_raw") - F.col("baseline_max_raw")).withColumn(
        "raw_growth_at_winner", growth).withColumn("same_cell_z_growth", growth / F.col("beta_at_winner")).withColumn(
        "winner_switch_penalty", F.col("z0") - F.col("baseline_max_z")).drop("raw0", "z0")


def channel_growth(changed: Column, baseline: Column, mean: Column, std: Column) -> Column:
    """Per-channel share of the raw growth of a cell: ((u-m)/s)^2 - ((u0-m)/s)^2 over C."""
    zipped = F.arrays_zip(changed.alias("u"), baseline.alias("b"), mean.alias("m"), std.alias("s"))

    def growth(row: Column) -> Column:
        now, then = (row["u"] - row["m"]) / row["s"], (row["b"] - row["m"]) / row["s"]
        return (now * now - then * then) / F.size(mean)

    return F.transform(zipped, growth)


def contribution_shape(growth: str) -> Sequence[Column]:
    """Positive channels, share of the five largest, effective number of channels."""
    positive = F.filter(growth, lambda v: v > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v * v)
    top = F.aggregate(F.slice(F.sort_array(positive, asc=False), 1, 5), F.lit(0.0), lambda a, v: a + v)
    return [F.size(positive).alias("positive_channel_count"),
            F.when(total == 0, 0.0).otherwise(top / total).alias("top5_positive_growth_share"),
            F.when(squares == 0, 0.0).otherwise(total * total / squares).alias("positive_effective_participation")]


def amplification(records: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """Difference of the second variant's peak change from the first's, split into raw, scaling and switch terms."""
    fields = ["delta_max_z", "raw_growth_at_winner", "beta_at_winner", "winner_switch_penalty"]
    side = lambda v, p: records.where(F.col("variant") == v).select(
        *keys, *[F.col(f).alias(f"{p}_{f}") for f in fields])
    j = side(first, "a").join(side(second, "b"), list(keys))
    raw = (F.col("b_raw_growth_at_winner") - F.col("a_raw_growth_at_winner")) / F.col("a_beta_at_winner")
    scaling = F.col("b_raw_growth_at_winner") * (1 / F.col("b_beta_at_winner") - 1 / F.col("a_beta_at_winner"))
    switch = F.col("b_winner_switch_penalty") - F.col("a_winner_switch_penalty")
    total = F.col("b_delta_max_z") - F.col("a_delta_max_z")
    checked = F.when(F.abs(total - raw - scaling - switch) <= 1e-8 * F.greatest(F.abs(total), F.lit(1.0)), total).otherwise(
        F.raise_error(F.lit("amplification terms do not add up")).cast("double"))
    return j.select(*keys, F.col("a_delta_max_z").alias("first_change"), F.col("b_delta_max_z").alias("second_change"),
                    checked.alias("amplification"), raw.alias("raw_term"), scaling.alias("scaling_term"),
                    switch.alias("switch_term"))


def response_summary(records: DataFrame, fields: Sequence[str], keys: Sequence[str] = CONDITION) -> DataFrame:
    """Distribution of every response field per condition."""
    return describe(records, keys, fields, [.05, .5, .95])


def family_stability(pairs: DataFrame, keys: Sequence[str] = ("family",)) -> DataFrame:
    """Per image the largest absolute change of either variant; then which variant is larger."""
    per = pairs.groupBy(*keys, "category", "image").agg(F.max(F.abs("first_change")).alias("a"),
                                                        F.max(F.abs("second_change")).alias("b"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("b") > F.col("a")).alias("second_larger"),
                                  F.count_if(F.col("a") > F.col("b")).alias("first_larger"),
                                  F.count_if(F.col("a") == F.col("b")).alias("ties"))


def worst_cases(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """k largest amplifications per key. The k-limit on the rank runs before the shuffle (window group limit)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("amplification").desc(), "category", "image", "level"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def slopes(records: DataFrame, keys: Sequence[str] = ("family", "variant", "category", "image"),
           low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Centred slope of the peak between the two levels and the steeper one-sided slope around level 1."""
    at = lambda level: F.max(F.when(F.abs(F.col("level") - level) < 1e-9, F.col("max_z")))
    p = records.groupBy(*keys).agg(at(low).alias("_lo"), at(1.0).alias("_mid"), at(high).alias("_hi"))
    return p.select(*keys, ((F.col("_hi") - F.col("_lo")) / (high - low)).alias("centred_slope"),
                    F.greatest(F.abs(F.col("_lo") - F.col("_mid")) / (1 - low),
                               F.abs(F.col("_hi") - F.col("_mid")) / (high - 1)).alias("one_sided"))


def cell_sensitivity(maps: DataFrame, keys: Sequence[str] = ("family", "variant", "category", "cell"),
                     low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Mean over images of the steeper one-sided and of the centred slope of each cell's z."""
    at = lambda level: F.max(F.when(F.abs(F.col("level") - level) < 1e-9, F.col("z")))
    p = maps.groupBy(*keys, "image").agg(at(low).alias("_lo"), at(1.0).alias("_mid"), at(high).alias("_hi"))
    return p.groupBy(*keys).agg(
        F.avg(F.greatest(F.abs(F.col("_lo") - F.col("_mid")) / (1 - low),
                         F.abs(F.col("_hi") - F.col("_mid")) / (high - 1))).alias("sensitivity"),
        F.avg(F.abs(F.col("_hi") - F.col("_lo")) / (high - low)).alias("centred_sensitivity"))


def winner_buckets(records: DataFrame, state: DataFrame) -> DataFrame:
    """Winning cells by whether their std and beta lie in the lower quartile of the grid.

    ``state(variant, category, cell, std, beta)`` has one row per cell, so its quartiles are of a bounded group.
    """
    limits = state.groupBy("variant", "category").agg(F.percentile("std", F.lit(.25)).alias("_s"),
                                                      F.percentile("beta", F.lit(.25)).alias("_b"))
    marked = state.join(limits, ["variant", "category"]).select(
        "variant", "category", F.col("cell").alias("max_cell"), (F.col("std") <= F.col("_s")).alias("low_std"),
        (F.col("beta") <= F.col("_b")).alias("low_beta"))
    bucket = (F.when(F.col("low_std") & F.col("low_beta"), "both").when(F.col("low_std"), "low_std")
              .when(F.col("low_beta"), "low_beta").otherwise("neither"))
    return records.join(marked, ["variant", "category", "max_cell"]).groupBy(
        "family", "variant", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("winners"))
