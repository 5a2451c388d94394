"""Exact distribution summaries of groups of any size.

``percentile`` keeps a group's distinct values in one task; here the wanted
places are found by radix selection. A first histogram per group counts values by
their leading bits (sign, exponent, four bits of the fraction); only bins that hold a
wanted place are cut again, into 65,536 parts each, until a bin holds one value. Values
are combined map side, so what is shuffled are bins, never values, and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridsift.session import kept

#: Parts of a bin that is cut again; a factor of 2 is cut into OCTAVE bins at first.
PARTS, OCTAVE = 1 << 16, 16


def long_form(df: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows (keys, field, value[, weight]); null values drop out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    extra = [F.col(weight).cast("long").alias("weight")] if weight else []
    return df.select(*keys, *extra, F.explode(pairs).alias("_p")).select(
        *keys, *(["weight"] if weight else []), "_p.field", "_p.value").where("value is not null")


def _label(probability: float) -> str:
    return f"p{round(probability * 100):02d}"


def _leading(value: Column) -> Column:
    """Bin of a value by its size: rises with the value, and a bin spans less than a sixteenth of a power of two."""
    size = F.floor(F.log2(F.abs(value)) * OCTAVE).cast("long") + 1100 * OCTAVE
    ends = F.lit(1 << 20)
    return (F.when(F.isnan(value), ends + 1).when(value == float("inf"), ends).when(value == float("-inf"), -ends)
            .when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)))


def _bins(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    count = F.sum(weight) if weight else F.count(F.lit(1))
    product = F.col(value) * F.col(weight) if weight else F.col(value)
    return rows.groupBy(*keys, "_low", "_bin").agg(count.cast("long").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.sum(product).alias("_sum"))


def _held(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins that hold wanted places, with those. A group has a bounded number of bins: 2^20 leading ones, PARTS for each place."""
    before = Window.partitionBy(*keys, "_low").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("_before", F.col("_low") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.filter("_places", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))
    return placed.withColumn("_places", inside).where(F.size("_places") > 0)


def quantiles(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], *, value: str = "value",
              weight: str | None = None, nearest_rank: bool = False) -> DataFrame:
    """n, min, max, mean and exact quantiles per key.

    Linear interpolation at p*(n-1), or the nearest rank ceil(p*n). A weighted
    row stands for that many equal observations. Keys may be null; NaN counts as the largest value.
    """
    written = kept(values.select(*keys, value, *([weight] if weight else [])), "values")
    return _selected(written, keys, probabilities, value, weight, nearest_rank)


def _selected(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], value: str, weight: str | None, nearest_rank: bool) -> DataFrame:
    """``rows`` are read once for each cut: two or three times as a rule, five at most."""
    keys = list(keys)
    if weight:
        rows = rows.where(F.col(weight) > 0)
    whole = Window.partitionBy(*keys)
    n = F.col("n")
    if nearest_rank:
        place = {p: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)) for p in probabilities}
        wanted = list(place.values())
    else:
        low = {p: F.floor((n - 1) * F.lit(p)) for p in probabilities}
        high = {p: F.least(low[p] + 1, n - 1) for p in probabilities}
        wanted = [*low.values(), *high.values()]
    # ``_low`` is the place of a bin's first value; at first there is one bin, the group.
    leading = kept(_bins(rows.select("*", F.lit(0).cast("long").alias("_low"), _leading(F.col(value)).alias("_bin")), keys, value, weight), "bins")
    facts = leading.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_min").alias("min"), F.max("_max").alias("max"), (F.sum("_sum") / F.sum("_n")).alias("mean"))
    bins = leading.withColumn("n", F.sum("_n").over(whole)).withColumn("_places", F.array_distinct(F.array(*[w.cast("long") for w in wanted])))
    found = []
    while True:
        held = kept(_held(bins, keys), "held")
        found.append(held.where(F.col("_min") == F.col("_max")).select(*keys, F.explode("_places").alias("_place"), F.col("_min").alias("_value")))
        cut = held.where(F.col("_min") < F.col("_max"))
        if cut.isEmpty():
            break
        # One row per group: its bins are few and lie apart, so a value is in one of them at most.
        spans = kept(cut.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.collect_list(F.struct("_before", "_min", "_max", "_places")).alias("_spans")), "spans")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        met = rows.join(spans, same).select(*rows.columns, F.get(F.filter("_spans", lambda s: F.col(value).between(s["_min"], s["_max"])), F.lit(0)).alias("_span")).where("_span is not null")
        part = F.floor((F.col(value) - F.col("_span._min")) / (F.col("_span._max") - F.col("_span._min")) * PARTS)
        parts = _bins(met.withColumn("_low", F.col("_span._before")).withColumn("_bin", part), keys, value, weight)
        places = cut.select(*keys, F.col("_before").alias("_low"), "_places")
        bins = parts.alias("a").join(places.alias("b"), _equal(keys, "_low")).select("a.*", "b._places")
    values_at = found[0]
    for more in found[1:]:
        values_at = values_at.unionByName(more)
    at = F.map_from_entries(F.collect_list(F.struct("_place", "_value")))
    picked = values_at.groupBy(*keys).agg(at.alias("_at"))
    joined = facts.alias("a").join(picked.alias("b"), _equal(keys)).select("a.*", "_at")
    value_at = lambda p: F.element_at("_at", p.cast("long"))
    if nearest_rank:
        chosen = [value_at(place[p]).alias(_label(p)) for p in probabilities]
    else:
        chosen = []
        for p in probabilities:
            exact = (n - 1) * F.lit(p)
            chosen.append((value_at(low[p]) + (exact - F.floor(exact)) * (value_at(high[p]) - value_at(low[p]))).alias(_label(p)))
    return joined.select(*keys, "n", "min", "max", "mean", *chosen)


def _equal(keys: Sequence[str], *more: str) -> Column:
    same = F.lit(True)
    for k in [*keys, *more]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return same


def describe(df: DataFrame, keys: Sequence[str], fields: Sequence[str], probabilities: Sequence[float], *,
             weight: str | None = None) -> DataFrame:
    """One summary row per (keys, field). The fields are written side by side and taken apart as they are read."""
    written = kept(df.select(*keys, *fields, *([weight] if weight else [])), "fields")
    return _selected(long_form(written, keys, fields, weight), [*keys, "field"], probabilities, "value", "weight" if weight else None, False)
