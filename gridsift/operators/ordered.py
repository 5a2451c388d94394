"""Ordered computations that keep working when one key holds most rows.

A window partitioned by such a key runs in one task. Here rows are range
partitioned by (key, order) and sorted, once; each slice is scanned where it
lies, in Arrow batches, and written with its own running values. A slice is a
range of values, so a key of any size is spread over as many tasks as there are
slices, and at most one key goes on from one slice to the next. What earlier
slices of that key add up to is therefore one small row a slice, found from the
slices' first and last rows and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FractionalType, IntegerType, LongType, StructField, StructType

from gridsift.session import kept

Order = Sequence[tuple[str, str]]


def _sorts(order: Order) -> list[Column]:
    return [F.col(name).desc() if way == "desc" else F.col(name).asc() for name, way in order]


class _Scan:
    """Running values over the sorted rows of one slice; a batch goes on where the one before it ended."""

    def __init__(self, keys: Sequence[str], sums: Mapping[str, str], lasts: Mapping[str, str], lags: Mapping[str, str]):
        self.keys, self.sums, self.lasts, self.lags = keys, sums, lasts, lags
        self.before: dict[str, pa.Array] | None = None
        self.totals = dict.fromkeys(sums, 0)

    def _starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Whether a row has another key than the row before it; nulls are equal."""
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = self.before is None
        for key in self.keys:
            column = batch.column(key)
            if self.before is not None:
                column, low = pa.concat_arrays([self.before[key], column]), 0
            else:
                low = 1
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            new[low:] |= differs.to_numpy(zero_copy_only=False)
        return new

    def _shifted(self, name: str, column: pa.Array) -> pa.Array:
        """The column behind its value in the row before the batch."""
        first = self.before[name] if self.before is not None else pa.nulls(1, column.type)
        return pa.concat_arrays([first, column])

    def add(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, new = batch.num_rows, self._starts(batch)
        row = np.arange(n)
        start = np.maximum.accumulate(np.where(new, row, 0))
        going_on = np.cumsum(new) == 0  # the key of the row before the batch
        out: dict[str, pa.Array] = {}
        for name, source in self.sums.items():
            value = batch.column(source).fill_null(0).to_numpy(zero_copy_only=False)
            if value.dtype.kind == "f":
                run = pd.Series(value).groupby(np.cumsum(new)).cumsum().to_numpy()
            else:
                value = value.astype(np.int64)
                total = np.cumsum(value)
                run = total - total[start] + value[start]
            run = np.where(going_on, run + self.totals[name], run)
            self.totals[name] = run[-1]
            out[name] = pa.array(run)
        for name, source in self.lasts.items():
            column = batch.column(source)
            seen = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), row, -1))
            own = seen >= start
            out[name] = self._shifted(name, column).take(pa.array(np.where(own, seen + 1, 0), mask=~own & ~going_on))
        for name, source in self.lags.items():
            out[name] = self._shifted(source, batch.column(source)).take(pa.array(row, mask=new))
        self.before = {c: batch.column(c).slice(n - 1) for c in {*self.keys, *self.lags.values()}} | {c: out[c].slice(n - 1) for c in self.lasts}
        out["_end"] = pa.array(np.append(new[1:], True))  # last row of its key here; in a later batch the key may go on
        return out


def running(df: DataFrame, keys: Sequence[str], order: Order, *, sums: Mapping[str, str] | None = None,
            lasts: Mapping[str, str] | None = None, lags: Mapping[str, str] | None = None,
            totals: bool = False) -> DataFrame:
    """Running aggregates per key, distributed by range: one exchange of the rows.

    ``sums``: output -> column of whole or real numbers, running sum up to and including the row, nulls as 0.
    ``lasts``: output -> column, latest non-null value up to and including the row.
    ``lags``: output -> column, value of the preceding row (never null columns).
    ``totals`` adds ``<output>_total`` for every sum. ``order`` must be unique
    within a key for a defined result; for lasts and lags it has one direction.
    """
    spark = df.sparkSession
    sums, lasts, lags = dict(sums or {}), dict(lasts or {}), dict(lags or {})
    keys, outs = list(keys), [*sums, *lasts, *lags]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = {out: DoubleType() if isinstance(kinds[c], FractionalType) else LongType() for out, c in sums.items()}
    made |= {out: kinds[c] for out, c in {**lasts, **lags}.items()}
    columns, sorts = df.columns, [*[F.col(k) for k in keys], *_sorts(order)]

    def scan(batches):
        state, place, piece = _Scan(keys, sums, lasts, lags), 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                found, n = state.add(batch), batch.num_rows
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[found[o] for o in outs],
                                                  pa.array(np.full(n, piece, dtype=np.int32)), pa.array(np.arange(place, place + n))],
                                                 names=[*columns, *outs, "_slice", "_place"])
                place += n

    schema = StructType([*df.schema.fields, *[StructField(o, made[o]) for o in outs], StructField("_slice", IntegerType()), StructField("_place", LongType())])
    # No fixed number of slices: the session's shuffle width is the upper bound and AQE merges small ranges.
    sliced = kept(df.repartitionByRange(*sorts).sortWithinPartitions(*sorts).mapInArrow(scan, schema), "slices")
    result, carried = sliced, _carried(sliced, keys, sums, lasts, lags)
    if carried:
        fields = [StructField("_slice", IntegerType()), *[StructField(f"_key_{k}", kinds[k]) for k in keys], *[StructField(f"_off_{o}", made[o]) for o in outs]]
        small = spark.createDataFrame(carried, StructType(fields)).withColumnRenamed("_slice", "_key__slice")
        earlier = (F.col("_slice") == F.col("_key__slice")) & _same(keys)
        result = sliced.join(small, earlier, "left").select(
            *columns, *[(F.col(o) + F.coalesce(f"_off_{o}", F.lit(0))).alias(o) for o in sums], *[F.coalesce(o, f"_off_{o}").alias(o) for o in lasts],
            *[F.when(F.col("_place") == 0, F.col(f"_off_{o}")).otherwise(F.col(o)).alias(o) for o in lags])
    if totals:
        # One row per key; written, so that its size is known and the join need not shuffle the rows.
        whole = kept(sliced.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*[F.sum(c).alias(f"{o}_total") for o, c in sums.items()]), "totals")
        result = result.join(whole, _same(keys))
    return result.select(*columns, *outs, *[f"{o}_total" for o in sums if totals])


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))  # null keys are keys too
    return same


def _carried(sliced: DataFrame, keys: Sequence[str], sums: Mapping[str, str], lasts: Mapping[str, str], lags: Mapping[str, str]) -> list[tuple]:
    """(slice, key, values) of the slices whose first key began in an earlier one: what those add up to. One row a slice at most."""
    # An inner alias, since an output may be called like a key.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = {"s": list(sums), "l": list(lasts), "g": list(lags.values())}
    values = [F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"{kind}{i}") for i, c in enumerate(names)]).alias(kind) for kind, names in ends.items()]
    edges = sliced.groupBy("_slice").agg(F.min_by(key, "_place").alias("first"), F.max_by(F.struct(key.alias("key"), *values), "_place").alias("last"))
    carried, before = [], None
    for edge in sorted(edges.collect(), key=lambda e: e["_slice"]):
        last = edge["last"]
        own = [list(last[kind])[1:] for kind in ends]
        if before is not None and before[0] == edge["first"]:
            carried.append((edge["_slice"], *edge["first"], *[v for part in before[1] for v in part]))
            if last["key"] == edge["first"]:  # the slice holds nothing else
                own[0] = [a + b for a, b in zip(before[1][0], own[0])]
                own[1] = [b if a is None else a for a, b in zip(own[1], before[1][1])]
        before = last["key"], own
    return carried


def numbered(df: DataFrame, keys: Sequence[str], order: Order, name: str = "position") -> DataFrame:
    """1-based position within the key (unique order)."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, sums={name: "_one"}).drop("_one")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places: one row per (key, value)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running(counts, keys, [(value, "asc")], sums={"_upto": "ties"})
    return ranked.select(*keys, value, "ties",
                         (F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)).alias(name))


def latest_before(samples: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, value: str,
                  default: str, tie: str) -> DataFrame:
    """Backward as-of join: each sample gets the latest change at or before its time.

    ``tie`` makes the order unique; at equal times changes come before samples.
    """
    columns = samples.columns
    left = samples.withColumn("_kind", F.lit(1)).withColumn("_change", F.lit(None).cast("string"))
    right = changes.select(*keys, time, tie, F.lit(0).alias("_kind"), F.col(value).alias("_change"))
    both = left.unionByName(right, allowMissingColumns=True)
    scanned = running(both, keys, [(time, "asc"), ("_kind", "asc"), (tie, "asc")], lasts={"_latest": "_change"})
    return scanned.where("_kind = 1").select(*columns, F.coalesce("_latest", F.lit(default)).alias(value))


def nearest_on_circle(queries: DataFrame, references: DataFrame, keys: Sequence[str], angle: str, period: float,
                      tie: str, name: str = "nearest") -> DataFrame:
    """Smallest circular distance from each query angle to any reference angle of its key.

    The nearest reference is a neighbour in angular order or, across the seam,
    the first or last one, so two ordered scans replace the all-pairs join.
    """
    turn = F.pmod(F.col(angle), F.lit(float(period)))
    left = queries.withColumn("_a", turn).withColumn("_kind", F.lit(1)).withColumn("_ref", F.lit(None).cast("double"))
    points = references.select(*keys, turn.alias("_a")).distinct()
    right = points.select(*keys, "_a", F.lit(0).alias("_kind"), F.col("_a").alias("_ref"))
    both = left.unionByName(right, allowMissingColumns=True)
    below = running(both, keys, [("_a", "asc"), ("_kind", "asc"), (tie, "asc")], lasts={"_below": "_ref"})
    around = running(below, keys, [("_a", "desc"), ("_kind", "desc"), (tie, "desc")], lasts={"_above": "_ref"})
    ends = points.groupBy(*keys).agg(F.min("_a").alias("_first"), F.max("_a").alias("_last"))

    def gap(other: str) -> Column:
        d = F.pmod(F.col("_a") - F.col(other), F.lit(float(period)))
        return F.least(d, F.lit(float(period)) - d)

    return (around.where("_kind = 1").join(ends, list(keys), "left")
            .select(*queries.columns, F.least(*[gap(c) for c in ("_below", "_above", "_first", "_last")]).alias(name)))
