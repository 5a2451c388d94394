"""Contract checks as tables of violations: an empty result means the contract holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The dataset's categories in their canonical order, and those that are textures.
CATEGORIES = ("bottle", "cable", "capsule", "carpet", "grid", "hazelnut", "leather", "metal_nut", "pill", "screw", "tile",
              "toothbrush", "transistor", "wood", "zipper")
TEXTURES = ("carpet", "grid", "leather", "tile", "wood")
NAME_PATTERN = r"^[a-z0-9]+(_[a-z0-9]+)*_[0-9]+\.png$"


def enforced(violations: DataFrame, message: str) -> None:
    """Fail when a violation table is not empty (reads at most one row)."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def parsed_name(name: Column, categories: Sequence[str] = CATEGORIES) -> tuple[Column, Column]:
    """Category and defect of ``category_defect_index.png``; null where the name is invalid."""
    known = "|".join(sorted(categories, key=len, reverse=True))
    pattern = f"^({known})_([a-z0-9_]+)_([0-9]+)\\.png$"
    valid = name.rlike(NAME_PATTERN) & name.rlike(pattern)
    return (F.when(valid, F.regexp_extract(name, pattern, 1)), F.when(valid, F.regexp_extract(name, pattern, 2)))


def duplicate_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def annotation_problems(annotations: DataFrame, classes: DataFrame, tags: DataFrame,
                        categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Images whose annotation contradicts its name, size, role or the project's dictionaries.

    ``annotations(role, image, category, defect, width, height, size, tags, objects)``; the dictionaries are the
    project's own id lists. Unknown ids surface as unmatched rows of the left joins.
    """
    per_tag = annotations.select("image", "category", F.explode_outer("tags").alias("_t")).select(
        "image", "category", F.col("_t.tagId").alias("id"), F.col("_t.name").alias("_said")).join(
        tags.select("id", F.col("name").alias("_known")), "id", "left")
    tag_state = per_tag.groupBy("image").agg(
        F.count_if(F.col("id").isNotNull() & (F.col("_known").isNull() | (F.col("_known") != F.col("_said")))).alias("_bad_tag"),
        F.count_if(F.col("_known").isin(*categories) & (F.col("_known") != F.col("category"))).alias("_other_category"),
        F.coalesce(F.bool_or(F.col("_known") == F.col("category")), F.lit(False)).alias("_category_tag"),
        F.coalesce(F.bool_or(F.col("_known") == "good"), F.lit(False)).alias("_good_tag"))
    per_object = annotations.select("image", "defect", F.explode_outer("objects").alias("_o")).select(
        "image", "defect", F.col("_o.classId").alias("id"), F.col("_o.classTitle").alias("_said"),
        F.col("_o.geometryType").alias("_type")).join(classes.select("id", F.col("title").alias("_known")), "id", "left")
    object_state = per_object.groupBy("image").agg(
        F.count("id").alias("_objects"),
        F.count_if(F.col("id").isNotNull() & (F.col("_known").isNull() | (F.col("_known") != F.col("_said"))
                                              | (F.col("_known") != F.col("defect")) | (F.col("_type") != "bitmap"))).alias("_bad_object"))
    j = annotations.join(tag_state, "image").join(object_state, "image")
    good = F.col("defect") == "good"
    rules = {
        "size": (F.col("size.width") != F.col("width")) | (F.col("size.height") != F.col("height")),
        "unknown_tag": F.col("_bad_tag") > 0, "wrong_category": (F.col("_other_category") > 0) | ~F.col("_category_tag"),
        "good_tag": F.col("_good_tag") != good, "objects": good != (F.col("_objects") == 0),
        "train_not_good": (F.col("role") == "train") & ~good, "bad_object": F.col("_bad_object") > 0}
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return j.select("role", "image", F.explode(broken).alias("problem"))


def incompatible(models: DataFrame, encoders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models without exactly one encoder row that agrees on every key."""
    match = encoders.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"))
    return models.join(match, list(keys), "left").where("coalesce(_matches, 0) <> 1").drop("_matches")


def map_problems(cells: DataFrame, expected: int, keys: Sequence[str] = ("image",), cell: str = "cell") -> DataFrame:
    """Maps with missing, duplicate or non-finite cells."""
    v = F.col("raw")
    out = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(cell).alias("cells"),
        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"))
    return out.where((F.col("rows") != expected) | (F.col("cells") != expected) | (F.col("not_finite") > 0))


def membership_problems(predictions: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("category", "image")) -> DataFrame:
    """Predictions that are not in the manifest, manifest rows without prediction, and duplicates."""
    keys = list(keys)
    extra = predictions.join(manifest, keys, "left_anti").select(*keys, F.lit("not_in_manifest").alias("problem"))
    absent = manifest.join(predictions, keys, "left_anti").select(*keys, F.lit("no_prediction").alias("problem"))
    twice = duplicate_ids(predictions, keys).select(*keys, F.lit("duplicate").alias("problem"))
    return extra.unionByName(absent).unionByName(twice)


def label_problems(predictions: DataFrame) -> DataFrame:
    """label is good exactly when the defect is good."""
    return predictions.where((F.col("label") == "good") != (F.col("defect") == "good"))


def beyond_tolerance(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, absolute: float = 1e-8,
                     relative: float = 1e-10) -> DataFrame:
    """Elements that differ by more than absolute + relative * |expected|, or exist on one side only."""
    a = actual.select(*keys, F.col(value).alias("actual"))
    b = expected.select(*keys, F.col(value).alias("expected"))
    j = a.join(b, list(keys), "full")
    off = F.abs(F.col("actual") - F.col("expected")) > absolute + relative * F.abs(F.col("expected"))
    return j.where(F.col("actual").isNull() | F.col("expected").isNull() | off)


def allowed(rows: DataFrame, allow_list: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(allow_list.select(*keys).distinct(), list(keys), "left_semi")


def forbidden(rows: DataFrame, allow_list: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows outside the allow-list; must be empty before a calibration-only job reads them."""
    return rows.join(allow_list.select(*keys).distinct(), list(keys), "left_anti")


def population(attempted: DataFrame, exclusions: DataFrame, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """Attempted rows minus the frozen exclusions; a given size must be met exactly."""
    usable = attempted.join(exclusions.select(*keys).distinct(), list(keys), "left_anti")
    if expected is not None and usable.count() != expected:
        raise ValueError(f"usable population is not {expected}")
    return usable


def drift(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Content that appeared, vanished or changed between two inventories."""
    j = now.select(key, F.col(digest).alias("now")).join(before.select(key, F.col(digest).alias("before")), key, "full")
    state = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(
        F.col("now") != F.col("before"), "changed")
    return j.select(key, state.alias("state")).where("state IS NOT NULL")


def selection_problems(selected: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Selected names that are chosen twice or that do not exist: one row per name and problem."""
    counts = selected.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    twice = counts.where("_n > 1").select(name, F.lit("duplicate").alias("problem"))
    return twice.unionByName(counts.join(known.select(name).distinct(), name, "left_anti").select(name, F.lit("unknown").alias("problem")))


def order_problems(attempted: DataFrame, exclusions: DataFrame, usable: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Where the usable rows are not the attempted ones without the exclusions in the same order: expected and actual place.

    Places are counted again among the rows that stay, so both sides count from 1 without gaps. ``keys`` are the group
    and then the row's own name.
    """
    from gridsift.operators.ordered import numbered
    left = numbered(attempted.join(exclusions.select(*keys).distinct(), list(keys), "left_anti"), keys[:-1], [(place, "asc"), (keys[-1], "asc")], "expected")
    right = numbered(usable, keys[:-1], [(place, "asc"), (keys[-1], "asc")], "actual")
    return left.select(*keys, "expected").join(right.select(*keys, "actual"), list(keys), "full").where("NOT (expected <=> actual)")
