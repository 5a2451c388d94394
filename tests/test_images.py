import base64
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift import schemas
from gridsift.images import bitmaps, resample, shapes
from gridsift.images.photometry import change, to_bytes
from gridsift.operators import imaging as I
from gridsift.sources import dataset, maps as map_files, measurements, stores


def png(pixels, colour):
    """Small PNG writer for fixtures; every row uses another filter type 0..2."""
    h, w, c = pixels.shape
    lines, above = b"", np.zeros(w * c, dtype=np.int64)
    for y in range(h):
        line, kind = pixels[y].ravel().astype(np.int64), y % 3
        left = np.concatenate([np.zeros(c, dtype=np.int64), line[:-c]])
        lines += bytes([kind]) + ((line - (0, left, above)[kind]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return bitmaps.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


ALPHA = np.array([[[0, 0, 0, 255], [255, 255, 255, 0]], [[0, 0, 0, 0], [255, 255, 255, 255]]], dtype=np.uint8)


def test_bitmaps_are_placed_and_united():
    data = png(ALPHA, 6)
    mask = bitmaps.placed([(zlib.compress(data), 1, 2), (data, 2, 2), (data, 1, 2)], 5, 4)
    assert np.flatnonzero(mask).tolist() == [9, 10, 14, 15]
    grey = png(np.array([[[0], [255]]], dtype=np.uint8), 0)
    assert np.flatnonzero(bitmaps.placed([(grey, 0, 0)], 5, 4)).tolist() == [1]
    for x, y in ((3, 4), (-1, 0)):
        with pytest.raises(ValueError, match="outside"):
            bitmaps.placed([(data, x, y)], 5, 4)


def test_annotation_masks(spark):
    document = {"size": {"width": 4, "height": 5}, "tags": [], "objects": [{"classId": 1, "classTitle": "bent", "geometryType": "bitmap",
                "bitmap": {"data": base64.b64encode(png(ALPHA, 6)).decode(), "origin": [1, 2]}}]}
    df = spark.createDataFrame([("a", json.dumps(document))], "image string, doc string").withColumn("d", F.from_json("doc", schemas.ANNOTATION))
    row = I.annotation_masks(df.select("image", "d.objects", "d.size.height", "d.size.width"), ["image"]).head()
    assert [i for i, v in enumerate(row["mask"]) if v] == [9, 14]


def brute_components(mask):
    out, n = np.zeros(mask.shape, dtype=int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        out[start] = n
        while stack:
            y, x = stack.pop()
            for yy in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for xx in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[yy, xx] and not out[yy, xx]:
                        out[yy, xx] = n
                        stack.append((yy, xx))
    return out


def test_components_match_flood_fill():
    rng = np.random.default_rng(2)
    for p in (.2, .4, .6):
        mask = rng.random((23, 31)) < p
        assert (shapes.components(mask) == brute_components(mask)).all()
    assert shapes.components(np.eye(2, dtype=bool)).max() == 1


def test_fill_ring_bands():
    mask = np.zeros((9, 9), dtype=bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    full = shapes.filled(mask)
    assert full[4, 4] and full.sum() == 25
    ring = shapes.ring(full, 1)
    assert ring.sum() == 49 - 25 and not (ring & full).any()
    bands = shapes.bands(full, 1)
    assert (bands == 1).sum() == 9 and (bands == 2).sum() == 16 + 20


def test_fourfold_pose_follows_a_turn():
    y, x = np.mgrid[0:101, 0:101] - 50.0
    for degrees in (0, 10, 30):
        a = math.radians(degrees)
        u, v = math.cos(a) * x + math.sin(a) * y, -math.sin(a) * x + math.cos(a) * y
        gray = np.where((abs(u) < 28) & (abs(v) < 28), 200, 20)
        pose = shapes.fourfold_pose(gray, 1.0)
        error = (pose["angle"] - degrees + 45) % 90 - 45
        assert pose["status"] == "SUCCESS" and abs(abs(error) - 45) < 1.5 and abs(pose["cx"] - 50) < .1
    assert shapes.fourfold_pose(np.full((20, 20), 7))["status"] == "FAILURE"


def test_axis_pose_of_a_bar():
    mask = np.zeros((40, 60), dtype=bool)
    mask[18:22, 10:50] = True
    mask[14:26, 42:50] = True
    pose = shapes.axis_pose(mask, "AXIS_WITH_POLARITY", scale=1.0)
    assert pose["state"] == "OK" and pose["polarity"] > 0 and abs(pose["axis"]) < 1e-9
    assert shapes.axis_pose(mask[:, ::-1], "AXIS_WITH_POLARITY", scale=1.0)["angle"] == pytest.approx(180)
    assert shapes.axis_pose(np.zeros((5, 5), dtype=bool), "AXIS")["state"] == "SEGMENTATION_FAILURE"


def test_otsu_is_the_first_best_threshold():
    gray = np.array([10] * 50 + [200] * 30)
    assert shapes.otsu(gray) == 10
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, 500)
    best, at = -1, 0
    for t in range(256):
        low, high = gray[gray <= t], gray[gray > t]
        value = len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0
        if value > best * (1 + 1e-12):
            best, at = value, t
    assert shapes.otsu(gray) == at


def test_identity_changes_keep_pixels():
    image = np.random.default_rng(1).integers(0, 256, (12, 12, 1)).astype(float)
    for family, level in (("TRANSLATION_X", 0), ("TRANSLATION_Y", 0), ("ROTATION", 0), ("SCALE", 1)):
        assert (resample.moved(image, family, level) == image).all()
    for family in ("BRIGHTNESS", "CONTRAST", "GAMMA"):
        assert (to_bytes(change(image, family, 1.0)) == image).all()
    assert (resample.moved(image, "TRANSLATION_X", 2)[:, 2:] == image[:, :-2]).all()
    assert (resample.warped(image, np.eye(3)) == image).all()


def test_canonical_samples_keep_constants_and_turn_exactly():
    flat = np.full((40, 40, 1), 77.0)
    t = resample.rigid(17.0, 20.0, 18.0, 19.5, 19.5)
    for kernel in ("bilinear", "bicubic", "tent"):
        assert np.allclose(resample.canonical_samples(flat, t, 16, kernel), 77.0)
    assert resample.rigid(90.0, 0, 0, 0, 0)[:2] == (0.0, -1.0) and resample.rigid(-90.0, 0, 0, 0, 0)[:2] == (0.0, 1.0)
    image = np.random.default_rng(1).integers(0, 256, (8, 8, 1)).astype(float)
    quarter = resample.canonical_samples(image, resample.rigid(90.0, 3.5, 3.5, 3.5, 3.5), 8, "bilinear")
    assert np.allclose(quarter[..., 0], np.rot90(image[..., 0]))


# Files -----------------------------------------------------------------------------------------------------------------

@pytest.fixture
def tree(tmp_path):
    (tmp_path / "train/img").mkdir(parents=True)
    (tmp_path / "train/ann").mkdir()
    for name, size in (("wood_good_000.png", (3, 5)), ("wood_good_001.png", (2, 2))):
        (tmp_path / "train/img" / name).write_bytes(png(np.arange(size[0] * size[1] * 3).reshape(*size, 3).astype(np.uint8), 2))
        (tmp_path / "train/ann" / f"{name}.json").write_text(json.dumps({
            "size": {"width": size[1], "height": size[0] + (name.endswith("1.png"))}, "tags": [{"tagId": 1, "name": "wood"}, {"tagId": 2, "name": "good"}], "objects": []}))
    (tmp_path / "meta.json").write_text(json.dumps({"classes": [{"id": 10, "title": "bent"}], "tags": [{"id": 1, "name": "wood"}, {"id": 2, "name": "good"}]}))
    return tmp_path


def test_dataset_scan_and_annotations(spark, tree):
    from gridsift.operators.checks import annotation_problems
    files = dataset.image_files(spark, str(tree), "train")
    assert {(r.image, r.category, r.defect, r.width, r.height) for r in files.drop("content").collect()} == {
        ("wood_good_000.png", "wood", "good", 5, 3), ("wood_good_001.png", "wood", "good", 2, 2)}
    classes, tags = dataset.dictionaries(spark, str(tree / "meta.json"))
    notes = dataset.annotations(spark, str(tree), "train").join(files.select("image", "category", "defect", "width", "height"), "image")
    assert {(r.image, r.problem) for r in annotation_problems(notes, classes, tags).collect()} == {("wood_good_001.png", "size")}
    decoded = dataset.decoded(spark, str(tree), "train")
    words = {r.image: r.words for r in I.rgb_words(decoded).collect()}
    assert [w & 0xFFFFFF for w in words["wood_good_001.png"]][:2] == [0x000102, 0x030405]


def test_manifests_and_inventory(spark, tmp_path):
    (tmp_path / "wood").mkdir()
    (tmp_path / "wood/fit.txt").write_text("﻿b.png\n\n a.png\r\n", encoding="utf-8")
    rows = dataset.manifest(spark, str(tmp_path / "*" / "*.txt")).orderBy("ord").collect()
    assert [(r.category, r.manifest, r.image) for r in rows] == [("wood", "fit", "b.png"), ("wood", "fit", "a.png")]
    got = dataset.inventory(spark, str(tmp_path)).collect()
    assert [(r.path) for r in got] == ["wood/fit.txt"] and len(got[0].sha256) == 64
    split = spark.createDataFrame([("wood", "a.png", 1, "fit")], "category string, image string, ord long, split string")
    dataset.write_manifests(split, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        dataset.write_manifests(split, str(tmp_path / "out"))


def test_map_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [float(i) for i in range(6)])], "image string, map array<double>")
    map_files.write_arrays(df, str(tmp_path / "m"), height=2, width=3, geometry_id="g", score_kind="z", format_id="f", dtype="float32").collect()
    arrays, notes = map_files.read_arrays(spark, str(tmp_path / "m")), map_files.read_sidecars(spark, str(tmp_path / "m"))
    row = arrays.head()
    assert (row.rows, row.cols, row.dtype, row["values"]) == (2, 3, "float32", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    assert map_files.sidecar_problems(arrays, notes).count() == 0
    broken = notes.withColumn("sha256", F.lit("0"))
    assert [r.problem for r in map_files.sidecar_problems(arrays, broken).collect()] == ["sha256"]
    np.save(tmp_path / "bad.npy", np.zeros((2, 2, 2)))
    with pytest.raises(ValueError, match="C-ordered"):
        map_files.parse_npy((tmp_path / "bad.npy").read_bytes())
    with pytest.raises(ValueError, match="length"):
        map_files.parse_npy((tmp_path / "m/a.npy").read_bytes()[:-4])


def test_map_csv(spark, tmp_path):
    rows = [("a", r, c, 1.0) for r in range(2) for c in range(2)] + [("b", 0, 0, 1.0), ("b", 0, 0, 1.0), ("b", 1, 0, 1.0), ("b", 1, 1, 1.0)]
    spark.createDataFrame(rows, "image string, row int, col int, raw double").write.option("header", True).csv(str(tmp_path / "c"))
    got = map_files.map_csv_problems(map_files.read_map_csv(spark, str(tmp_path / "c")), 2, 2).collect()
    assert [(r.image, r.rows, r.cells) for r in got] == [("b", 4, 3)]


def test_model_store_is_refused_when_changed(spark, tmp_path):
    model = spark.createDataFrame([("c", i, 3, [1.0], [1.0], [1.0]) for i in range(2)], "category string, cell int, n long, mean array<double>, "
                                  "std_sample array<double>, std array<double>")
    cal = spark.createDataFrame([("c", i, 3, 0.0, 1.0, 1.0) for i in range(2)], "category string, cell int, n long, alpha double, beta_sample double, beta double")
    path = str(tmp_path / "s")
    stores.write_model(model, cal, {"encoder": "x"}, path)
    assert stores.read_model(spark, path, {"encoder": "x"})[0].count() == 2
    with pytest.raises(ValueError, match="refused"):
        stores.read_model(spark, path, {"encoder": "y"})
    cal.withColumn("alpha", F.lit(9.0)).write.mode("overwrite").partitionBy("category").parquet(f"{path}/calibration")
    with pytest.raises(ValueError, match="payload"):
        stores.read_model(spark, path, {"encoder": "x"})


def test_latency_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"benchmark": "a.b.detect", "primaryMetric": {"score": 1.0, "rawDataHistogram": [[[[1.5, 2], [2.5, 1]]], [[[9.0, 4]]]]}}]))
    got = measurements.latency_histograms(spark, str(tmp_path / "b.json")).collect()
    assert {(r.region, r.fork, r.elapsed, r["count"]) for r in got} == {("detect", 0, 1.5, 2), ("detect", 0, 2.5, 1), ("detect", 1, 9.0, 4)}
    (tmp_path / "l.csv").write_text("process,pid,region,iteration,elapsed_ns\n1,7,full,0,2500\n")
    assert measurements.latency_samples(spark, str(tmp_path / "l.csv")).head().elapsed == 2.5
    (tmp_path / "m.csv").write_text("sample_id,timestamp_utc,pid,start_time_utc,working_set_bytes,private_bytes,lifetime_peak_working_set_bytes,status,reason\n"
                                    "1,2026-01-01T00:00:00Z,7,t0,10,,12,partial,private_bytes\n")
    row = measurements.process_samples(spark, str(tmp_path / "m.csv"), "r").head()
    assert row.private_bytes is None and row.working_set_bytes == 10 and row.process == "7/t0"


def test_map_files_are_opened_once_by_few_tasks(spark, tmp_path):
    maps = spark.createDataFrame([(str(i), [float(i), 0.5]) for i in range(200)], "image string, map array<double>")
    map_files.write_arrays(maps, str(tmp_path / "m"), height=1, width=2, geometry_id="g", score_kind="raw", format_id="f").count()
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    arrays, notes = map_files.read_once(spark, str(tmp_path / "m"))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {r.stem: r["values"] for r in arrays.collect()} == {str(i): [float(i), 0.5] for i in range(200)}
    assert map_files.sidecar_problems(arrays, notes).count() == 0
    for table in (arrays, notes):
        files = table.inputFiles()
        assert all(f.endswith(".parquet") for f in files) and len(files) <= spark.sparkContext.defaultParallelism + 1
