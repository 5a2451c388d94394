"""Image jobs: one stage per image, no shuffle of pixels; results are tables of masks, poses, tensors and statistics."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from gridsift.images import bitmaps, resample, shapes
from gridsift.images.photometry import luminance_of


def each_image(images: DataFrame, keep: Sequence[str], produced: str, function: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """Rows of ``function`` for every image row, with the ``keep`` columns repeated."""
    added = StructType.fromDDL(produced)
    schema = StructType([images.schema[k] for k in keep] + list(added.fields))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{**{k: record[k] for k in keep}, **out} for record in frame.to_dict("records") for out in function(record)]
            yield pd.DataFrame(rows, columns=schema.names)

    return images.mapInPandas(run, schema)


def _plane(values, height: int, width: int) -> np.ndarray:
    return np.asarray(values).reshape(height, width)


def _colour(values, height: int, width: int) -> np.ndarray:
    """(H, W, 3) samples; a single channel is used three times."""
    flat = np.asarray(values, dtype=np.float64)
    if flat.size == height * width:
        return np.repeat(flat.reshape(height, width, 1), 3, axis=2)
    return flat.reshape(height, width, 3)


def rgb_words(decoded: DataFrame) -> DataFrame:
    """Packed 0xAARRGGBB words of images decoded by Spark (BGR or BGRA bytes, or grey); alpha is dropped as opaque."""

    def pack(record):
        b = np.frombuffer(record["bgr"], dtype=np.uint8).reshape(record["height"], record["width"], record["channels"]).astype(np.int64)
        b = np.repeat(b, 3, axis=2) if record["channels"] == 1 else b
        words = (255 << 24) | (b[..., 2] << 16) | (b[..., 1] << 8) | b[..., 0]
        yield {"words": words.ravel().astype(np.uint32).view(np.int32)}

    return each_image(decoded, ["image", "height", "width"], "words array<int>", pack)


def luminances(images: DataFrame, keep: Sequence[str], height: int, width: int) -> DataFrame:
    """Fixed-point luminance of interleaved RGB samples."""
    return each_image(images, keep, "luminance array<int>", lambda r: [
        {"luminance": luminance_of(_colour(r["pixels"], height, width)).ravel().astype(np.int32)}])


def silhouettes(images: DataFrame, keep: Sequence[str], height: int, width: int, dark: bool = False) -> DataFrame:
    """Threshold and filled largest region of every grey image."""

    def cut(record):
        mask, threshold = shapes.silhouette(_plane(record["pixels"], height, width), dark)
        yield {"threshold": threshold, "area": int(mask.sum()), "mask": mask.ravel()}

    return each_image(images, keep, "threshold int, area int, mask array<boolean>", cut)


def regions(masks: DataFrame, keep: Sequence[str], height: int, width: int) -> DataFrame:
    """8-connected regions of every mask, numbered by their first pixel."""
    return each_image(masks, keep, "regions array<int>", lambda r: [
        {"regions": shapes.components(_plane(r["mask"], height, width).astype(bool)).ravel()}])


POSE = ("strategy string, state string, cx double, cy double, angle double, axis double, area double, anisotropy double, "
        "polarity double, border boolean")


def axis_poses(masks: DataFrame, keep: Sequence[str], height: int, width: int, strategies: Sequence[str],
               min_anisotropy: float = 0.10, scale: float = 4.0) -> DataFrame:
    """One pose row per image and strategy."""
    return each_image(masks, keep, POSE, lambda r: [
        shapes.axis_pose(_plane(r["mask"], height, width).astype(bool), s, min_anisotropy, scale) for s in strategies])


def fourfold_poses(images: DataFrame, keep: Sequence[str], height: int, width: int, scale: float = 4.0) -> DataFrame:
    """Centre and angle of bright fourfold objects; failures stay as rows with their reason."""
    return each_image(images, keep, "status string, reason string, cx double, cy double, angle double, area double, strength double, "
                      "radius double", lambda r: [shapes.fourfold_pose(_plane(r["pixels"], height, width), scale)])


def symmetry_orders(masks: DataFrame, keep: Sequence[str], height: int, width: int) -> DataFrame:
    """Dominant rotational order and the amplitudes of orders 2..12."""

    def orders(record):
        order, spectrum = shapes.angular_orders(_plane(record["mask"], height, width).astype(bool))
        yield {"order": order, "amplitudes": spectrum}

    return each_image(masks, keep, "order int, amplitudes array<double>", orders)


def geometric(images: DataFrame, keep: Sequence[str], height: int, width: int) -> DataFrame:
    """Moved, turned or scaled images; rows carry ``family`` and ``level``."""
    return each_image(images, [*keep, "family", "level"], "pixels array<int>", lambda r: [{"pixels": resample.moved(
        _plane(r["pixels"], height, width)[..., None].astype(np.float64), r["family"], r["level"]).ravel().astype(np.int32)}])


def resized(images: DataFrame, keep: Sequence[str], height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Bicubic resize of grey or RGB images, byte valued."""

    def shrink(record):
        flat = np.asarray(record["pixels"], dtype=np.float64).reshape(height, width, -1)
        yield {"pixels": resample.resized(flat, out_height, out_width).ravel().astype(np.int32)}

    return each_image(images, keep, "pixels array<int>", shrink)


def tensors(images: DataFrame, keep: Sequence[str], height: int, width: int, size: int) -> DataFrame:
    """Resize and normalise to a flat (3, size, size) tensor."""

    def prepare(record):
        rgb = resample.resized(_colour(record["pixels"], height, width), size, size)
        yield {"tensor": resample.normalised(rgb).ravel()}

    return each_image(images, keep, "tensor array<float>", prepare)


def canonical_samples(images: DataFrame, keep: Sequence[str], size: int, out: int, kernel: str) -> DataFrame:
    """Grey samples of square images seen through the inverse of their rigid ``transform``."""

    def sample(record):
        t = record["transform"]
        values = resample.canonical_samples(_plane(record["pixels"], size, size)[..., None].astype(np.float64),
                                            (t["cos"], t["sin"], t["tx"], t["ty"]), out, kernel)
        yield {"values": values.ravel()}

    return each_image(images, keep, "values array<double>", sample)


def canonical_tensors(images: DataFrame, keep: Sequence[str], size: int, out: int, kernel: str = "bilinear",
                      scale: float = 1.0) -> DataFrame:
    """Pose, then sampler: the tensor is null when the pose failed, and the row stays with its reason."""

    def prepare(record):
        gray = _plane(record["pixels"], size, size)
        pose = shapes.fourfold_pose(gray, scale)
        tensor = None
        if pose["status"] == "SUCCESS":
            middle = (size - 1) / 2
            t = resample.rigid(pose["angle"], pose["cx"], pose["cy"], middle, middle)
            tensor = resample.normalised(resample.canonical_samples(_colour(record["pixels"], size, size), t, out, kernel)).ravel()
        yield {"status": pose["status"], "reason": pose["reason"], "tensor": tensor}

    return each_image(images, keep, "status string, reason string, tensor array<float>", prepare)


def backprojected(maps: DataFrame, keep: Sequence[str], size: int) -> DataFrame:
    """Square canonical maps seen from the source frame through their rigid ``transform``."""

    def back(record):
        t = record["transform"]
        forward = (t["cos"], -t["sin"], t["tx"], t["sin"], t["cos"], t["ty"])
        yield {"map": resample.backprojected(_plane(record["map"], size, size).astype(np.float64), forward).ravel()}

    return each_image(maps, keep, "map array<double>", back)


def pulled(masks: DataFrame, keep: Sequence[str], size: int, out: int) -> DataFrame:
    """Masks on the frame of their rigid ``transform``; a gather inside each image, so no pixel is shuffled."""

    def pull(record):
        t = record["transform"]
        yield {"mask": resample.pulled(_plane(record["mask"], size, size).astype(bool), (t["cos"], t["sin"], t["tx"], t["ty"]), out).ravel()}

    return each_image(masks, keep, "mask array<boolean>", pull)


def warped(images: DataFrame, keep: Sequence[str], height: int, width: int) -> DataFrame:
    """Byte images under their rigid ``transform``, edges replicated."""

    def warp(record):
        t = record["transform"]
        forward = np.array([[t["cos"], -t["sin"], t["tx"]], [t["sin"], t["cos"], t["ty"]], [0.0, 0.0, 1.0]])
        flat = np.asarray(record["pixels"], dtype=np.float64).reshape(height, width, -1)
        yield {"pixels": resample.warped(flat, forward).ravel().astype(np.int32)}

    return each_image(images, keep, "pixels array<int>", warp)


def rings(masks: DataFrame, keep: Sequence[str], height: int, width: int, radius: int) -> DataFrame:
    return each_image(masks, keep, "ring array<boolean>", lambda r: [
        {"ring": shapes.ring(_plane(r["mask"], height, width).astype(bool), radius).ravel()}])


def edge_bands(masks: DataFrame, keep: Sequence[str], height: int, width: int, steps: int) -> DataFrame:
    """Per pixel 1 interior, 2 edge band, 0 outside."""
    return each_image(masks, keep, "bands array<int>", lambda r: [
        {"bands": shapes.bands(_plane(r["mask"], height, width).astype(bool), steps).ravel()}])


def region_statistics(images: DataFrame, keep: Sequence[str], height: int, width: int, radius: int, grid: int) -> DataFrame:
    """Statistics of the pixels selected by ``mask``."""
    return each_image(images, keep, "selected int, cells int, edges int, gradient_energy double, mean double, median double, "
                      "contrast double, minor_width double", lambda r: [shapes.region_statistics(
                          _plane(r["pixels"], height, width).astype(np.float64), _plane(r["mask"], height, width).astype(bool), radius, grid)])


def occupancies(masks: DataFrame, keep: Sequence[str], height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Rows (cell, fraction) of object pixels."""
    return each_image(masks, keep, "cell int, fraction double", lambda r: [
        {"cell": i, "fraction": float(v)} for i, v in enumerate(shapes.occupancy(_plane(r["mask"], height, width).astype(bool), rows, cols))])


def annotation_masks(annotations: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Foreground mask of every annotated image: its bitmaps decoded, placed at their origins and united."""

    def place(record):
        found = [(base64.b64decode(o["bitmap"]["data"], validate=True), int(o["bitmap"]["origin"][0]), int(o["bitmap"]["origin"][1]))
                 for o in record["objects"]]
        yield {"mask": bitmaps.placed(found, int(record["height"]), int(record["width"])).ravel()}

    return each_image(annotations, keep, "mask array<boolean>", place)


# Descriptors from images -----------------------------------------------------------------------------------------------

def encoded(tensors: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: Sequence[int], cells: int,
            channels: int, batch: int = 32) -> DataFrame:
    """Rows (cell, x) of a descriptor network given as a factory of ``batch of tensors -> (N, cells * channels)``.

    The factory runs once per Python worker, so an encoder session is opened there and reused.
    """

    def checked():
        encode = make_encoder()

        def predict(inputs: np.ndarray) -> np.ndarray:
            out = np.asarray(encode(inputs), dtype=np.float32).reshape(len(inputs), -1)
            if out.shape[1] != cells * channels or not np.isfinite(out).all():
                raise ValueError(f"encoder returned {out.shape} or non-finite descriptors")
            return out

        return predict

    network = predict_batch_udf(checked, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[list(shape)])
    others = [c for c in tensors.columns if c != "tensor"]
    flat = tensors.where("tensor IS NOT NULL").select(*others, network("tensor").alias("_d"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.slice(F.col("_d"), i * channels + 1, channels))
    return flat.select(*others, F.posexplode(grid).alias("cell", "x"))


def detected(features: DataFrame, model: DataFrame, calibration: DataFrame) -> DataFrame:
    """Maps and scores straight from encoded images."""
    from gridsift.operators import moments as M
    return M.calibrated(M.raw_maps(M.units(features), model), calibration)
