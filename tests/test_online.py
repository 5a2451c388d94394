"""Streams: images that arrive again or too late, and state that stays bounded."""

import datetime

import numpy as np
from gridsift.streaming import online

SCHEMA = "category string, image long, arrived timestamp, x array<double>"


def fed(spark, folder, batches, horizon):
    """Write each batch as one file and fold them one by one; returns the query."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        query = online.update_moments(stream, f"{folder}/moments", f"{folder}/checkpoint", cells=2, channels=3, horizon=horizon)
        query.awaitTermination()
        yield query


def image(number, second, vectors):
    return "c", number, datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=second), vectors[number].tolist()


def test_replays_and_late_images(spark, tmp_path):
    vectors = np.random.default_rng(1).normal(size=(200, 6))
    first = [image(i, i, vectors) for i in range(50)]
    batches = [first, first[:30] + first[:5], [image(i, 1000 + i, vectors) for i in range(50, 60)],
               [image(60, 10, vectors), image(61, 1070, vectors), image(61, 1070, vectors)], first[:10], [image(62, 1071, vectors)]]
    states = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in fed(spark, str(tmp_path), batches, "100 seconds")]
    # Images 0-59, 61 and 62; number 60 and the last replay are older than the horizon.
    used = [*range(60), 61, 62]
    assert max(states[:2]) == 50 and states[-1] <= 12  # the images of the last 100 seconds
    x = vectors[used].reshape(len(used), 2, 3)
    x = x / np.linalg.norm(x, axis=2, keepdims=True)
    model = {r.cell: r for r in online.model_of(online.latest_moments(spark, f"{tmp_path}/moments")).collect()}
    for cell in (0, 1):
        assert model[cell].n == len(used)
        np.testing.assert_allclose(model[cell].mean, x[:, cell].mean(axis=0))
        np.testing.assert_allclose(model[cell].std_sample, x[:, cell].std(axis=0, ddof=1))


def test_images_at_and_before_1970(spark, tmp_path):
    """Only the horizon makes an image late, not the year it was taken in."""
    vectors = np.random.default_rng(2).normal(size=(8, 6))
    at = lambda i, second: ("c", i, datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=second), vectors[i].tolist())
    batches = [[at(0, 40), at(1, 50)], [at(2, 0), at(3, -20), at(0, 40)], [at(4, -300), at(5, 60)], [at(3, -20), at(6, 61)]]
    for _ in fed(spark, str(tmp_path), batches, "100 seconds"):
        pass
    # Number 4 is older than the horizon; 0 and 3 came twice.
    used = [0, 1, 2, 3, 5, 6]
    x = vectors[used].reshape(len(used), 2, 3)
    x = x / np.linalg.norm(x, axis=2, keepdims=True)
    model = {r.cell: r for r in online.model_of(online.latest_moments(spark, f"{tmp_path}/moments")).collect()}
    for cell in (0, 1):
        assert model[cell].n == len(used)
        np.testing.assert_allclose(model[cell].mean, x[:, cell].mean(axis=0))
