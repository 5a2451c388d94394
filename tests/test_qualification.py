"""Fits taken back, gates, diagnosis and the gated evaluation on small cases."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from gridsift.operators import evaluate as E
from gridsift.operators import qualification as Q
from gridsift.plans.views import HEIGHT
from gridsift.session import shared_folder

MOMENTS = "k int, n long, mean array<double>, std_sample array<double>"


def _moments(spark, rows):
    def of(values):
        return [statistics.fmean(values)], [statistics.stdev(values) if len(values) > 1 else 0.0]
    return spark.createDataFrame([(k, len(v), *of(v)) for k, v in rows], MOMENTS)


def test_taken_back(spark):
    every, gone = [0.5, -2.0, 3.25, 1e6, 4.0, 4.0], [1e6, 4.0]
    whole = _moments(spark, [(1, every), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [7.0, 1.0, 2.0])])
    part = _moments(spark, [(1, gone), (3, [1.0, 2.0]), (4, [1.0])])
    left = {r["k"]: r for r in Q.taken_back(whole, part, ["k"]).collect()}
    rest = [0.5, -2.0, 3.25, 4.0]
    assert left[1]["n"] == 4 and math.isclose(left[1]["mean"][0], statistics.fmean(rest), rel_tol=1e-6)
    assert math.isclose(left[1]["std_sample"][0], statistics.stdev(rest), rel_tol=1e-2)
    assert left[2].asDict() == whole.where("k = 2").head().asDict()
    assert (left[3]["n"], left[3]["mean"]) == (0, None)
    assert math.isclose(left[4]["std_sample"][0], statistics.stdev([7.0, 2.0]))
    with pytest.raises(Exception, match="at least two"):
        Q.model_of(Q.taken_back(whole, part, ["k"]), ["k"]).collect()
    with pytest.raises(Exception, match="more observations"):
        Q.taken_back(whole.where("k = 2"), _moments(spark, [(2, [1.0, 2.0, 3.0])]), ["k"]).collect()


def test_each_gate_fails_alone(spark):
    good = dict(category="a", image=.9, pixel=.9, median_std=1.0, cosine_mean=.8, rotation=.5, geometry=True)
    faults = {"quality_loss": dict(pixel=.85), "median_std_gate": dict(median_std=1.2), "cosine_gate": dict(cosine_mean=.7),
              "rotation_gate": dict(rotation=1.5), "geometry_gate": dict(geometry=None)}
    rows = [dict(good, name="good")] + [dict(good, name=name, **fault) for name, fault in faults.items()]
    evidence = spark.createDataFrame([tuple(r[c] for c in ("name", *good)) for r in rows],
                                     "name string, category string, image double, pixel double, median_std double, cosine_mean double, rotation double, geometry boolean")
    baseline = spark.createDataFrame([("a", .8, .8)], "category string, image double, pixel double")
    judged = {r["name"]: r for r in Q.relative_gates(evidence, evidence.where("name = 'good'"), baseline, ["category"], ["image", "pixel"]).collect()}
    gates = ["quality_loss", "above_unaligned", "median_std_gate", "cosine_gate", "rotation_gate", "geometry_gate"]
    for name, row in judged.items():
        assert [g for g in gates if not row[g]] == ([] if name == "good" else [name])
        assert row["qualifies"] == (name == "good")
    none = Q.relative_gates(evidence, evidence.where("name = 'good'"), baseline.limit(0), ["category"], ["image", "pixel"])
    assert none.where("above_unaligned OR qualifies").count() == 0


def test_defect_labels(spark):
    cases = spark.createDataFrame([(.6, .65, "RAW_REPRESENTATION_LIMIT"), (.9, .7, "Z_CALIBRATION_DAMAGE"), (.9, .85, "MIXED"), (.65, .75, "MIXED")],
                                  "raw double, z double, label string")
    assert cases.where(Q.defect_label(F.col("raw"), F.col("z")) != F.col("label")).count() == 0


def _run(spark, predictions, faults=()):
    expected = spark.createDataFrame([("r", "a", i, "good" if i < 2 else "cut") for i in range(4)], "run_id string, category string, filename long, defect string")
    rows = spark.createDataFrame([("r", "a", *p) for p in predictions], "run_id string, category string, filename long, label string, defect string, image_score double")
    wrong = spark.createDataFrame([("r", "a", *f) for f in faults], "run_id string, category string, filename long, problem string")
    return rows, expected, Q.run_problems(rows, expected, wrong)


SOUND = [(0, "good", "good", .1), (1, "good", "good", .2), (2, "anomaly", "cut", .3), (3, "anomaly", "cut", .15)]


@pytest.mark.parametrize("change, rule", [
    (lambda p: p[:3], "missing"), (lambda p: [*p, (9, "good", "good", .1)], "unexpected"), (lambda p: [*p, p[0]], "duplicate"),
    (lambda p: [(0, "anomaly", "good", .1), *p[1:]], "label"), (lambda p: [*p[:3], (3, "anomaly", "dent", .15)], "defect"),
    (lambda p: [*p[:3], (3, "anomaly", "cut", float("nan"))], "score"), (lambda p: [*p[:3], (3, "anomaly", "cut", None)], "score"),
    (lambda p: [*p[:3], (3, "anomaly", "cut", float("inf"))], "score")])
def test_each_rule_of_a_run(spark, change, rule):
    assert [tuple(r) for r in _run(spark, change(SOUND))[2].select("rule", "n").collect()] == [(rule, 1)]


def test_gate_and_commit(spark):
    arrays = spark.createDataFrame([("r", "a", i, "x", [float(i), 0.0]) for i in range(4)], "run_id string, category string, image long, defect string, map array<double>")
    masks = spark.createDataFrame([("a", 2, [1, 0]), ("a", 3, [1, 0])], "category string, image long, regions array<int>")
    pixels = E.labelled_pixels(arrays, masks, ["category", "image"], 1, 2, 1, 2)
    rows, expected, problems = _run(spark, SOUND)
    done = Q.evaluated(rows, pixels, expected, problems).head()
    assert (done["status"], done["problems"], done["n_good"], done["n_anomaly"], done["image_auroc"]) == ("verified", 0, 2, 2, .75)
    assert (done["foreground_pixels"], done["background_pixels"], done["pixel_auroc"]) == (2, 6, 1.0)
    rows, expected, problems = _run(spark, SOUND, [(1, "sha256")])
    stopped = Q.evaluated(rows, pixels, expected, problems)
    row = stopped.head()
    assert (row["status"], row["problems"], row["image_auroc"], row["pixel_auroc"]) == ("refused", 1, None, None)
    path = f"{shared_folder(spark)}/gridsift/run-{HEIGHT}-{id(row)}"
    assert Q.commit_new(stopped, path).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        Q.commit_new(stopped, path)
    with pytest.raises(ValueError, match="no finished result"):
        Q.committed(spark, path + "-absent")
