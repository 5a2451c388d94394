import pytest
from pyspark.sql import functions as F

from gridsift.operators import checks as K
from gridsift.operators import nuisance as N
from gridsift.operators import paired as P
from gridsift.operators import process as PR
from gridsift.operators import splits as S


def names(spark, n, word="hazelnut"):
    return spark.createDataFrame([("c", f"{word}_good_{i:03d}.png") for i in range(n)], "category string, image string")


def test_seeded_split_keeps_the_historic_order(spark):
    rows = S.seeded_split(names(spark, 209, "bottle"), 42).orderBy("ord").collect()
    fit = [r.image for r in rows if r.split == "fit"]
    assert len(fit) == 167 and len(rows) == 209
    # Head of the order and of the calibration part for this seed.
    assert fit[:3] == ["bottle_good_005.png", "bottle_good_177.png", "bottle_good_199.png"]
    assert [r.image for r in rows if r.split == "calibration"][:2] == ["bottle_good_203.png", "bottle_good_183.png"]


@pytest.mark.parametrize("n, fit", [(391, 312), (3, 1)])
def test_split_sizes(spark, n, fit):
    for split in (S.seeded_split(names(spark, n), 17), S.hashed_split(names(spark, n).withColumn("seed", F.lit(17)))):
        assert split.where("split = 'fit'").count() == fit and split.count() == n


def test_split_refuses_small_and_duplicate_names(spark):
    with pytest.raises(Exception, match="three distinct"):
        S.seeded_split(names(spark, 2), 1).collect()
    twice = names(spark, 3).unionByName(names(spark, 1))
    with pytest.raises(Exception, match="three distinct"):
        S.seeded_split(twice, 1).collect()


def pairs(spark, rows):
    return spark.createDataFrame(rows, "category string, image string, family string, level double, s0 double, st double").withColumn(
        "delta", F.col("st") - F.col("s0")).withColumn("reference", F.lit(2.5)).withColumn("exceeds", F.col("st") > F.col("reference"))


def test_median_of_differences(spark):
    df = pairs(spark, [("c", "a", "F", 1.0, 0.0, 1.0), ("c", "b", "F", 1.0, 2.0, 2.0), ("c", "d", "F", 1.0, 3.0, 10.0)])
    row = P.robustness_summary(df).head()
    assert (row.median_s0, row.median_st, row.median_delta, row.max_delta) == (2.0, 2.0, 1.0, 7.0)
    assert row.exceedance == pytest.approx(1 / 3)


def test_pairing_problems(spark):
    df = pairs(spark, [("c", "a", "F", 1.0, 0.0, 1.0), ("c", "a", "F", 2.0, 0.5, 1.0), ("c", "b", "F", 1.0, 1.0, 1.0),
                       ("c", "b", "F", 1.0, 1.0, 1.0), ("c", "d", "F", 7.0, 1.0, 1.0)])
    row = P.pairing_problems(df, {"F": [1.0, 2.0]}).head()
    assert (row.observations, row.changed_originals, row.duplicates, row.unknown_levels, row.wrong_deltas) == (5, 1, 1, 1, 0)
    gaps = P.grid_gaps(df, df.select("category", "image").distinct(), {"F": [1.0, 2.0]}).collect()
    assert {(g.image, g.level) for g in gaps} == {("b", 2.0), ("d", 1.0), ("d", 2.0)}


def test_recovery_skips_small_effects(spark):
    rows = [("c", 0.0, 4.0, 1.0), ("c", 0.0, 0.05, 3.0), ("c", 0.0, -2.0, 1.0)]
    row = P.recovery_summary(spark.createDataFrame(rows, "category string, s0 double, sp double, sc double"), ["category"]).head()
    assert row.recovery_count == 2 and row.median_recovery == pytest.approx((0.75 + 1.5) / 2)
    assert (row.within_1, row.within_5) == (pytest.approx(2 / 3), 1.0)


def test_spearman(spark):
    df = spark.createDataFrame([("a", float(i), float(-i), 1.0) for i in range(5)], "k string, x double, y double, z double")
    assert P.spearman(df, ["k"], "x", "y").head().spearman == pytest.approx(-1)
    assert P.spearman(df, ["k"], "x", "z").head().spearman is None


def test_seed_summary_and_signs(spark):
    runs = spark.createDataFrame([(s, b, .5 + .01 * s * (b == "calibrated")) for s in range(1, 6) for b in ("raw", "calibrated")],
                                 "seed int, branch string, auroc double")
    rows = {r.branch: r for r in P.seed_summary(runs, ["auroc"]).collect()}
    assert rows["delta"]["mean"] == pytest.approx(.03) and rows["raw"].sample_std == 0 and rows["delta"].n == 5
    deltas = spark.createDataFrame([("m", .1), ("m", 0.0), ("m", -.1)], "metric string, delta double")
    row = P.sign_counts(deltas, ["metric"]).head()
    assert (row.positive, row.zero, row.negative, row.all_positive) == (1, 1, 1, False)


def test_rotation_takes_signed_medians_first(spark):
    df = spark.createDataFrame([(l, d) for l, ds in ((5, (-1.0, 3.0)), (-5, (-2.0, -4.0))) for d in ds], "level int, delta double")
    assert P.rotation_summary(df).head().mean_absolute_median == pytest.approx((1.0 + 3.0) / 2)


def test_gates_at_their_bounds(spark):
    df = spark.createDataFrame([(1.0, .25), (1.1, .2), (None, .2)], "a double, b double")
    got = P.acceptance(df, {"g1": ("a", "<=", 1.0), "g2": ("b", "<=", .25)}).collect()
    assert [r.qualifies for r in got] == [True, False, False]


def test_amplification_terms(spark):
    rows = [("identity", "i", 2.0, 6.0, 2.0, -1.0), ("canonical", "i", 7.0, 8.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "variant string, image string, delta_max_z double, raw_growth_at_winner double, beta_at_winner double, "
                               "winner_switch_penalty double")
    row = N.amplification(df, "identity", "canonical", ["image"]).head()
    assert (row.amplification, row.raw_term, row.scaling_term, row.switch_term) == (5.0, 1.0, 4.0, 0.0)


def test_contributions(spark):
    df = spark.createDataFrame([([4.0, -1.0, 1.0, 0.0, 2.0, 1.0, 1.0, 1.0],), ([-1.0, 0.0],)], "g array<double>")
    a, b = df.select(*N.contribution_shape("g")).collect()
    assert a.positive_channel_count == 6 and a.top5_positive_growth_share == pytest.approx(.9)
    assert a.positive_effective_participation == pytest.approx(100 / 24) and b.top5_positive_growth_share == 0


# Processes -------------------------------------------------------------------------------------------------------------

def test_memory_by_phase(spark):
    samples = spark.createDataFrame([
        ("r", "1", "2026-01-01 00:00:00", "p1", 100, 50, 110, None), ("r", "2", "2026-01-01 00:00:02", "p1", 200, 60, 210, None),
        ("r", "2", "2026-01-01 00:00:02", "p2", 100, 40, 120, None), ("r", "3", "2026-01-01 00:00:05", "p1", 500, 70, 510, None),
        ("r", "4", "2026-01-01 00:00:06", "p1", None, 70, 510, " denied; exited ")],
        "run string, sample_id string, ts string, process string, working_set_bytes long, private_bytes long, lifetime_peak_bytes long, "
        "reason string").withColumn("ts", F.to_timestamp("ts"))
    phases = spark.createDataFrame([("r", "2026-01-01 00:00:01", "fitting", "1"), ("r", "2026-01-01 00:00:05", "steady", "2")],
                                   "run string, ts string, phase string, change_id string").withColumn("ts", F.to_timestamp("ts"))
    by = {r.bucket: r for r in PR.memory_by_bucket(PR.phased_polls(samples, phases)).collect()}
    assert {b: r.max_working_set for b, r in by.items()} == {"baseline": 100, "fitting": 300, "steady": 500, "to_ready": 300}
    status = PR.sample_status(samples).head()
    assert (status.observed, status.complete, status.missing) == (5, 4, 1)
    assert {r.reason for r in PR.missing_reasons(samples).collect()} == {"denied", "exited"}
    gaps = PR.poll_gaps(PR.polls(samples)).head()
    assert (gaps.min_gap_ms, gaps.max_gap_ms) == (2000.0, 3000.0)
    assert {r.process: r.lifetime_peak_bytes for r in PR.lifetime_peaks(samples).collect()} == {"p1": 510, "p2": 120}


# Contracts -------------------------------------------------------------------------------------------------------------

def test_names(spark):
    df = spark.createDataFrame([(n,) for n in ("wood_good_007.png", "metal_nut_bent_000.png", "grid_metal_contamination_001.png", "wood_007.png",
                                              "Wood_good_1.png", "sofa_good_001.png")], "image string")
    category, defect = K.parsed_name(F.col("image"))
    got = [(r.c, r.d) for r in df.select(category.alias("c"), defect.alias("d")).collect()]
    assert got == [("wood", "good"), ("metal_nut", "bent"), ("grid", "metal_contamination"), (None, None), (None, None), (None, None)]


def test_tolerance_reports_one_sided_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 5e-9), (2, 2.1), (4, 4.0)], "k int, v double")
    assert {r.k for r in K.beyond_tolerance(a, b, ["k"], "v").collect()} == {2, 3, 4}


def test_drift_and_enforcement(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "path string, sha256 string")
    assert {(r.path, r.state) for r in K.drift(a, b).collect()} == {("y", "changed"), ("z", "removed")}
    with pytest.raises(ValueError, match="changed"):
        K.enforced(K.drift(a, b).where("state = 'changed'"), "content")


def test_one_python_pass_from_pixels_to_maps(spark, monkeypatch):
    """A task of the studies holds a Python worker for the change and one for the maps, no third one for normalisation."""
    from gridsift.plans import geometry, studies
    passes, write = {}, studies.kept

    def recorded(df, name):
        passes[name] = df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
        return write(df, name)

    monkeypatch.setattr(studies, "kept", recorded)
    monkeypatch.setattr(geometry, "kept", recorded)
    studies.nuisance_maps(spark, "/root/testdata/sf0.001")
    geometry.geometric_maps(spark, "/root/testdata/sf0.001")
    assert passes["nuisance"] == 2 and passes["calibration"] == 1 and passes["geometric-maps"] == 1
