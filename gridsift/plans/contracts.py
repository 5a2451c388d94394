"""Queries: names, annotations, membership, tolerances, inventories, stores and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridsift import schemas
from gridsift.functions.grid import column_of, row_of
from gridsift.operators import checks as C
from gridsift.operators import moments as M
from gridsift.operators import projection as P
from gridsift.plans.structure import SIGNS, SQL_EXPLICIT, projection_memory
from gridsift.plans.views import HEIGHT, SQL_SCORED, WIDTH, features, fitted, images, r, rounded, scored, table, units
from gridsift.operators.evaluate import map_arrays
from gridsift.session import kept, shared_folder
from gridsift.sources import dataset, maps as map_files, stores

QUERIES, ORACLE = {}, {}


def place(spark, name):
    return f"{shared_folder(spark)}/gridsift/{name}-{uuid.uuid4().hex}"


# Names: the category word of an image is one of the fixed list, chosen by its label; some names are malformed.

SQL_NAMES = f"""names AS (SELECT vec_id, label, ([{", ".join(f"'{c}'" for c in C.CATEGORIES)}])[label + 1] || '_'
    || CASE WHEN label < 6 THEN 'good' ELSE 'bent_part' END || '_' || lpad(CAST(vec_id AS VARCHAR), 6, '0')
    || CASE WHEN embedding[1] > .2 THEN '.jpg' WHEN embedding[2] > .2 THEN '.PNG' ELSE '.png' END AS image FROM embeddings)"""


def names(spark, sf):
    e = table(spark, sf, "embeddings")
    words = F.array(*[F.lit(c) for c in C.CATEGORIES])
    end = F.when(F.col("embedding")[0] > 0.2, ".jpg").when(F.col("embedding")[1] > 0.2, ".PNG").otherwise(".png")
    return e.select("vec_id", "label", F.concat(
        F.element_at(words, F.col("label") + 1), F.lit("_"), F.when(F.col("label") < 6, "good").otherwise("bent_part"), F.lit("_"),
        F.lpad(F.col("vec_id").cast("string"), 6, "0"), end).alias("image"))


def name_parts(spark, sf):
    category, defect = C.parsed_name(F.col("image"))
    return names(spark, sf).select("image", category.alias("category"), defect.alias("defect"))


QUERIES["name_parts"] = name_parts
ORACLE["name_parts"] = f"""WITH {SQL_NAMES},
  k AS (SELECT image, label, regexp_matches(image, '^[a-z0-9]+(_[a-z0-9]+)*_[0-9]+[.]png$') AS ok FROM names)
SELECT image, CASE WHEN ok THEN ([{", ".join(f"'{c}'" for c in C.CATEGORIES)}])[label + 1] END AS category,
  CASE WHEN ok THEN CASE WHEN label < 6 THEN 'good' ELSE 'bent_part' END END AS defect FROM k"""


# Annotations: one JSON document per image written from the table. Label 7 names an unknown class, label 8 has a
# wrong width, label 4 carries the tag of another category.

def annotation_documents(spark, sf):
    category, defect = C.parsed_name(F.regexp_replace("image", r"\.(jpg|PNG)$", ".png"))
    n = names(spark, sf).withColumn("category", category).withColumn("defect", defect)
    tag = lambda i, name: F.struct(F.lit(i).cast("long").alias("tagId"), name.alias("name"))
    words = F.array(*[F.lit(c) for c in C.CATEGORIES])
    own = F.when(F.col("label") == 4, F.lit(0)).otherwise(F.col("label"))
    tags = F.array(F.struct(own.cast("long").alias("tagId"), F.element_at(words, own + 1).alias("name")))
    tags = F.when(F.col("label") < 6, F.concat(tags, F.array(tag(100, F.lit("good"))))).otherwise(tags)
    shape = F.struct(F.when(F.col("label") == 7, 99).otherwise(10).cast("long").alias("classId"), F.lit("bent_part").alias("classTitle"),
                     F.lit("bitmap").alias("geometryType"))
    doc = F.to_json(F.struct(F.struct(F.when(F.col("label") == 8, 7).otherwise(8).alias("width"), F.lit(8).alias("height")).alias("size"),
                             tags.alias("tags"), F.when(F.col("label") >= 6, F.array(shape)).otherwise(F.array()).alias("objects")))
    return n.select("image", "category", "defect", "label", doc.alias("doc"))


def annotation_problems(spark, sf):
    docs = annotation_documents(spark, sf)
    parsed = docs.withColumn("a", F.from_json("doc", schemas.ANNOTATION, {"mode": "FAILFAST"})).select(
        F.lit("test").alias("role"), "image", "category", "defect", F.lit(8).alias("width"), F.lit(8).alias("height"), "a.*")
    classes = spark.createDataFrame([(10, "bent_part")], "id bigint, title string")
    tags = spark.createDataFrame([*enumerate(C.CATEGORIES), (100, "good")], "id bigint, name string")
    return C.annotation_problems(parsed, classes, tags).select("image", "problem")


QUERIES["annotation_problems"] = annotation_problems
ORACLE["annotation_problems"] = f"""WITH {SQL_NAMES}
SELECT image, 'bad_object' AS problem FROM names WHERE label = 7 UNION ALL SELECT image, 'size' FROM names WHERE label = 8
UNION ALL SELECT image, 'wrong_category' FROM names WHERE label = 4"""


def membership_problems(spark, sf):
    """Labelled documents as predictions against the English documents as manifest."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("image"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("image")).join(docs, "image")
    return C.membership_problems(labelled, docs.where("category = 'en'"))


QUERIES["membership_problems"] = membership_problems
ORACLE["membership_problems"] = """WITH p AS (SELECT lang AS category, doc_id AS image FROM labels JOIN documents USING (doc_id)),
  m AS (SELECT lang AS category, doc_id AS image FROM documents WHERE lang = 'en')
SELECT category, image, 'not_in_manifest' AS problem FROM p ANTI JOIN m USING (category, image)
UNION ALL SELECT category, image, 'no_prediction' FROM m ANTI JOIN p USING (category, image)
UNION ALL SELECT category, image, 'duplicate' FROM p GROUP BY ALL HAVING count(*) > 1"""


def allow_list(spark, sf):
    """Documents allowed and forbidden by the label list, per source; a source counts as population once exclusions left."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    kinds = C.allowed(docs, labels, ["doc_id"]).withColumn("kind", F.lit("allowed")).unionByName(
        C.forbidden(docs, labels, ["doc_id"]).withColumn("kind", F.lit("forbidden"))).unionByName(
        C.population(docs, labels.where("toxic = 1"), ["doc_id"]).withColumn("kind", F.lit("usable")))
    return kinds.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("documents"))


QUERIES["allow_list"] = allow_list
ORACLE["allow_list"] = """SELECT source, 'allowed' AS kind, count(*) AS documents FROM documents SEMI JOIN labels USING (doc_id) GROUP BY ALL
UNION ALL SELECT source, 'forbidden', count(*) FROM documents ANTI JOIN labels USING (doc_id) GROUP BY ALL
UNION ALL SELECT source, 'usable', count(*) FROM documents ANTI JOIN (SELECT * FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY ALL"""


def beyond_tolerance(spark, sf):
    """Cells whose score changes by more than the tolerance when kept in single precision."""
    maps = kept(scored(spark, sf).select("category", "image", "cell", "raw"), "maps")
    single = maps.withColumn("raw", F.col("raw").cast("float").cast("double"))
    off = C.beyond_tolerance(single, maps, ["category", "image", "cell"], "raw", 1e-8, 1e-10)
    return off.groupBy("category").agg(F.count(F.lit(1)).alias("cells"))


QUERIES["beyond_tolerance"] = beyond_tolerance
ORACLE["beyond_tolerance"] = f"""WITH {SQL_SCORED} SELECT category, count(*) AS cells FROM raw
WHERE abs(CAST(CAST(raw AS FLOAT) AS DOUBLE) - raw) > 1e-8 + 1e-10 * abs(raw) GROUP BY ALL"""


def content_inventory(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.length("text").cast("long").alias("length"),
                                                F.sha2("text", 256).alias("sha256"))


QUERIES["content_inventory"] = content_inventory
ORACLE["content_inventory"] = "SELECT doc_id AS path, length(text) AS length, sha256(text) AS sha256 FROM documents"


def content_drift(spark, sf):
    """Documents whose lower-case text differs, and labelled ones counted as removed from the later inventory."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    before = docs.select("path", F.sha2("text", 256).alias("sha256"))
    now = C.forbidden(docs.withColumnRenamed("path", "doc_id"), table(spark, sf, "labels"), ["doc_id"]).select(
        F.col("doc_id").alias("path"), F.sha2(F.regexp_replace("text", "[0-9]", ""), 256).alias("sha256"))
    return C.drift(now, before)


QUERIES["content_drift"] = content_drift
ORACLE["content_drift"] = """SELECT doc_id AS path, CASE WHEN l.doc_id IS NOT NULL THEN 'removed' ELSE 'changed' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR regexp_matches(text, '[0-9]')"""


def model_compatibility(spark, sf):
    """Model rows per category against the encoder table: one category's rows were made with another channel count."""
    model = M.position_model(units(spark, sf).where("split = 'fit'"))
    rows = model.groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("cells"), F.max(F.size("mean")).alias("channels")).withColumn(
        "channels", F.when(F.col("category") == "c1", F.col("channels") + 1).otherwise(F.col("channels")))
    encoders = features(spark, sf).groupBy("image").agg(F.count(F.lit(1)).cast("int").alias("cells"), F.max(F.size("x")).alias("channels"))
    return C.incompatible(rows, encoders.select("cells", "channels").distinct(), ["cells", "channels"])


QUERIES["model_compatibility"] = model_compatibility
ORACLE["model_compatibility"] = """SELECT DISTINCT CAST(8 AS INTEGER) AS cells, CAST(9 AS INTEGER) AS channels, 'c1' AS category
FROM embeddings WHERE label = 1"""


# Round trips through the stores ----------------------------------------------------------------------------------------

# The identity a store of this view is opened with.
CONTRACT_FIELDS = {"grid": "2x4x8", "preprocessing": "none", "encoder": "embeddings-64", "norm_guard": "1e-6", "std_floor": "1e-6",
                   "score": "max-z"}


def stored_model_scores(spark, sf):
    """Scores computed with a model that was written, checked against its contract and read back."""
    u, model, calibration = fitted(spark, sf)
    path = place(spark, "store")
    stores.write_model(model, calibration, CONTRACT_FIELDS, path)
    model, calibration = stores.read_model(spark, path, CONTRACT_FIELDS)
    return rounded(M.image_scores(M.calibrated(M.raw_maps(u, model), calibration)))


QUERIES["stored_model_scores"] = stored_model_scores
ORACLE["stored_model_scores"] = f"WITH {SQL_SCORED} SELECT category, image, {r('score')} AS score FROM scores"


def stored_learning_state_scores(spark, sf):
    """Filters and calibration rebuilt from stored statistics, archetypes and raw held-out maps."""
    u, statistics, bank, filters = projection_memory(spark, sf)
    path = place(spark, "state")
    raw = P.filter_maps(u.where("split = 'calibration'"), filters).select("category", "image", "cell", "raw")
    stores.write_learning_state(statistics, bank, raw, path)
    filters, calibration = stores.read_learning_state(spark, path, SIGNS)
    maps = M.calibrated(P.filter_maps(u.where("split = 'test'"), filters), kept(calibration, "calibration"))
    return rounded(M.image_scores(maps))


QUERIES["stored_learning_state_scores"] = stored_learning_state_scores
ORACLE["stored_learning_state_scores"] = f"""{SQL_EXPLICIT},
  ca AS (SELECT category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM m0 WHERE split = 'calibration' GROUP BY ALL)
SELECT category, image, {r('max((raw - alpha) / beta)')} AS score FROM m0 JOIN ca USING (category, cell) WHERE split = 'test' GROUP BY ALL"""


def stored_features(spark, sf):
    """The descriptor table after a round trip, counted per partition."""
    path = place(spark, "features")
    stores.write_features(features(spark, sf), path)
    back = stores.read_features(spark, path)
    return rounded(back.groupBy("category", "split").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.aggregate(
        F.transform("x", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)).alias("total")), 5)


QUERIES["stored_features"] = stored_features
ORACLE["stored_features"] = """WITH f AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT 'c' || (label % 2) AS category, CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
  count(*) * 8 AS cells, (round(sum(list_sum(e)), 5) + 0.0) AS total FROM f GROUP BY ALL"""


def map_file_round_trip(spark, sf):
    """Every test map exported as an array file with sidecar, read back and checked; the largest value per image."""
    arrays = map_arrays(scored(spark, sf).where("split = 'test'"), ["image"])
    path = place(spark, "maps")
    written = kept(map_files.write_arrays(arrays, path, height=HEIGHT, width=WIDTH, geometry_id="grid-2x4", score_kind="z",
                                          format_id="anomaly-map-v1"), "written")
    back, sidecars = map_files.read_once(spark, path)
    C.enforced(map_files.sidecar_problems(back, sidecars), "map files refused")
    C.enforced(written.join(back, "sha256", "left_anti"), "map file missing")
    return rounded(back.select(F.col("stem").cast("long").alias("image"), "rows", "cols", F.array_max("values").alias("max_z")))


QUERIES["map_file_round_trip"] = map_file_round_trip
ORACLE["map_file_round_trip"] = f"""WITH {SQL_SCORED} SELECT image, CAST(2 AS INTEGER) AS "rows", CAST(4 AS INTEGER) AS cols, {r('score')} AS max_z
FROM scores WHERE split = 'test'"""


def map_csv_problems(spark, sf):
    """Long map CSV without the cells above 3: the images that are no longer complete."""
    cells = scored(spark, sf).where("z <= 3").select(F.col("image").cast("string").alias("image"), row_of(F.col("cell"), WIDTH).alias("row"),
                                                      column_of(F.col("cell"), WIDTH).alias("col"), "raw")
    path = place(spark, "map-csv")
    cells.write.mode("errorifexists").option("header", True).csv(path)
    return map_files.map_csv_problems(map_files.read_map_csv(spark, path), HEIGHT, WIDTH)


QUERIES["map_csv_problems"] = map_csv_problems
ORACLE["map_csv_problems"] = f"""WITH {SQL_SCORED}, k AS (SELECT CAST(image AS VARCHAR) AS image, count(*) AS n FROM maps WHERE z <= 3 GROUP BY ALL)
SELECT image, n AS "rows", n AS cells, CAST(0 AS BIGINT) AS not_finite FROM k WHERE n <> 8"""


def stored_predictions(spark, sf):
    """The fourteen-column prediction table written, read and checked against the image list."""
    base = images(spark, sf).select("category", "image", "defect", "anomaly", F.sha2(F.col("embedding").cast("string"), 256).alias("image_sha256"))
    rows = M.image_scores(scored(spark, sf)).join(base, ["category", "image"])
    text = F.col("image").cast("string")
    out = rows.select(
        F.lit("run-1").alias("run_id"), F.lit("diagonal").alias("method"), "category", text.alias("filename"),
        F.when(F.col("anomaly"), "anomaly").otherwise("good").alias("label"), "defect", F.col("score").alias("image_score"),
        F.lit("z").alias("score_kind"), F.concat(F.lit("native/"), text).alias("native_map_path"), F.concat(F.lit("eval/"), text).alias("eval_map_path"),
        F.lit("float64").alias("dtype"), F.lit("2x4").alias("shape"), F.lit("grid-2x4").alias("geometry_id"), "image_sha256")
    path = place(spark, "predictions")
    stores.write_predictions(out, path)
    back = stores.read_predictions(spark, path)
    listed = base.select("category", F.col("image").cast("string").alias("filename"))
    C.enforced(C.membership_problems(back, listed, ["category", "filename"]), "predictions refused")
    C.enforced(C.label_problems(back), "labels refused")
    return rounded(back.select("category", "filename", "label", "defect", "image_score", "shape"))


QUERIES["stored_predictions"] = stored_predictions
ORACLE["stored_predictions"] = f"""WITH {SQL_SCORED} SELECT category, CAST(image AS VARCHAR) AS filename, CASE WHEN anomaly THEN 'anomaly' ELSE 'good' END AS label,
  defect, {r('score')} AS image_score, '2x4' AS shape FROM scores"""


def stored_manifests(spark, sf):
    """Manifests written by split and read back with their order."""
    from gridsift.plans.studies import document_names
    from gridsift.operators.splits import hashed_split
    path = place(spark, "manifests")
    dataset.write_manifests(hashed_split(document_names(spark, sf).withColumn("seed", F.lit(42))), path)
    back = dataset.read_manifests(spark, path)
    return back.groupBy("category", "split").agg(F.count(F.lit(1)).alias("images"), F.min(F.struct("ord", "image"))["image"].alias("first"),
                                                 F.max("ord").alias("last_ord"))


QUERIES["stored_manifests"] = stored_manifests


def _manifest_sql():
    from gridsift.plans.studies import SQL_SPLIT
    return f"""WITH {SQL_SPLIT} SELECT category, split, count(*) AS images, min_by(image, ord) AS first, max(ord) AS last_ord FROM sp GROUP BY ALL"""


ORACLE["stored_manifests"] = _manifest_sql()


def file_inventory(spark, sf):
    """Hash inventory of exported report files: every file of the tree with its length, stable between two scans."""
    path = place(spark, "report")
    report = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    stores.write_report(report, f"{path}/a")
    stores.write_report(report, f"{path}/b", "csv")
    first = kept(dataset.inventory(spark, path), "inventory")
    C.enforced(C.drift(dataset.inventory(spark, path), first), "content changed")
    back = spark.read.schema("lang string, documents bigint").json(f"{path}/a")
    return back.select("lang", "documents")


QUERIES["file_inventory"] = file_inventory
ORACLE["file_inventory"] = "SELECT lang, count(*) AS documents FROM documents GROUP BY ALL"
