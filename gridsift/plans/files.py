"""Queries that write files from the given tables and read them through the library's sources, and small checks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

from gridsift.functions import grid as G
from gridsift.operators import checks as C
from gridsift.operators import reports as R
from gridsift.operators.ordered import numbered
from gridsift.plans.contracts import SQL_NAMES, annotation_documents, names, place
from gridsift.plans.views import images, r, rounded, table
from gridsift.sources import dataset, measurements

QUERIES, ORACLE = {}, {}


def written(files, folder):
    """Write each row (name, content) as a file of its own under ``folder`` from the tasks, and wait for all of them."""
    def write(batches):
        for batch in batches:
            fs, root = pyarrow.fs.FileSystem.from_uri(folder)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


# Image files: a header with the size that a vector gives, and one chunk of its first values; some are no PNG at all.

def image_file_headers(spark, sf):
    """Images of a role with their parsed names, sizes from the header and content hash; other files are not images of a role."""
    n = names(spark, sf).select("vec_id", "image")
    hex4 = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.concat(F.when(F.col("vec_id") % 9 == 0, F.lit("FFD8FFE000104A46")).otherwise(F.lit(dataset.PNG_SIGNATURE)), F.lit("0000000D49484452"),
                    hex4(F.col("vec_id") % 900 + 1), hex4(F.col("vec_id") % 700 + 2), F.lit("0802000000"))
    folder = written(n.select(F.concat(F.lit("test/img/"), "image").alias("name"), F.unhex(head).alias("content")), place(spark, "images"))
    return dataset.image_files(spark, folder, "test").select("role", "image", "category", "defect", "width", "height", "sha256")


_HEAD = "unhex(concat(CASE WHEN vec_id % 9 = 0 THEN 'FFD8FFE000104A46' ELSE '89504E470D0A1A0A' END, '0000000D49484452', printf('%08X', vec_id % 900 + 1), printf('%08X', vec_id % 700 + 2), '0802000000'))"
QUERIES["image_file_headers"] = image_file_headers
ORACLE["image_file_headers"] = f"""WITH {SQL_NAMES}
SELECT 'test' AS role, image, regexp_extract(image, '^([a-z_]*?)_(good|bent_part)_', 1) AS category, regexp_extract(image, '_(good|bent_part)_', 1) AS defect,
  CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 900 + 1 AS INTEGER) END AS width, CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 700 + 2 AS INTEGER) END AS height,
  sha256({_HEAD}) AS sha256 FROM names WHERE image LIKE '%.png'"""


def annotation_files(spark, sf):
    """One annotation file per image: tags and objects as read back, and the broken rules."""
    docs = annotation_documents(spark, sf)
    folder = written(docs.select(F.concat(F.lit("test/ann/"), "image", F.lit(".json")).alias("name"), F.col("doc").alias("content")), place(spark, "annotations"))
    read = dataset.annotations(spark, folder, "test")
    return read.select("role", "image", F.col("size.width").alias("width"), F.size("tags").alias("tags"), F.col("tags")[0]["name"].alias("first_tag"), F.size("objects").alias("objects"))


QUERIES["annotation_files"] = annotation_files
ORACLE["annotation_files"] = f"""WITH {SQL_NAMES}
SELECT 'test' AS role, image, CASE WHEN label = 8 THEN 7 ELSE 8 END AS width, CASE WHEN label < 6 THEN 2 ELSE 1 END AS tags,
  ([{", ".join(f"'{c}'" for c in C.CATEGORIES)}])[CASE WHEN label = 4 THEN 0 ELSE label END + 1] AS first_tag, CASE WHEN label >= 6 THEN 1 ELSE 0 END AS objects FROM names"""


def project_dictionaries(spark, sf):
    """Class and tag dictionaries of a project file (nations as classes, regions as tags), with ids that occur twice."""
    classes = table(spark, sf, "nation").select((F.col("n_nationkey") % 23).alias("id"), F.col("n_name").alias("title"))
    tags = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    every = classes.select(F.struct(F.col("id").cast("long").alias("id"), "title").alias("c")).unionByName(
        tags.select(F.struct("id", "name").alias("t")), allowMissingColumns=True)
    both = every.agg(F.collect_list("c").alias("classes"), F.collect_list("t").alias("tags"))  # a dictionary is one small document
    folder = written(both.select(F.lit("meta.json").alias("name"), F.to_json(F.struct("classes", "tags")).alias("content")), place(spark, "project"))
    found, named = dataset.dictionaries(spark, f"{folder}/meta.json")
    kinds = found.select(F.lit("class").alias("kind"), "id", F.col("title").alias("name")).unionByName(named.select(F.lit("tag").alias("kind"), "id", "name"))
    return kinds.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))


QUERIES["project_dictionaries"] = project_dictionaries
ORACLE["project_dictionaries"] = """SELECT 'class' AS kind, CAST(n_nationkey % 23 AS BIGINT) AS id, count(*) AS n, min(n_name) AS name FROM nation GROUP BY ALL
UNION ALL SELECT 'tag', CAST(r_regionkey AS BIGINT), count(*), min(r_name) FROM region GROUP BY ALL"""


def manifest_files(spark, sf):
    """Ordered manifests, a file per language and source, with a byte order mark and blank lines."""
    d = table(spark, sf, "documents").select("lang", "source", "doc_id")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\r\n  doc_"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    # The names of one manifest: a short list by contract.
    lists = d.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("l"))
    content = F.concat(F.lit("﻿"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n"))
    folder = written(lists.select(F.concat_ws("/", "lang", F.concat("source", F.lit(".txt"))).alias("name"), content.alias("content")), place(spark, "manifests"))
    return dataset.manifest(spark, f"{folder}/*/*.txt")


QUERIES["manifest_files"] = manifest_files
ORACLE["manifest_files"] = """SELECT lang AS category, source AS manifest, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS INTEGER) AS ord, 'doc_' || doc_id AS image
FROM documents"""


# Measurements: orders as calls, events as process samples and phase changes.

def latency_files(spark, sf):
    """Per-call CSV rows: calls, mean and largest time of each region in microseconds."""
    li = table(spark, sf, "lineitem").select(F.lit("run").alias("process"), F.col("l_suppkey").cast("string").alias("pid"), F.col("l_returnflag").alias("region"),
                                             F.col("l_linenumber").cast("int").alias("iteration"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("elapsed_ns"))
    path = place(spark, "latency")
    li.write.mode("errorifexists").option("header", True).csv(path)
    rows = measurements.latency_samples(spark, path)
    return rounded(rows.groupBy("region").agg(F.count(F.lit(1)).alias("calls"), F.avg("elapsed").alias("mean"), F.max("elapsed").alias("largest")), 6)


QUERIES["latency_files"] = latency_files
ORACLE["latency_files"] = f"""WITH e AS (SELECT l_returnflag AS region, CAST(round(l_extendedprice * 100) AS BIGINT) / 1000.0::DOUBLE AS elapsed FROM lineitem)
SELECT region, count(*) AS calls, {r('avg(elapsed)', 6)} AS mean, {r('max(elapsed)', 6)} AS largest FROM e GROUP BY region"""


def latency_histogram_files(spark, sf):
    """Nested histograms (forks, iterations, bins): calls and weighted mean of each region."""
    bins = table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_linenumber") % 2).alias("fork"), "l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    # Bins of one iteration: fifty quantities at most; iterations and forks: seven and two.
    iterations = bins.groupBy("l_returnflag", "fork", "l_linenumber").agg(F.collect_list(F.array(F.col("l_quantity").cast("double"), F.col("n").cast("double"))).alias("bins"))
    forks = iterations.groupBy("l_returnflag", "fork").agg(F.collect_list("bins").alias("iterations"))
    docs = forks.groupBy("l_returnflag").agg(F.collect_list("iterations").alias("rawDataHistogram")).select("l_returnflag", F.to_json(F.struct(
        F.concat(F.lit("bench.calls."), "l_returnflag").alias("benchmark"), F.struct(F.lit(1.0).alias("score"), "rawDataHistogram").alias("primaryMetric"))).alias("content"))
    folder = written(docs.select(F.concat("l_returnflag", F.lit(".json")).alias("name"), "content"), place(spark, "histograms"))
    rows = measurements.latency_histograms(spark, folder)
    return rounded(rows.groupBy("region").agg(F.sum("count").alias("calls"), (F.sum(F.col("elapsed") * F.col("count")) / F.sum("count")).alias("mean"),
                                              F.count_distinct("fork").alias("forks"), F.count_distinct("fork", "iteration").alias("iterations")), 6)


QUERIES["latency_histogram_files"] = latency_histogram_files
ORACLE["latency_histogram_files"] = f"""SELECT l_returnflag AS region, count(*) AS calls, {r('sum(l_quantity) / count(*)', 6)} AS mean, count(DISTINCT l_linenumber % 2) AS forks,
  count(DISTINCT l_linenumber) AS iterations FROM lineitem GROUP BY l_returnflag"""


def _stamp():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def process_sample_files(spark, sf):
    """Process sample CSV: samples, those without a counter, and the largest counter of each process."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").cast("string").alias("sample_id"), _stamp().alias("timestamp_utc"), F.col("user_id").cast("string").alias("pid"), F.lit("2024-01-01").alias("start_time_utc"),
                    F.when(F.col("event_type") != "error", (F.col("value") * 1000).cast("long")).alias("working_set_bytes"), F.lit(None).cast("long").alias("private_bytes"),
                    F.col("event_id").alias("lifetime_peak_working_set_bytes"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    path = place(spark, "samples")
    rows.write.mode("errorifexists").option("header", True).csv(path)
    read = measurements.process_samples(spark, path, "r1")
    return read.groupBy("run", "process").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("working_set_bytes").isNull()).alias("missing"),
                                              F.max("working_set_bytes").alias("largest"), F.max("lifetime_peak_bytes").alias("peak"), F.max(F.unix_micros("ts")).alias("last"))


QUERIES["process_sample_files"] = process_sample_files
ORACLE["process_sample_files"] = """SELECT 'r1' AS run, user_id || '/2024-01-01' AS process, count(*) AS samples, count_if(event_type = 'error') AS missing,
  max(CASE WHEN event_type <> 'error' THEN CAST(trunc(value * 1000) AS BIGINT) END) AS largest, max(event_id) AS peak, max(epoch_us(ts)) AS last FROM events GROUP BY ALL"""


def phase_files(spark, sf):
    """Phase CSV: first and last change to each phase."""
    e = table(spark, sf, "events").select(_stamp().alias("timestamp_utc"), F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("phase"))
    path = place(spark, "phases")
    e.write.mode("errorifexists").option("header", True).csv(path)
    read = measurements.phase_changes(spark, path, "r1")
    return read.groupBy("run", "phase").agg(F.count_distinct("change_id").alias("changes"), F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last"))


QUERIES["phase_files"] = phase_files
ORACLE["phase_files"] = """SELECT 'r1' AS run, event_type AS phase, count(*) AS changes, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY ALL"""


# Parameters, supports and selections.

def inverse_parameters(spark, sf):
    """Angle or factor that undoes a rotation or a scale, and what is left after both."""
    e = table(spark, sf, "embeddings")
    first = F.col("embedding")[0].cast("double")
    rows = e.select(F.col("vec_id").alias("image"), F.when(F.col("label") % 2 == 0, "ROTATION").otherwise("SCALE").alias("family"),
                    F.when(F.col("label") % 2 == 0, 90 * first).otherwise(1.25 + first).alias("level"))
    back = rows.withColumn("inverse", R.inverse_level(F.col("family"), F.col("level")))
    return rounded(back.withColumn("left", F.when(F.col("family") == "ROTATION", F.col("level") + F.col("inverse")).otherwise(F.col("level") * F.col("inverse"))))


QUERIES["inverse_parameters"] = inverse_parameters
ORACLE["inverse_parameters"] = f"""WITH v AS (SELECT vec_id AS image, CASE WHEN label % 2 = 0 THEN 'ROTATION' ELSE 'SCALE' END AS family,
    CASE WHEN label % 2 = 0 THEN 90 * CAST(embedding[1] AS DOUBLE) ELSE 1.25 + CAST(embedding[1] AS DOUBLE) END AS level FROM embeddings),
  i AS (SELECT *, CASE family WHEN 'ROTATION' THEN -level ELSE 1 / level END AS inverse FROM v)
SELECT image, family, {r('level')} AS level, {r('inverse')} AS inverse, {r("CASE family WHEN 'ROTATION' THEN level + inverse ELSE level * inverse END")} AS "left" FROM i"""


def interior_means(spark, sf):
    """A vector as a grid of 8 by 8 cells: means of all cells, of those inside the outer ring, and of the ring."""
    cells = images(spark, sf).select("category", "image", F.posexplode("embedding").alias("cell", "x"))
    inside = G.interior(F.col("cell"), 8, 8)
    return rounded(cells.groupBy("category", "image").agg(F.count_if(inside).alias("inner_cells"), F.avg(F.col("x").cast("double")).alias("whole"),
                                                          F.avg(F.when(inside, F.col("x").cast("double"))).alias("inner"), F.avg(F.when(~inside, F.col("x").cast("double"))).alias("ring")))


QUERIES["interior_means"] = interior_means
ORACLE["interior_means"] = f"""WITH c AS (SELECT 'c' || label % 2 AS category, vec_id AS image, unnest(range(64)) AS cell, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  i AS (SELECT *, cell // 8 BETWEEN 1 AND 6 AND cell % 8 BETWEEN 1 AND 6 AS inside FROM c)
SELECT category, image, count_if(inside) AS inner_cells, {r('avg(x)')} AS whole, {r('avg(x) FILTER (inside)')} AS "inner", {r('avg(x) FILTER (NOT inside)')} AS ring FROM i GROUP BY ALL"""


def support_means(spark, sf):
    """The same grid on 20 by 28 pixels, each taking its nominal cell: pixels and mean on both inner supports."""
    px = images(spark, sf).select("category", "image", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20 * 28 - 1))).alias("px"))
    at = lambda i, out: F.floor(i * F.lit(8) / F.lit(out)).cast("int")
    x = F.get("embedding", at(G.row_of(F.col("px"), 28), 20) * 8 + at(G.column_of(F.col("px"), 28), 28)).cast("double")
    nominal, strict = (f(20, 28, 8, 8)(F.col("px")) for f in (R.nominal_support, R.strict_support))
    return rounded(px.select("category", "image", x.alias("x"), nominal.alias("nominal"), strict.alias("strict")).groupBy("category", "image").agg(
        F.count_if("nominal").alias("nominal_pixels"), F.avg(F.when(F.col("nominal"), F.col("x"))).alias("nominal_mean"),
        F.count_if("strict").alias("strict_pixels"), F.avg(F.when(F.col("strict"), F.col("x"))).alias("strict_mean")))


QUERIES["support_means"] = support_means
ORACLE["support_means"] = f"""WITH p AS (SELECT 'c' || label % 2 AS category, vec_id AS image, embedding, unnest(range(560)) AS px FROM embeddings),
  q AS (SELECT *, px // 28 AS y, px % 28 AS x, px // 28 * 8 // 20 AS cy, px % 28 * 8 // 28 AS cx FROM p),
  s AS (SELECT *, CAST(embedding[cy * 8 + cx + 1] AS DOUBLE) AS v, cy BETWEEN 1 AND 6 AND cx BETWEEN 1 AND 6 AS nominal,
    (y + .5::DOUBLE) * (8::DOUBLE / 20) - .5 BETWEEN 1 AND 6 AND (x + .5::DOUBLE) * (8::DOUBLE / 28) - .5 BETWEEN 1 AND 6 AS strict FROM q)
SELECT category, image, count_if(nominal) AS nominal_pixels, {r('avg(v) FILTER (nominal)')} AS nominal_mean, count_if(strict) AS strict_pixels, {r('avg(v) FILTER (strict)')} AS strict_mean
FROM s GROUP BY ALL"""


def image_order(spark, sf):
    """Stable order of the test images of each category: good ones first, then by name."""
    rows = images(spark, sf).where("split = 'test'").select("category", "image", "anomaly")
    return numbered(rows, ["category"], [("anomaly", "asc"), ("image", "asc")], "place")


QUERIES["image_order"] = image_order
ORACLE["image_order"] = """SELECT 'c' || label % 2 AS category, vec_id AS image, label >= 6 AS anomaly, row_number() OVER (PARTITION BY label % 2 ORDER BY label >= 6, vec_id) AS place
FROM embeddings WHERE label >= 4"""


def selection_problems(spark, sf):
    """Names made from the suppliers against those of the nations: chosen twice or unknown."""
    chosen = table(spark, sf, "supplier").select(F.concat(F.lit("n"), (F.col("s_nationkey") + F.col("s_suppkey") % 3 * 10).cast("string")).alias("name"))
    known = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    return C.selection_problems(chosen, known, "name")


QUERIES["selection_problems"] = selection_problems
ORACLE["selection_problems"] = """WITH c AS (SELECT 'n' || CAST(s_nationkey + s_suppkey % 3 * 10 AS BIGINT) AS name, count(*) AS n FROM supplier GROUP BY ALL), k AS (SELECT 'n' || n_nationkey AS name FROM nation)
SELECT name, 'duplicate' AS problem FROM c WHERE n > 1 UNION ALL SELECT name, 'unknown' FROM c WHERE name NOT IN (SELECT name FROM k)"""


def population_order(spark, sf):
    """Documents without the toxic ones, against a list in which every hundredth was put at the end."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("image"), F.col("doc_id").alias("ord"))
    out = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("image")).join(docs, "image").select("category", "image")
    usable = docs.join(out, ["category", "image"], "left_anti").withColumn("ord", F.when(F.col("image") % 100 == 7, F.col("ord") + 100_000_000).otherwise(F.col("ord")))
    return C.order_problems(docs, out, usable, ["category", "image"], "ord")


QUERIES["population_order"] = population_order
ORACLE["population_order"] = """WITH u AS (SELECT lang AS category, doc_id AS image FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image) AS expected,
    row_number() OVER (PARTITION BY category ORDER BY image + CASE WHEN image % 100 = 7 THEN 100000000 ELSE 0 END) AS actual FROM u)
SELECT * FROM p WHERE expected <> actual"""
