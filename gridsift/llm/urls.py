"""URL filter: rules for hosts and paths, and for all else a logistic regression on hashed character n-grams.

Everything is DataFrame expressions and Spark ML, which runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Character n-grams of host and path, and the buckets they are hashed to.
GRAMS = (3, 4, 5)
FEATURES = 1 << 16
REGULARISATION = 0.001
BLOCK_FROM = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, mark: str) -> Column:
    """N-grams of the text between marks of its ends; none of an empty text."""
    marked = F.concat(F.lit(f"{mark}^"), text, F.lit("$"))
    lists = [F.transform(F.sequence(F.lit(2), F.length(marked) - n + 1), lambda i, n=n: F.concat(F.lit(mark), F.substring(marked, i, n))) for n in GRAMS]
    guarded = [F.when(F.length(marked) - n + 1 >= 2, grams).otherwise(F.array().cast("array<string>")) for n, grams in zip(GRAMS, lists)]
    return F.when(F.length(text) > 0, F.array_distinct(F.concat(*guarded))).otherwise(F.array().cast("array<string>"))


def _with_grams(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return urls.withColumn("host", host).withColumn("path", path).withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))


def fitted(labelled: DataFrame) -> PipelineModel:
    """Model from a small table (url, blocked: 0 or 1). Rows with a null in either are not used; one label only gives that label."""
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    rows = hashing.transform(_with_grams(labelled.where("url is not null and blocked is not null")))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_guess",
                               regParam=REGULARISATION, standardization=False, maxIter=100).fit(rows.withColumn("_label", F.col("blocked").cast("double")))
    return PipelineModel([hashing, model])


def _rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): of each host the rules of it and of the domains above it, by an equi-join on the domain."""
    parts = F.split("host", r"\.")
    domains = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("_domain"))
    known = rules.select(F.col("host").alias("_domain"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"),
                                                                 F.col("path").alias("path"), F.col("verdict").alias("verdict")).alias("_rule"))
    # Rules that fit one host: a handful for each domain above it.
    return domains.join(known, "_domain").groupBy("host").agg(F.collect_set("_rule").alias("_rules"))


def judged(pages: DataFrame, rules: DataFrame, model: PipelineModel, *, block_from: float = BLOCK_FROM) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    Of the ``rules`` (host, path, verdict) that fit (the host or a domain above it is the rule's, the path starts with the
    rule's) the longest decides, of equally long ones the last in the alphabet; ``rule`` is null if none fits. Else the model blocks from
    probability ``block_from`` on; ``score`` is that probability. A null url or one without ``://`` has an empty host and path, and
    what has neither host nor path is allowed with score 0. Repeated rows are judged alike. Other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    urls = _with_grams(pages.select("page_id", "url"))
    scored = model.transform(urls).withColumn("_score", F.when(F.size("_grams") > 0, vector_to_array("_probability")[1]).otherwise(0.0))
    of_host = _rules_of_hosts(urls.select("host").distinct(), rules)
    fitting = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])))
    found = scored.select("page_id", "host", "path", F.col("_score").alias("score")).join(of_host, "host", "left").withColumn("_rule", fitting)
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(
        F.col("_rule.verdict"), F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"), "score")


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of rules written like ``("block", "example.com/de/")``."""
    return spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], verdict) for verdict, r in rules], "host string, path string, verdict string")
