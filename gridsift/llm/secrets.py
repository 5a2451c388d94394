"""Secret scan: long tokens and values assigned to key words are candidates, and a random forest removes those that are none.

The forest sees a candidate's length, its runs of character classes, how much of it the corpus's common words cover, the
path, and the words around it. Everything is DataFrame expressions and Spark ML, which runs in the JVM.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Characters around a candidate that are looked at.
BEFORE, AFTER = 32, 16
#: Common words: so many, of such lengths. A fixed number of short words, found by counting all documents.
DICTIONARY, WORD_LENGTHS = 300, (3, 6)
TREES, DEPTH, SEED = 60, 6, 7
SECRET_FROM = 0.5

# Words that stand beside secrets, beside what looks like one, and in paths of examples.
KEY_WORDS = "key token secret passw pwd api auth credential bearer private"
OTHER_WORDS = "commit sha md5 checksum hash digest uuid guid etag revision version isbn order invoice card phone id"
EXAMPLE_WORDS = "example sample dummy placeholder your test fake mock fixture changeme xxxx"

#: Name with a key word, sign of an assignment and opening quote: what stands before an assigned value.
ASSIGNMENT = (r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{0,40}?(?i:" + "|".join(KEY_WORDS.split()) + r")[A-Za-z0-9_\-]{0,40}[\"']?\s{0,4}(?::=|=>|[=:])\s{0,4}")
#: Assigned values: whatever the quotes hold, or all up to a blank, quote or separator, without the stop of a sentence.
_VALUE = r"(?:\"[^\"\n]{4,}+(?=\")|'[^'\n]{4,}+(?=')|[^\s\"'<>;,&]{3,}(?<=[^\s\"'<>;,&.:!?)\]}]))"
#: Tokens: several with dots between them, or a long one; '=' belongs to it as padding at its end only.
_DOTTED = r"[A-Za-z0-9_\-]{2,}+(?:\.[A-Za-z0-9_\-]{10,}+)+"
_TOKEN = r"[A-Za-z0-9+/_\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=\-\"']))?"
CANDIDATE = f"{ASSIGNMENT}{_VALUE}|{_DOTTED}|{_TOKEN}"

FEATURES = ("length", "runs", "digits", "upper", "distinct", "hex", "words", "key_near", "assigned", "quoted", "other_near", "example_near", "example_path")


def dictionary(docs: DataFrame) -> list[str]:
    """The ``DICTIONARY`` words that most documents hold, ties in the order of the alphabet; counted over all documents."""
    low, high = WORD_LENGTHS
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b[a-z]{{{low},{high}}}\b"), F.lit(0)))).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(DICTIONARY)
    return [row.word for row in top.collect()]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, path, start (character, from 0), candidate, before, after.

    Of an assignment the value is the candidate; its name and quote belong to what is before.
    """
    found = docs.where("text is not null").select(
        "doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("text", CANDIDATE, -1).alias("_between"))
    found = found.where(F.size("_found") > 0)
    # The whole match decides: a token that only looks like an assignment at its start has no value behind it.
    led = F.transform("_found", lambda c: F.regexp_extract(c, f"^({ASSIGNMENT}(?:\"(?=[^\"\\n]{{4,}}$)|'(?=[^'\\n]{{4,}}$))?)(?s:.{{3,}})$", 1))
    found = found.withColumn("_led", led)
    each = F.transform("_found", lambda c, i: F.struct(
        F.substring(c, F.length(F.get("_led", i)) + 1, F.length(c)).alias("candidate"),
        F.right(F.concat(F.get("_between", i), F.get("_led", i)), F.lit(BEFORE)).alias("before"),
        F.left(F.concat(F.get("_between", i + 1), F.coalesce(F.get("_found", i + 1), F.lit(""))), F.lit(AFTER)).alias("after"),
        (F.length(F.get("_between", i)) + F.length(c)).alias("step")))
    # A candidate starts behind all text before it: summed up along the list.
    placed = F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
                         lambda done, c: F.struct((done["at"] + c["step"]).alias("at"), F.concat(done["starts"], F.array(done["at"] + c["step"] - F.length(c["candidate"]))).alias("starts")),
                         lambda done: done["starts"])
    rows = found.select("doc_id", "path", F.explode(F.arrays_zip(each.alias("c"), placed.alias("start"))).alias("_row"))
    return rows.select("doc_id", "path", F.col("_row.start").alias("start"), F.col("_row.c.candidate").alias("candidate"),
                       F.col("_row.c.before").alias("before"), F.col("_row.c.after").alias("after"))


def labelled(findings: DataFrame) -> DataFrame:
    """The candidates of the labelled texts (before, candidate and after, joined) with their label ``secret``.

    The labelled candidate has its label, others beside it are none; what only overlaps with it teaches nothing.
    """
    texts = findings.where("secret is not null and candidate is not null").select(
        F.struct(F.coalesce("before", F.lit("")).alias("before"), "candidate", "secret").alias("doc_id"), "path",
        F.concat(F.coalesce("before", F.lit("")), "candidate", F.coalesce("after", F.lit(""))).alias("text"))
    start, size, low = F.length("doc_id.before"), F.length("doc_id.candidate"), F.col("start")
    rows = candidates(texts)
    same = (low == start) & (F.col("candidate") == F.col("doc_id.candidate"))
    apart = (low + F.length("candidate") <= start) | (low >= start + size)
    return rows.where(same | apart).select("path", "candidate", "before", "after", F.when(same, F.col("doc_id.secret")).otherwise(0).alias("secret"))


def _any(words: str) -> str:
    return "(?i)(" + "|".join(words.split()) + ")"


def featured(rows: DataFrame, words: list[str]) -> DataFrame:
    """Columns of ``FEATURES`` beside those of ``rows`` (candidate, before, after, path; nulls count as empty)."""
    c = F.coalesce("candidate", F.lit(""))
    n = F.greatest(F.length(c), F.lit(1))
    before, after, path = (F.coalesce(x, F.lit("")) for x in ("before", "after", "path"))
    classes = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)

    def share(pattern: str) -> Column:
        return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n

    covered = share("(?i)(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")") if words else F.lit(0.0)
    made = {
        "length": F.length(c), "runs": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n, "digits": share("[^0-9]") * -1 + 1,
        "upper": 1 - share("[^A-Z]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "hex": F.rlike(c, F.lit("^[0-9a-f]+$")),
        "words": covered, "key_near": F.rlike(before, F.lit(_any(KEY_WORDS))), "assigned": F.rlike(before, F.lit(r"[=:]\s*[\"']?$")),
        "quoted": F.rlike(before, F.lit("[\"']$")) & F.rlike(after, F.lit("^[\"']")), "other_near": F.rlike(before, F.lit(_any(OTHER_WORDS) + r"\W*$")),
        "example_near": F.rlike(F.concat(before, c, after), F.lit(_any(EXAMPLE_WORDS))), "example_path": F.rlike(path, F.lit(_any(EXAMPLE_WORDS)))}
    return rows.select("*", *[made[name].cast("double").alias(f"_f_{name}") for name in FEATURES])


def fitted(findings: DataFrame, words: list[str]) -> PipelineModel:
    """Forest from labelled findings (candidate, before, after, path, secret: 0 or 1); rows without a label are not used."""
    rows = featured(labelled(findings), words)
    assembler = VectorAssembler(inputCols=[f"_f_{name}" for name in FEATURES], outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_guess",
                                    numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembler.transform(rows).withColumn("_label", F.col("secret").cast("double")))
    return PipelineModel([assembler, forest])


def scanned(docs: DataFrame, findings: DataFrame, *, path: str | None = None, secret_from: float = SECRET_FROM) -> DataFrame:
    """One row per secret found in ``docs`` (doc_id, text): doc_id, start, length, secret_sha256, score.

    ``path`` names the column that tells where a text comes from, if there is one; ``findings`` are labelled. Null, empty and
    plain texts give no row; a null doc_id stays null; repeated rows give repeated results. Other columns are not read.
    An empty table gives an empty result. Secrets themselves are not returned, only where they stand and their hash.
    """
    texts = docs.select("doc_id", "text", (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    words = dictionary(texts)
    scored = fitted(findings, words).transform(featured(candidates(texts), words))
    score = vector_to_array("_probability")[1]
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"),
                         F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), score.alias("score")).where(F.col("score") >= secret_from)
