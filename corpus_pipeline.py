"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsift.session import Scratch


def _guarded(docs: DataFrame):
    """``docs`` with its further columns under names that no operator uses, and the function that gives them their own back."""
    inner = {c if c in ("doc_id", "text", "lang") else f"_column_{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*inner), lambda df: df.select(*[F.col(c).alias(name) for c, name in inner.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in some language: null, empty, without letters, or better explained by the background, a text goes.

    Rows are judged by their text alone, so repeated rows and ids fare alike. An empty table gives an empty one.
    """
    from gridsift.llm.langid import identified
    inner, back = _guarded(docs)
    return back(identified(inner, keep=[c for c in inner.columns if c != "doc_id"]).where("not rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier text holds; n_chars is that of what is left. All documents stay.

    Rows of one doc_id with different texts are different texts; rows that repeat both share the result. Null texts stay null.
    """
    from gridsift.llm.linededup import without_repeats
    inner, back = _guarded(docs)
    left = back(without_repeats(inner))
    return left.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes])


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id. Documents without an id or without words stay.

    A row goes for its own text: if an id is repeated, a row of it that is like no other stays. Rows of the smallest id of
    their group are one document and stay together.
    """
    from gridsift.llm.jaccard import similar_groups
    inner, back = _guarded(docs)
    others = similar_groups(docs, with_hash=True).where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias("_row")).distinct()
    return back(inner.withColumn("_row", F.xxhash64("text")).join(others.hint("merge"), ["doc_id", "_row"], "left_anti"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own or other numbers and names.

    Each row is searched by itself, with or without an id: of rows with one id only those go that hold an item. Null and empty texts stay.
    """
    from gridsift.llm.decontaminate import contaminated
    inner, back = _guarded(docs)
    rows = inner.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_row")).distinct()
    return back(rows.join(found.hint("merge"), "_row", "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts and the checks of their round trip."""
    import public_tokenizers

    from gridsift.llm.bpe import encoded
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", similar), ("benchmark decontamination", benchmark), ("byte-level BPE", encode)]

#: The mixture model, the shared wording with consistent slots and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            before, docs = docs, scratch.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            if k:
                scratch.drop(before)
        name, stage = STAGES[-1]
        return scratch.result(stage(spark, docs, sf_dir), name.replace(" ", "-"))


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
