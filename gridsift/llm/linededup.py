"""Removal of repeated blocks of lines, cut where their content says so.

A rolling hash over the hashes of neighbouring lines ends a chunk, so a line put in or taken out moves only the cuts
beside it and equal blocks are cut alike in every text. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridsift.session import Scratch

#: A chunk ends where the rolling hash is a multiple of it: chunks of about three lines.
DIVISOR = 3
#: Chunks of fewer lines are never removed.
LEAST_LINES = 2
#: Lines that the rolling hash covers, and its factor and modulus.
ROLL_LINES, FACTOR, MODULUS = 2, 263, 2147483647


def _cut(lines: Column, hashes: Column, divisor: int) -> Column:
    """First lines (from 0) of the chunks: the first line, and each one behind a line where the rolling hash ends a chunk."""
    def rolled(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(ROLL_LINES, 0, -1):
            total = (total * FACTOR + F.get(hashes, i - back)) % MODULUS
        return total

    ends = F.filter(F.sequence(F.lit(ROLL_LINES), F.size(lines)), lambda i: (i < F.size(lines)) & (rolled(i) % divisor == 0))
    return F.when(F.size(lines) > ROLL_LINES, F.concat(F.array(F.lit(0)), ends)).otherwise(F.array(F.lit(0)))


def _with_chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """Columns of docs and ``_lines``, ``_chunks`` (first line, lines), ``_row`` (which tells rows of one doc_id apart)."""
    lines = F.split("text", "\n", -1)
    # The first eight hexadecimal digits of a line's MD5 as a number: any engine computes it alike.
    hashes = F.transform("_lines", lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS)
    with_starts = docs.withColumn("_lines", lines).withColumn("_hashes", hashes).withColumn("_starts", _cut(F.col("_lines"), F.col("_hashes"), divisor))
    chunk = F.transform("_starts", lambda start, i: F.struct(
        start.alias("start"), (F.coalesce(F.get("_starts", i + 1), F.size("_lines")) - start).alias("n")))
    return with_starts.withColumn("_chunks", chunk).withColumn("_row", F.xxhash64("text")).drop("_hashes", "_starts")


def _text(chunk: Column) -> Column:
    return F.array_join(F.slice("_lines", chunk["start"] + 1, chunk["n"]), "\n")


def without_repeats(docs: DataFrame, *, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the text left over and two further columns, n_lines and n_removed.

    Of equal chunks of at least ``least_lines`` lines the first by (doc_id, text hash, place) stays, all others go, in the
    same text too; rows with a null doc_id come last. Rows that repeat doc_id and text count as one and share the result.
    Null texts stay null, with 0 lines; an empty text is one empty line. Every row of ``docs`` comes back. Columns named
    like the results (n_lines, n_removed) are replaced, others may have any name; an n_chars column is not brought up to date.

    The texts are joined by sorting at every size, so that a job does the same on a small corpus as on a large one.
    Only hashes of all chunks are shuffled; texts of chunks whose hash repeats are then compared byte by byte, by grouping
    on the text itself, added up map-side, so a chunk of many copies arrives with few rows.
    """
    others = docs.drop("n_lines", "n_removed")
    columns = {c if c in ("doc_id", "text") else f"_column_{i}": c for i, c in enumerate(others.columns)}
    base = others.toDF(*columns)  # so that no name below is one of the caller's
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_chunk.start").alias("start"))
    slim = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null")
    many = F.filter("_chunks", lambda c: c["n"] >= least_lines)
    with Scratch(docs.sparkSession) as scratch:
        listed = _with_chunks(slim, divisor).select("_id", "_row", F.explode(F.transform(many, lambda c: F.struct(
            c["start"].alias("start"), F.xxhash64(_text(c)).alias("hash")))).alias("_chunk"))
        hashes = listed.groupBy("_chunk.hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        repeated = hashes.where("first <> last").select("hash")
        marked = listed.select("_id", "_row", F.col("_chunk.start").alias("start"), F.col("_chunk.hash").alias("hash")).join(repeated, "hash")
        # Chunks of one text: no more than its lines.
        marked = scratch.kept(marked.groupBy("_id", "_row").agg(F.collect_set("start").alias("_wanted")), "marked")

        def same(a: DataFrame, b: DataFrame) -> list[Column]:
            return [a["_id"].eqNullSafe(b["_id"]), a["_row"] == b["_row"]]

        keyed = slim.withColumn("_row", F.xxhash64("text"))
        wanted = keyed.join(marked.hint("merge"), same(keyed, marked)).select(keyed["_id"], "text", "_wanted")
        chunks = _with_chunks(wanted, divisor).select("_id", "_row", F.explode(F.filter(
            "_chunks", lambda c: F.array_contains("_wanted", c["start"]))).alias("_chunk"), "_lines").select("_id", "_row", "_chunk", _text(F.col("_chunk")).alias("block"))
        chunks = chunks.select("block", F.xxhash64("block").alias("hash"), place.alias("place"))
        firsts = chunks.groupBy("hash", "block").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
        gone = chunks.join(firsts, ["hash", "block"]).where("place <> first").select(F.col("place.id").alias("_id"), F.col("place.row").alias("_row"), F.col("place.start").alias("start"))
        # The one table that stays: the result reads it, and is made of the texts when it is used.
        gone = scratch.result(gone.groupBy("_id", "_row").agg(F.collect_set("start").alias("_gone")), "gone")

        rows = base.withColumn("_id", F.col("doc_id")).withColumn("_row", F.xxhash64("text"))
        joined = rows.join(gone.withColumnsRenamed({"_id": "_gone_id", "_row": "_gone_row"}).hint("merge"),
                           F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left")
        cut = _with_chunks(joined, divisor)
        kept = F.filter("_chunks", lambda c: ~F.array_contains("_gone", c["start"]))
        left = F.array_join(F.flatten(F.transform(kept, lambda c: F.slice("_lines", c["start"] + 1, c["n"]))), "\n")
        removed = F.aggregate(F.filter("_chunks", lambda c: F.array_contains("_gone", c["start"])), F.lit(0).cast("long"), lambda total, c: total + c["n"])
        return cut.select(*[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c).alias(name) for c, name in columns.items()],
                            F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
                            F.when(F.col("_gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))
