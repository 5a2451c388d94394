"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents keep the terms that some item has, found through a filter of fixed size. Each task cuts its documents into
shards of bounded size and makes an impact list of every term, best first. For an item its lists are read side by side;
a document that is met is scored at once by direct accesses to all its lists, and each access marks a place as seen.
A list's best position is the end of its unbroken run of seen places, however they were seen, so the sum of what stands
behind the best positions bounds every document not met yet. Reading ends once that bound is strictly below the kth score,
which later shards of the task inherit. The shards' best documents are merged at last.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridsift.llm.words import chunks, signed
from gridsift.session import Scratch

#: Bits of the filter over the items' terms, 8 MB. It only spares keeping terms of no item and changes no result.
FILTER_BITS = 26
#: Postings of a shard; a document with more is a shard alone. It bounds memory and changes no result.
SHARD_POSTINGS = 1 << 20
#: Items and terms of items that are sent to all tasks at once; an item with more terms goes alone. It bounds memory and changes no result.
BLOCK_ITEMS, BLOCK_TERMS = 1 << 12, 1 << 18
#: Places read of each list at first, doubled each time up to the second number. They change no result.
FIRST, MOST = 64, 4096


@functools.cache
def _letters() -> np.ndarray:
    byte = np.arange(256)
    return ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def terms(rows: DataFrame, key: str, filter_bits=None) -> DataFrame:
    """(key, n, terms, times) of the rows' texts: all terms with repeats, and 64-bit hashes of the different ones that pass the filter."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        bits = filter_bits.value if filter_bits is not None else None
        for batch in batches:
            for low, high, words in chunks(batch.column(1), lower=True, letters=_letters()):
                text, h = words.text_of(), words.hashes
                if bits is not None:
                    place = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    kept = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    text, h = text[kept], h[kept]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.concatenate([start, [len(h)]]))
                bounds = np.searchsorted(text[start], np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(words.first).astype(np.int64)),
                                                  _lists(signed(h[start]), bounds, pa.int64()), _lists(times, bounds, pa.int64())], names=[key, "n", "terms", "times"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, n long, terms array<long>, times array<long>")


def _filter(wanted: DataFrame) -> np.ndarray:
    place = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    words = wanted.select(place.alias("place")).distinct().groupBy(F.expr("place div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    table = words.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits.view(np.uint8)


class Best:
    """The k best (score, document) of an item, equal scores by rising document; a null document comes last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.docs, self.nulls = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def kth(self) -> int:
        """No document below it can enter; 0 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.kth)
        scores, docs, nulls = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.docs, docs), (self.nulls, nulls)))
        order = np.lexsort((docs, nulls, -scores))[:self.k]
        self.scores, self.docs, self.nulls = scores[order], docs[order], nulls[order]


class Shard:
    """Impact lists of some documents: one after another, each from the highest impact to the lowest."""

    def __init__(self, n_terms: int, docs: np.ndarray, nulls: np.ndarray, of_doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.docs, self.nulls = docs, nulls
        order = np.lexsort((of_doc, -impact, term))
        self.doc, self.impact, self.term = of_doc[order], impact[order], term[order]
        self.first = np.searchsorted(self.term, np.arange(n_terms + 1))
        # Direct access: the places of a document in all lists.
        self.places = np.argsort(self.doc, kind="stable")
        self.of = np.searchsorted(self.doc[self.places], np.arange(len(docs) + 1))
        self.weight = np.zeros(n_terms, dtype=np.int64)
        self.read = 0

    def search(self, item_terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        self.weight[item_terms] = weights
        seen, scored = np.zeros(len(self.doc), dtype=bool), np.zeros(len(self.docs), dtype=bool)
        at, ends, step = self.first[item_terms].copy(), self.first[item_terms + 1], FIRST
        while True:
            open_lists = np.flatnonzero(at < ends)
            # What stands behind the best positions; a document that is not met is at none of the places before.
            bound = int((weights[open_lists] * self.impact[at[open_lists]]).sum())
            if bound == 0 or bound < best.kth:
                break
            met = np.concatenate([self.doc[at[i]:min(at[i] + step, ends[i])] for i in open_lists])
            scored_before = scored.copy()
            scored[met] = True
            new = np.flatnonzero(scored & ~scored_before)
            if len(new):
                self._score(new, seen, best)
            for i in open_lists:
                at[i] = self._best_position(seen, at[i], ends[i], step)
            step = min(2 * step, MOST)
        self.weight[item_terms] = 0

    def _score(self, new: np.ndarray, seen: np.ndarray, best: Best) -> None:
        size = self.of[new + 1] - self.of[new]
        start = np.cumsum(size) - size
        place = self.places[np.arange(size.sum()) - np.repeat(start, size) + np.repeat(self.of[new], size)]
        weight = self.weight[self.term[place]]
        seen[place[weight > 0]] = True
        self.read += len(place)
        best.add(np.add.reduceat(weight * self.impact[place], start), self.docs[new], self.nulls[new])

    @staticmethod
    def _best_position(seen: np.ndarray, at: int, end: int, step: int) -> int:
        while at < end:
            part = seen[at:min(at + step, end)]
            gap = int(np.argmin(part))
            if not part[gap]:
                return at + gap
            at += len(part)
        return end


def _shards(batches, hashes: np.ndarray, n_docs: int, n_all: int, shard_postings: int) -> Iterator[Shard]:
    """Shards of the documents of one task that hold some term of ``hashes`` (sorted)."""
    held, size = [], 0

    def made():
        docs, nulls, n, counts, term, times = (np.concatenate(x) for x in zip(*held))
        of_doc = np.repeat(np.arange(len(docs)), counts)
        m = 75 + (25 * n * n_docs) // n_all
        return Shard(len(hashes), docs, nulls, of_doc, term, (1_000_000_000 * times) // (1000 * times + 12 * m[of_doc]))

    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            values, times = batch.column("terms").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
            term = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            known = hashes[term] == values
            term, times, of = term[known], times[known], of[known]
            docs, new = np.unique(of, return_inverse=True)
            if not len(docs):
                continue
            ids = batch.column("doc_id").take(pa.array(docs))
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy()[docs], np.bincount(new), term, times))
            size += len(term)
            if size >= shard_postings:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _blocks(weighted: DataFrame, sizes: DataFrame) -> Iterator[pa.Table]:
    """Items' terms (row, term, weight) in blocks of whole items, each of bounded size; ``sizes`` has the terms of each row.

    Each block is asked for by itself: an iterator over one sorted query would read shuffle files that ``Scratch`` has removed.
    """
    last = -1
    while True:
        ahead = sizes.where(F.col("row") > last).orderBy("row").limit(BLOCK_ITEMS).toArrow()
        if not ahead.num_rows:
            return
        fit = int(np.searchsorted(np.cumsum(ahead["size"].to_numpy()), BLOCK_TERMS, side="right"))
        low, last = ahead["row"][0].as_py(), ahead["row"][max(fit, 1) - 1].as_py()
        yield weighted.where(F.col("row").between(low, last)).toArrow()


def searched(docs: DataFrame, items: DataFrame, *, k: int = 20, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score; none with score 0.

    Terms are runs of digits, ASCII letters and characters above 127, A-Z lower-cased, told apart by 64-bit hashes. With N
    documents that have a term, L terms in all, n in a document and df documents that hold the term, a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))) and gives (10^9 tf) div (1000 tf + 12 m) for m = 75 + (25 n N) div L. The score sums weight times
    that over the item's terms, repeats included. Equal scores go by rising doc_id, null last. Each row of ``docs`` is a document
    and each row of ``items`` an item, whatever its id; null or empty texts have no terms, and an item without any has no rows. Other columns
    are not read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    with Scratch(spark) as scratch:
        numbered = scratch.kept(items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "items")
        wanted = scratch.kept(terms(numbered, "row").select("row", F.explode(F.arrays_zip("terms", "times")).alias("x")).select(
            "row", F.col("x.terms").alias("term"), F.col("x.times").alias("times")), "item-terms")
        bits = spark.sparkContext.broadcast(_filter(wanted))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = scratch.kept(terms(texts, "doc_id", bits).where("n > 0"), "postings")
        n_docs, n_all = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
        weighted = scratch.kept(wanted.join(df, "term").select("row", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "item-weights")

        sizes = scratch.kept(weighted.groupBy("row").agg(F.count(F.lit(1)).alias("size")), "item-sizes")
        best = None
        for table in _blocks(weighted, sizes):
            block = _searched(spark, found, table, n_docs, n_all, k, shard_postings)
            best = block if best is None else best.unionByName(block)
        if best is None:
            return scratch.result(spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long"), "ranked")
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # k rows a task; ranks prune them before the shuffle
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scratch.result(ranked.join(numbered.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score"), "ranked")


def _searched(spark, found: DataFrame, table: pa.Table, n_docs: int, n_all: int, k: int, shard_postings: int) -> DataFrame:
    """(row, doc_id, score): the k best of each task for one block of items."""
    table = table.sort_by("row")
    hashes, term = np.unique(table["term"].to_numpy(), return_inverse=True)
    rows, first = np.unique(table["row"].to_numpy(), return_index=True)
    shared = spark.sparkContext.broadcast((hashes, term, table["weight"].to_numpy(), rows, np.concatenate([first, [len(term)]])))

    def run(batches):
        hashes, term, weight, rows, bounds = shared.value
        best = [Best(k) for _ in rows]
        for shard in _shards(batches, hashes, n_docs, n_all, shard_postings):
            for i in range(len(rows)):
                part = slice(bounds[i], bounds[i + 1])
                shard.search(term[part], weight[part], best[i])
        for row, b in zip(rows.tolist(), best):
            if len(b.docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.docs), row)), pa.array(b.docs, mask=b.nulls), pa.array(b.scores)], names=["row", "doc_id", "score"])

    return found.mapInArrow(run, "row long, doc_id long, score long")
