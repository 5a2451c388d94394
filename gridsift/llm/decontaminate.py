"""Benchmark items in documents, also with other numbers, names and units put in.

Tokens (runs of letters, digits and bytes above 127) are made canonical: numbers, names and units become typed
placeholders, all else is lower-cased. Windows of canonical tokens meet by hash. Windows that lie at one distance in
document and item are one copy of a passage; its placeholders must be filled consistently, each number or name of the item always
by the same one, or the meeting is a coincidence of wording. A document is contaminated by an item if consistent copies
cover enough of the item's windows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsift.llm.words import Words, chunks, grams, mixed, signed
from gridsift.session import Scratch

#: Canonical tokens of a window, and how many of them must be no placeholders.
WINDOW, LEAST_WORDS = 5, 3
#: Share of an item's windows that consistent copies must cover.
COVERAGE = 0.5
#: Bits of the filter over the windows of all items, 8 MB. It only spares shuffling windows that no item has; a fuller
#: filter lets more of them pass and changes no result.
FILTER_BITS = 26

# Units that stand behind a number.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres "
         "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
         "usd eur degree degrees celsius fahrenheit percent volt volts watt watts joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb").split()

_NUMBER, _NAME, _UNIT = 1, 2, 3
_KIND_HASH = mixed(np.array([0, 11, 22, 33], dtype=np.uint64))
_HIT = "hash long, position int, slots array<int>, kinds array<int>, values array<long>, reading int"


@functools.cache
def _classes() -> tuple[np.ndarray, ...]:
    byte = np.arange(256)
    digit, upper, lower = (byte >= 48) & (byte <= 57), (byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122)
    return digit | upper | lower | (byte >= 128), digit, upper, np.isin(byte, list(b".!?:\n")), np.isin(byte, list(b".,:/"))


@functools.cache
def _units() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    return np.sort(Words(data, np.array([0, len(data)]), lower=True).hashes)


def canonical(words: Words, opening: bool = False):
    """(text, hash, kind, value) of the canonical tokens; the kind is 0 for a word, the value tells fillings apart.

    A number is a token of digits; parts joined by one of ``.,:/`` are one number. A unit is one of the list behind a
    number. A name starts with an upper-case letter (A-Z), goes on with something else than one and does not start a sentence,
    unless ``opening`` says that what starts one is read as a name as well.
    """
    _, digit, upper, ends, joins = _classes()
    data, starts, stops = words.data, words.starts, words.ends
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, words.hashes, none, words.hashes
    digits = np.concatenate([[0], np.cumsum(digit[data])])
    number = digits[stops] - digits[starts] == stops - starts
    text = words.text_of()
    new = np.ones(len(starts), dtype=bool)
    new[1:] = text[1:] != text[:-1]
    gap = np.ones(len(starts), dtype=np.int64)
    gap[1:] = starts[1:] - stops[:-1]
    before, second = data[np.maximum(starts - 1, 0)], data[np.maximum(starts - 2, 0)]
    part = np.zeros(len(starts), dtype=bool)  # goes on with the number before it
    part[1:] = number[1:] & number[:-1] & ~new[1:] & (gap[1:] == 1) & joins[before[1:]]
    opens = new | (before == 10) | ((before == 32) & ends[second])
    after = data[np.minimum(starts + 1, len(data) - 1)]
    name = upper[data[starts]] & (stops - starts > 1) & ~upper[after] & (opening | ~opens)
    unit = np.zeros(len(starts), dtype=bool)
    unit[1:] = number[:-1] & ~new[1:] & np.isin(words.hashes[1:], _units())
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, 0)))
    # Parts of one number are one token; its value is made of theirs.
    first = np.flatnonzero(~part)
    joined = words.hashes.copy()
    joined[part] = mixed(joined[part])
    total = np.add.reduceat(joined, first)
    kind, value = kind[first], mixed(total)
    return text[first], np.where(kind == 0, words.hashes[first], _KIND_HASH[kind]), kind, value


def windows(words: Words, window: int, least_words: int, opening: bool = False):
    """(text, position, hash, first token) of the windows with enough words that are no placeholders, and all tokens."""
    text, h, kind, value = canonical(words, opening)
    first = np.searchsorted(text, np.arange(len(words.first)))
    at, key = grams(h, first, window)
    # What starts a sentence counts as a word under either reading, so both have the same windows.
    plain = np.concatenate([[0], np.cumsum((canonical(words)[2] if opening else kind) == 0)])
    enough = plain[at + window] - plain[at] >= least_words
    at, key = at[enough], key[enough]
    return text[at], at - first[text[at]], key, at, kind, value


#: Readings of a capitalised token that starts a sentence: a word, a name; windows without one are the same in both.
_AS_WORD, _AS_NAME, _BOTH = 0, 1, 2


def _rows(batch, chunk_from, words, window, least_words, bits, opening):
    """Windows of one slice under one reading as Arrow columns (id, hash, position, slots, kinds, values, reading)."""
    text, position, key, at, kind, value = windows(words, window, least_words, opening)
    differs = np.concatenate([[0], np.cumsum(kind != canonical(words, not opening)[2])])
    reading = np.where(differs[at + window] > differs[at], _AS_NAME if opening else _AS_WORD, _BOTH)
    keep = ~(opening & (reading == _BOTH))
    if bits is not None:
        place = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        keep &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    text, position, key, at, reading = text[keep], position[keep], key[keep], at[keep], reading[keep]
    grid = at[:, None] + np.arange(window)
    filled = kind[grid] > 0 if len(at) else np.zeros((0, window), dtype=bool)
    row, slot = np.nonzero(filled)
    offsets = pa.array(np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32))
    inner = grid[row, slot] if len(at) else row
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (slot.astype(np.int32), kind[inner].astype(np.int32), signed(value[inner]))]
    return [batch.column(0).take(pa.array(chunk_from + text)), pa.array(signed(key)), pa.array(position.astype(np.int32)), *lists, pa.array(reading.astype(np.int32))]


def _hits(rows: DataFrame, window: int, least_words: int, bits=None, key: str = "doc_id") -> DataFrame:
    def run(batches):
        held = bits.value if bits is not None else None
        for batch in batches:
            for low, _, words in chunks(batch.column(1), lower=True, letters=_classes()[0]):
                for opening in (False, True):
                    yield pa.RecordBatch.from_arrays(_rows(batch, low, words, window, least_words, held, opening),
                                                     names=[key, "hash", "position", "slots", "kinds", "values", "reading"])

    return rows.mapInArrow(run, f"{key} long, {_HIT}")


def _filter(wanted: DataFrame) -> np.ndarray:
    """Bits of the hashes in ``wanted``; at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    words = wanted.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("place")).distinct().groupBy(F.expr("place div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    table = words.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits.view(np.uint8)


def _runs(rows: DataFrame, lengths: list[int], whole_below: int, bits=None) -> DataFrame:
    """(the columns of ``rows`` but the last, its text; n, hash, position, runs) of the runs of n plain tokens, n of ``lengths``.

    A text gives runs of n < ``whole_below`` only if it has n tokens; ``runs`` is how many runs of n tokens it has.
    """
    keys = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            for low, _, words in chunks(batch.column(len(keys)), lower=True, letters=_classes()[0]):
                sizes, text = np.diff(words.first), words.text_of()
                for n in lengths:
                    at, h = words.grams(n)
                    key = mixed(h ^ np.uint64(0x7C15D3A9B4E1F263))
                    keep = sizes[text[at]] == n if n < whole_below else np.ones(len(at), dtype=bool)
                    if bits is not None:
                        place = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        keep &= (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    at, key = at[keep], key[keep]
                    owner = text[at]
                    own = [batch.column(i).take(pa.array(low + owner)) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(signed(key)), pa.array((at - words.first[owner]).astype(np.int32)),
                         pa.array((sizes[owner] - n + 1).astype(np.int32))], names=[*keys, "n", "hash", "position", "runs"])

    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", n int, hash long, position int, runs int")


def _verbatim(texts: DataFrame, items: DataFrame, window: int, least_words: int, scratch: Scratch) -> DataFrame | None:
    """Documents that hold all tokens of an item in a row; None if there are no items.

    An item of less than ``least_words`` tokens must be the whole text. Longer items are met by their runs of ``window`` tokens,
    all of which must lie at one distance; so the lengths looked for are at most ``window``, however long the items.
    """
    parts = items.select("item_id", F.xxhash64("text").alias("part"), "text").distinct()
    wanted = scratch.kept(_runs(parts, list(range(1, window + 1)), window), "item-runs")
    lengths = sorted(row[0] for row in wanted.select("n").distinct().collect())  # at most ``window``
    if not lengths:
        return None
    found = _runs(texts, lengths, least_words, texts.sparkSession.sparkContext.broadcast(_filter(wanted)))
    met = found.select("doc_id", "n", "hash", "position").join(wanted.withColumnRenamed("position", "item_position"), ["n", "hash"])
    whole = met.groupBy("doc_id", "item_id", "part", "runs", (F.col("position") - F.col("item_position")).alias("distance")).agg(
        F.count_distinct("item_position").alias("met")).where("met = runs")
    return whole.groupBy("doc_id", "item_id").agg(F.max("runs").cast("long").alias("n_windows")).select(
        "doc_id", "item_id", "n_windows", F.col("n_windows").alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(True).alias("verbatim"))


def contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, least_words: int = LEAST_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows (of the item), n_matched, coverage, verbatim.

    ``verbatim`` tells that all numbers, names and units are the item's own. Items without a window of ``least_words``
    words that are no placeholders cannot be told from chance when filled anew. They, and items with so few windows that the text around
    a copy could hide it, are found where all their tokens stand in a row as they are (but for case), n_windows then counting
    their runs of ``window`` tokens, or 1; items of less than ``least_words`` tokens only where they are the whole text. Null, empty or short texts match nothing, nor do rows without an id. Rows that repeat an id are parts of one document or item and repeated rows change
    nothing. Other columns are not read. An empty table on either side gives an empty result.

    Windows that occur in no item are dropped map-side by a filter of fixed size; a passage of many documents is a hot
    hash, whose document side adaptive execution can split since the join is plain. Groups hold the matched windows of one document
    and item at one distance: no more than the item has.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
        wanted = scratch.kept(_hits(asked, window, least_words, key="item_id").distinct(), "item-windows")
        sizes = wanted.groupBy("item_id").agg(F.count_distinct("position").alias("n_windows"))
        shared = spark.sparkContext.broadcast(_filter(wanted))

        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = _hits(texts, window, least_words, shared)
        theirs = wanted.select("item_id", "hash", F.col("position").alias("item_position"), F.col("values").alias("item_values"), F.col("reading").alias("item_reading"))
        # Copies are judged under each reading by itself, so that one reading spoils none of the other.
        readings = F.when((F.col("reading") == _AS_NAME) | (F.col("item_reading") == _AS_NAME), F.array(F.lit(_AS_NAME))).when(
            (F.col("reading") == _BOTH) & (F.col("item_reading") == _BOTH), F.array(F.lit(_AS_WORD), F.lit(_AS_NAME))).otherwise(F.array(F.lit(_AS_WORD)))
        met = found.join(theirs, "hash").select(
            "doc_id", "item_id", (F.col("position") - F.col("item_position")).alias("distance"), "item_position",
            F.arrays_zip(F.col("kinds").alias("kind"), F.col("item_values").alias("item"), F.col("values").alias("doc")).alias("filled"), F.explode(readings).alias("as"))
        copies = met.groupBy("doc_id", "item_id", "distance", "as").agg(F.collect_set("item_position").alias("positions"),
                                                                  F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"))
        # Units may be others from place to place; numbers and names may not.
        named = F.filter("filled", lambda f: f["kind"] != _UNIT)
        sources = F.array_distinct(F.transform(named, lambda f: F.struct(f["kind"].alias("kind"), f["item"].alias("item"))))
        copies = copies.where(F.size(named) == F.size(sources))
        whole = copies.groupBy("doc_id", "item_id").agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).cast("long").alias("n_matched"),
            F.bool_or(~F.exists("filled", lambda f: f["item"] != f["doc"])).alias("verbatim"))
        result = whole.join(sizes, "item_id").withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
        result = result.select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "verbatim")
        # What stands around a copy can change how its first and last token are read, and so at most two of its windows.
        safe = sizes.where(F.col("n_windows") - 2 >= coverage * F.col("n_windows"))
        short = _verbatim(texts, asked.join(safe, "item_id", "left_anti"), window, least_words, scratch)
        if short is None:
            return scratch.result(result, "contaminated")
        result = scratch.kept(result, "by-windows")
        return scratch.result(result.unionByName(short.join(result, ["doc_id", "item_id"], "left_anti")), "contaminated")
