"""Removal of word passages that an earlier document holds, with compressed full-text indexes as shards.

A window is ``window`` consecutive words. Its least run of ``ANCHOR`` words by hash is its anchor, so equal windows have
equal anchors, and consecutive windows mostly share one: they form a segment. Segments whose anchor occurs in several
documents go to the shard of their anchor. A shard indexes its different segments, searches each of their windows
backward from the last to the first, and takes the smallest document over the window's interval of the suffix order.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsift.llm.fm import Index
from gridsift.llm.words import Words, chunks, run_hashes, signed
from gridsift.session import Scratch

WINDOW, ANCHOR = 13, 5
#: A shard is closed at the next anchor once it holds so many words; its index takes some 60 bytes a word.
SHARD_WORDS = 1 << 18
#: Segments that one task is meant to get: a few shards.
TASK_SEGMENTS = 50_000

_FIRST_BITS, _COUNT_BITS = 28, 4


def _anchors(words: Words, window: int, anchor: int):
    """(first word of the chunk, windows, text, anchor hash) of the segments, in the order of the texts."""
    at, h = words.grams(anchor)
    full = np.full(len(words.hashes), np.uint64(2**64 - 1))
    full[at] = h
    starts, _ = words.grams(window)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, dtype=np.uint64)
    least = starts + _least(full, window - anchor + 1)[0][starts]
    text = words.text_of()[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    s = np.flatnonzero(new)
    return starts[s], np.diff(np.append(s, len(starts))), text[s], full[least[s]]


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, value) of the least of every run of ``width`` values, of equal ones the first."""
    runs = max(0, len(values) - width + 1)
    best, at = values[:runs].copy(), np.zeros(runs, dtype=np.uint8)
    for i in range(1, width):
        now = values[i:runs + i]
        less = now < best
        np.copyto(best, now, where=less)
        np.copyto(at, np.uint8(i), where=less)
    return at, best


def _checksums(column: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in column.cast(pa.binary()).to_pylist()], dtype=np.int64)


def _packed(check: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Checksum of the text, windows and first word of a segment in one number."""
    return (check << 32) | (count << _FIRST_BITS) | first


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> 32) & 0xFFFFFFFF, (place >> _FIRST_BITS) & ((1 << _COUNT_BITS) - 1), place & ((1 << _FIRST_BITS) - 1)


def _batch(names, arrays, where=None):
    return pa.RecordBatch.from_arrays([pa.array(a if where is None else a[where]) for a in arrays], names=names)


_ROWS = ["anchor", "doc_id", "place"]
_ALONE, _HEAD, _SHARED = 0, 1, 2


def _candidates(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, place) of the segments whose anchor occurs in several documents.

    Segments of one slice of texts that share an anchor are known to do so; only the one with the smallest document goes
    on to the shuffle, so an anchor of many documents arrives there with few rows.
    """
    def local(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, words in chunks(batch.column(1)):
                first, count, text, key = _anchors(words, window, anchor)
                doc = ids[low:high][text]
                place = _packed(_checksums(batch.column(1).slice(low, high - low))[text], count, first - words.first[text])
                order = np.lexsort((doc, key))
                key, doc, place = key[order], doc[order], place[order]
                starts, ends, of = _groups(key)
                shared = (doc[starts] < doc[ends - 1])[of] if len(key) else np.zeros(0, dtype=bool)
                kind = np.where(shared, _SHARED, _ALONE)
                heads = starts[shared[starts]]
                rows = [np.concatenate([a, a[heads]]) for a in (signed(key), doc, place)]
                yield _batch([*_ROWS, "kind"], [*rows, np.concatenate([kind, np.full(len(heads), _HEAD)])])

    def across(batches):
        pending, open_key = None, None  # rows of the last anchor while it has one document; the last anchor once it has several
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            known = rows[3] == _SHARED
            if known.any():
                yield _batch(_ROWS[1:], rows[1:3], np.flatnonzero(known))
                rows = [a[~known] for a in rows]
            if pending is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(pending, rows)]
            key, doc, _, kind = rows
            if not len(key):
                continue
            starts, ends, of = _groups(key)
            several = doc[starts] < doc[ends - 1]
            if open_key is not None and key[0] == open_key:
                several[0] = True
            tail = starts[-1] if not several[-1] else len(key)
            found = several[of] & (kind == _ALONE)
            pending = [a[tail:].copy() for a in rows] if tail < len(key) else None
            open_key = key[-1] if pending is None else None
            yield _batch(_ROWS[1:], rows[1:3], np.flatnonzero(found))

    found = texts.mapInArrow(local, "anchor long, doc_id long, place long, kind long")
    # Rows that are known to be shared take the same exchange, so that the texts are read once; they are dealt evenly.
    dealt = found.repartition(F.when(F.col("kind") == _SHARED, F.xxhash64("anchor", "doc_id", "place")).otherwise(F.col("anchor")))
    return dealt.sortWithinPartitions("anchor", "doc_id").mapInArrow(across, "doc_id long, place long")


def _groups(key: np.ndarray):
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(key)), np.cumsum(new) - 1


def _segments(marked: DataFrame, window: int, anchor: int, with_text: bool) -> DataFrame:
    """Segments of texts with their ``places``: where each is, or the different ones of a slice with their words."""
    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            offsets, every = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            for low, high, words in chunks(batch.column(1)):
                place = every[offsets[low] - offsets[0]:offsets[high] - offsets[0]]
                text = np.repeat(np.arange(high - low), np.diff(offsets[low:high + 1]))
                check, count, first = _unpacked(place)
                own = check == _checksums(batch.column(1).slice(low, high - low))[text]  # else of another text with this doc_id
                place, text, count, first = place[own], text[own], count[own], first[own]
                at, n = words.first[text] + first, count + window - 1
                segment, doc = run_hashes(words.hashes, at, n), ids[low:high][text]
                if not with_text:
                    yield _batch(["segment", "doc_id", "place"], [signed(segment), doc, place])
                    continue
                order = np.lexsort((doc, segment))
                starts, ends, _ = _groups(segment[order])
                pick, last = order[starts], order[ends - 1]
                at_anchor, h = words.grams(anchor)
                full = np.full(len(words.hashes), np.uint64(2**64 - 1))
                full[at_anchor] = h
                key = _least(full, window - anchor + 1)[1][at[pick]]
                data, begin, end = words.data.tobytes(), words.starts[at[pick]].tolist(), words.ends[at[pick] + n[pick] - 1].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(segment[pick])), pa.array(doc[pick]), pa.array(doc[last]),
                     pa.array([data[b:e] for b, e in zip(begin, end)], pa.binary())], names=["anchor", "segment", "low", "high", "words"])

    schema = "anchor long, segment long, low long, high long, words binary" if with_text else "segment long, doc_id long, place long"
    return marked.mapInArrow(run, schema)


def _searched(shards: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(segment, lows): per window of a segment the smallest document that holds it, if a document with the segment is larger."""
    def answer(segments, lows, highs, texts):
        words = next(chunks(pa.array(texts, pa.binary()).cast(pa.string()), chunk=1 << 40))[2]
        lows, highs = np.array(lows), np.array(highs)
        index = Index(words.hashes, words.first, lows, window)
        at, _ = words.grams(window)
        least = index.least(*index.matches(words.hashes, at, window))
        count = np.diff(words.first) - window + 1
        ends = np.cumsum(count)
        useful = np.minimum.reduceat(least, ends - count) < highs
        keep = np.repeat(useful, count)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(segments)[useful]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[useful])]).astype(np.int32)),
                                                                            pa.array(least[keep]))], names=["segment", "lows"])

    def run(batches):
        segments, lows, highs, texts, held, last = [], [], [], [], 0, None
        for batch in batches:
            for key, segment, low, high, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held > shard_words * 6 and key != last:
                    yield answer(segments, lows, highs, texts)
                    segments, lows, highs, texts, held = [], [], [], [], 0
                if key == last and segments and segments[-1] == segment:  # rows come sorted: the first has the smallest document
                    highs[-1] = max(highs[-1], high)
                    continue
                segments.append(segment)
                lows.append(low)
                highs.append(high)
                texts.append(text)
                held, last = held + len(text), key
        if segments:
            yield answer(segments, lows, highs, texts)

    return shards.mapInArrow(run, "segment long, lows array<long>")


def deduplicated(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans.

    A word goes if a window covers it that also starts in a document with a smaller doc_id; ``spans`` are the runs of
    removed words as (start, stop). Null, empty and short texts lose nothing (a null text has no words). A row with a
    null doc_id neither loses words nor counts as earlier. Rows of one doc_id are judged against smaller ids only, so they
    do not remove each other's words; rows that repeat id and text repeat the result. Other columns are not read. An
    empty table gives an empty result. Texts of any length are used whole.
    """
    if window - anchor + 1 >= 1 << _COUNT_BITS:
        raise ValueError("window and anchor are too far apart")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = texts.where("doc_id is not null and text is not null")
    with Scratch(spark) as scratch:
        places = scratch.kept(_candidates(usable, window, anchor), "places")
        tasks = max(1, -(-places.count() // TASK_SEGMENTS))
        # Places of one text: at most one per word.
        marked = usable.join(places.groupBy("doc_id").agg(F.collect_list("place").alias("places")).hint("merge"), "doc_id").select("doc_id", "text", "places")
        shards = _segments(marked, window, anchor, True).repartition(tasks, "anchor").sortWithinPartitions("anchor", "segment", "low")
        lows = _searched(shards, window, shard_words)
        hits = _segments(marked, window, anchor, False).join(lows, "segment")

        def mask(batches):
            for batch in batches:
                doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                offsets = batch.column(2).offsets.to_numpy()
                owner = np.repeat(np.arange(len(doc)), np.diff(offsets))
                bit = np.arange(len(owner)) - (offsets[:-1] - offsets[0])[owner]
                early = batch.column(2).flatten().to_numpy(zero_copy_only=False) < doc[owner]
                bits = np.bincount(owner, weights=np.where(early, 1 << bit, 0), minlength=len(doc)).astype(np.int64)
                yield _batch(["doc_id", "place", "bits"], [doc, place, bits], np.flatnonzero(bits))

        removed = hits.select("doc_id", "place", "lows").mapInArrow(mask, "doc_id long, place long, bits long")
        removed = scratch.kept(removed, "removed")
        per_doc = removed.groupBy("doc_id").agg(F.collect_list(F.struct("place", "bits")).alias("removed"))

        def cut(batches):
            for batch in batches:
                rows = ([], [], [], [])
                for data, removed in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    data = data or b""
                    parts, spans = data.split(), []  # bytes.split() parts at 0x20 and 0x09-0x0D only
                    if removed:
                        check, _, first = _unpacked(np.array([r["place"] for r in removed], dtype=np.int64))
                        bits = np.array([r["bits"] for r in removed], dtype=np.int64)
                        own = check == zlib.crc32(data)
                        begin = np.concatenate([(first[own] + i)[(bits[own] >> i) & 1 == 1] for i in range(1 << _COUNT_BITS)])
                        step = np.zeros(len(parts) + 1, dtype=np.int64)
                        np.add.at(step, begin, 1)
                        np.add.at(step, begin + window, -1)
                        gone = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
                        edges = np.flatnonzero(gone[1:] != gone[:-1])
                        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                        kept, at = [], 0
                        for start, stop in spans:
                            kept += parts[at:start]
                            at = stop
                        kept += parts[at:]
                    else:
                        kept = parts
                    for out, value in zip(rows, (len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(),
                                                 [{"start": a, "stop": b} for a, b in spans])):
                        out.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r, k) for r, k in zip(rows, kinds)]],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

        result = texts.join(per_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "removed").mapInArrow(
            cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, stop: long>>")
        return scratch.result(result, "substring")
