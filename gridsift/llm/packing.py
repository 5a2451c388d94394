"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. Best fit in falling length is run over counts: sequences
that are filled alike are one entry of the plan, so its size depends on ``capacity`` only, not on the documents. A piece
then takes the slot that the plan holds for its rank within its length. Texts are read once and never shuffled; what
is joined are a rank's two parts, the place within the writing task and the pieces of that length in earlier tasks.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridsift.session import Scratch

#: Ids of so many words are remembered by a worker, none longer than LONG bytes; when as many are new, those not met since the last
#: time are forgotten. It bounds memory and changes no result.
WORDS, LONG = 1 << 19, 64
#: New words that are encoded as one text.
RUN = 1 << 10
_LETTER, _MARK, _SPACE = (np.isin(np.arange(256), list(some)) for some in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,;:!?", b" \t\n\r\x0b\x0c"))


def _parted(data: bytes) -> bytes:
    """A space before each lone mark between an ASCII letter and white space, which is a word of its own."""
    byte = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(_MARK[byte[1:-1]] & _LETTER[byte[:-2]] & _SPACE[byte[2:]]) + 1 if len(byte) > 2 else []
    return np.insert(byte, at, 32).tobytes() if len(at) else data

#: Characters of text handled at once; a longer text is handled alone.
SLICE = 1 << 20


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer never joins what white space divides."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        # Text that is lower-cased anyway has fewer different words if that is done before.
        self.lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        #: A word of its own that has one id, with white space about it.
        marks = ((f" {c} ", self.tokenizer.encode(c, add_special_tokens=False).ids) for c in "|~^`\\}{")
        unknown = self.tokenizer.encode("\U0010FFFD", add_special_tokens=False).ids
        self.mark = next(((c, ids[0]) for c, ids in marks if len(ids) == 1 and ids[0] not in unknown), None)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        if len(self.known) + len(words) > WORDS:
            self.known, self.older = {}, self.known
        older = self.older
        found = {w: older[w] for w in words if w in older}
        new = [w for w in words if w not in found] if found else words
        for low in range(0, len(new), RUN):
            found.update(self._coded(new[low:low + RUN]))
        self.known.update(found if max(map(len, words), default=0) <= LONG else {w: ids for w, ids in found.items() if len(w) <= LONG})
        return found

    def _coded(self, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        """(word, ids): the words as one text with a mark between them, as white space divides them; each alone if one holds the mark itself."""
        if self.mark is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join([w.decode() for w in words])], add_special_tokens=False)[0].ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark[1])
            if len(marks) == len(words) - 1:
                data, ends = ids.tobytes(), (4 * marks).tolist()
                return zip(words, [data[low:high] for low, high in zip([0, *[end + 4 for end in ends]], [*ends, len(data)])])
        made = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return zip(words, [array.array("I", e.ids).tobytes() for e in made])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; words that are new are encoded together."""
        split = []
        for text in texts:
            data = text.encode()
            if self.lowers:
                low = data.lower()  # A-Z alone; the rest is left to the tokenizer
                if not any(t in low for t in self.added):
                    data = low
            split.append(_parted(data).split())  # only ASCII white space; the rest is left to the tokenizer
        every: set[bytes] = set()
        for words in split:
            every.update(words)
        known = self.known
        coded = {w: known[w] for w in every if w in known}
        if len(coded) < len(every):
            coded.update(self._learn([w for w in every if w not in coded]))
        return [b"".join(map(coded.__getitem__, words)) for words in split]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of parts of a column, nulls as empty texts."""
    low, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= SLICE:
            yield low, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, held


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has the cores that Spark gives it
    return WordEncoder(path)


_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, *, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], task, place) of all documents; ``place`` counts equal lengths of a task."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {_PIECE}{', ids array<int>' if with_ids else ''}, task int, place long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        places = np.zeros(capacity + 1, dtype=np.int64)

        def table(batch, rows):
            texts, number, start, length, crc, ids = zip(*rows)
            length = np.array(length, dtype=np.int64)
            place = np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            counts = np.diff(np.concatenate([first, [len(ordered)]]))
            place[order] = np.arange(len(ordered)) - np.repeat(first, counts) + places[ordered]
            places[ordered[first]] += counts
            columns = {"doc_id": batch.column(0).take(pa.array(texts)), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()),
                       "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(i, dtype="<i4") for i in ids], pa.list_(pa.int32()))
            columns |= {"task": pa.array(np.full(len(length), task, dtype=np.int32)), "place": pa.array(place)}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for low, texts in slices(batch.column(1)):
                rows = []
                for i, coded in enumerate(encoder.encode(texts), low):
                    ids = memoryview(coded + end)
                    for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start:start + 4 * capacity]
                        rows.append((i, number, start // 4, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None))
                yield table(batch, rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def planned(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over counts of lengths: (slots, number of sequences).

    A row of ``slots`` is (length, first rank, first sequence, pieces per sequence, offset): rank r of that length goes to
    sequence ``first sequence + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``. Rows are sorted
    by length and rank. Sequences with one filling lie side by side, so an entry (first, number) stands for all of them.
    A length finds the least sufficient room, which stays the least one until it is too small: each such sequence
    takes as many pieces as fit. An entry is parted at most twice for each length, hence their number is bounded.
    """
    rooms: list[int] = []  # heap of rooms that some entry has, and the entries of each room
    entries: dict[int, list[tuple[int, int]]] = {}
    slots, made = [], 0

    def put(room: int, first: int, number: int) -> None:
        if not room or not number:
            return
        if room not in entries:
            entries[room] = []
        entries[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        rooms = [room for room in entries if room >= length]
        heapq.heapify(rooms)
        while left:
            if rooms:
                room = heapq.heappop(rooms)
            else:
                per = capacity // length
                room, number = capacity, -(-left // per)
                put(room, made, number)
                made += number
            for first, number in entries.pop(room):
                if not left:
                    put(room, first, number)
                    continue
                per = room // length
                full = min(number, left // per)
                if full:
                    slots.append((length, rank, first, per, capacity - room))
                    put(room - per * length, first, full)
                    rank, left = rank + full * per, left - full * per
                if full < number and left:  # fewer than ``per``
                    slots.append((length, rank, first + full, per, capacity - room))
                    put(room - left * length, first + full, 1)
                    put(room, first + full + 1, number - full - 1)
                    rank, left = rank + left, 0
                elif full < number:
                    put(room, first + full, number - full)
    slots.sort()
    return np.array(slots, dtype=np.int64).reshape(-1, 5), made


def packed(docs: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A text's ids are those of the ``tokenizers`` file at ``path``, without special tokens added, and ``end_id`` behind them; a null
    text is empty and gives ``end_id`` alone. Ids beyond ``capacity`` go to further pieces. Pieces of one sequence lie side by
    side from offset 0; none is dropped, cut again or shared. Null and repeated ids are kept, each row of ``docs`` is packed; other
    columns are not read. An empty table gives an empty result. Which of equally long pieces takes which slot follows the
    order of the input's partitions. What the driver plans on are ``capacity`` counts at most, and the plan sent to all tasks
    is bounded by ``capacity`` too (measured: under 20,000 rows of 40 bytes at 4,096).
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        cut = scratch.kept(pieces(docs, path, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
        counts = scratch.kept(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
        earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
        before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
        plan = spark.sparkContext.broadcast(planned(histogram, capacity)[0])
        ranked = cut.join(before, ["length", "task"]).select("*", (F.col("before") + F.col("place")).alias("rank"))
        columns = [c for c in cut.columns if c not in ("task", "place")]

        def slotted(batches):
            slots = plan.value
            keys = (slots[:, 0] << 48) + slots[:, 1]
            for batch in batches:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                _, low, first, per, offset = slots[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(first + (rank - low) // per), pa.array(offset + (rank - low) % per * length)],
                                                 names=[*columns, "sequence_id", "offset"])

        kinds = dict(cut.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
        order = [c for c in columns if c != "ids"] + ["sequence_id", "offset"] + (["ids"] if with_ids else [])
        return scratch.result(ranked.select(*columns, "rank").mapInArrow(slotted, schema).select(*order), "packed")
