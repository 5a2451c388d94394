"""Alignment of two tokenizers over the same texts.

Both encode a space and the text. Token starts are joined as of the other side's starts, keyed by document, in both
directions: the union of what a start finds covering it is the list of overlaps, in order of both sides. An overlap whose two
tokens end together closes a group. All pairs of a group are links, counted as (document, id pair, times).

Corpus counts are an aggregation over documents' distinct pairs. They come back to the documents in two ways that add up:
the most frequent pairs, a fixed number, are sent to all tasks; every other pair is joined, and none of those is hot.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsift.session import Scratch

#: Pairs sent to all tasks: 12 bytes each. All others are joined; the number changes no result.
HEAD = 1 << 19
#: Bytes of text and links handled at once; one document may exceed the first alone. They bound memory and change no result.
SLICE_BYTES, SLICE_LINKS = 1 << 20, 1 << 22
#: Pieces of text whose ids a worker remembers, none longer than LONG characters; when half as many are new, those not met since
#: the last time are forgotten.
KNOWN, LONG = 1 << 19, 64
#: New parts that are encoded as one text.
RUN = 1 << 10

#: A pair is (id of A) * 2^B_BITS + (id of B) in a signed 64-bit integer.
B_BITS = 31


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, all other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Side:
    """A tokenizer, the bytes of its tokens, and whether it can be run on parts that begin with a lone space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        width = max(len(str(len(tokens))), 1)
        self.digits = np.array([str(i).ljust(width).encode() for i in range(len(tokens))]).view(np.uint8).reshape(-1, width)
        self.widths = np.array([len(str(i)) for i in range(len(tokens))])


class ByteLevel(_Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        letters = _bytes_of_letters()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name in names])
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.parts = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(_Side):
    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = self.processor.id_to_piece(list(range(self.processor.vocab_size())))
        super().__init__([bytes([int(n[3:5], 16)]) if self.processor.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.parts = not any("▁" in n.lstrip("▁") for n in names)  # no piece goes over a space inside it

    def ids(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with the space that the model itself puts there."""
        return self.processor.encode([t[1:] for t in texts], num_threads=1)


#: Neither side joins what such a place divides: the byte-level pattern takes a space with what follows it, and pieces
#: hold spaces at their start alone.
_PARTS = re.compile(r"(?<=[^ ])(?= \S)")
#: Without such a place, the parts are what spaces divide.
_WIDE = re.compile(r" (?:\s|\Z)")


def _cut(text: str) -> list[str]:
    """Parts of a text that begins with a space, each without the space that it begins with."""
    return [part[1:] for part in _PARTS.split(text)] if _WIDE.search(text) else text.split(" ")[1:]


class Both:
    """Ids of texts by both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        if 2 * (len(self.known) + len(parts)) > KNOWN:
            self.known, self.older = {}, self.known
        older = self.older
        found = {part: older[part] for part in parts if part in older}
        new = [part for part in parts if part not in found] if found else parts
        # A part that begins and ends within a word stays a part of any text that it is put into.
        plain = [part for part in new if part and not part[0].isspace() and not part[-1].isspace()] if self.a.parts and self.b.parts else []
        for low in range(0, len(plain), RUN):
            found.update(self._together(plain[low:low + RUN]))
        alone = [part for part in new if part not in found]
        found.update(self._alone(alone))
        self.known.update((part, ids) for part, ids in found.items() if len(part) < LONG)
        return found

    def _together(self, parts: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Parts encoded one behind the other and cut where their bytes end; none if a side does not give back all of them."""
        text = " " + " ".join(parts)
        data = text.encode()
        ends = np.cumsum([len(part) + 1 for part in (parts if len(data) == len(text) else map(str.encode, parts))])
        cut = []
        # The model of B takes long texts more slowly than their parts.
        for side, texts in ((self.a, [text]), (self.b, [" " + part for part in parts])):
            ids = np.fromiter(itertools.chain.from_iterable(side.ids(texts)), dtype="<i4")
            upto = np.cumsum(side.lengths[ids])
            at = np.searchsorted(upto, ends)
            if not len(ids) or upto[-1] != len(data) or (upto[at] != ends).any() or b"".join(map(side.tokens.__getitem__, ids.tolist())) != data:
                return {}
            buffer, places = ids.tobytes(), (4 * (at + 1)).tolist()
            cut.append([buffer[low:high] for low, high in zip([0, *places], places)])
        return {part: (a, b, True) for part, a, b in zip(parts, *cut)}

    def _alone(self, parts: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        found, spaced = {}, [" " + part for part in parts]
        for part, text, a, b in zip(parts, spaced, self.a.ids(spaced), self.b.ids(spaced)):
            data = text.encode()
            same = b"".join([self.a.tokens[i] for i in a]) == data and b"".join([self.b.tokens[i] for i in b]) == data
            found[part] = array.array("i", a).tobytes(), array.array("i", b).tobytes(), same
        return found

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """32-bit ids of both sides for each text; none at all if a side does not give back the text. New parts are encoded together."""
        whole = [" " + text if text else "" for text in texts]
        split = [(_cut(text) if self.a.parts and self.b.parts else [text[1:]]) if text else [] for text in whole]
        every: set[str] = set()
        for parts in split:
            every.update(parts)
        known = self.known
        coded = {part: known[part] for part in every if part in known}
        if len(coded) < len(every):
            coded.update(self._learn([part for part in every if part not in coded]))
        return [self._joined(text, [coded[part] for part in parts]) if parts else (b"", b"") for text, parts in zip(whole, split)]

    def _joined(self, text: str, coded: list[tuple[bytes, bytes, bool]]) -> tuple[bytes, bytes]:
        a, b, same = zip(*coded)
        a, b = b"".join(a), b"".join(b)
        if not all(same):
            data = text.encode()
            if any(b"".join([side.tokens[i] for i in np.frombuffer(ids, "<i4").tolist()]) != data for side, ids in ((self.a, a), (self.b, b))):
                return b"", b""
        return a, b


@functools.lru_cache(maxsize=2)
def _both(a_path: str, b_path: str) -> Both:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has the cores that Spark gives it
    return Both(a_path, b_path)


class Aligned:
    """Groups of a few documents. Arrays run over all tokens of A, of B, or over all groups, in order."""

    def __init__(self, both: Both, coded: list[tuple[bytes, bytes]]):
        self.docs = len(coded)
        self.a_ids, self.a_doc, self.n_a = self._tokens([c[0] for c in coded])
        self.b_ids, self.b_doc, self.n_b = self._tokens([c[1] for c in coded])
        a_end, b_end = np.cumsum(both.a.lengths[self.a_ids]), np.cumsum(both.b.lengths[self.b_ids])
        a = pd.DataFrame({"doc": self.a_doc, "at": a_end - both.a.lengths[self.a_ids], "a": np.arange(len(a_end))})
        b = pd.DataFrame({"doc": self.b_doc, "at": b_end - both.b.lengths[self.b_ids], "b": np.arange(len(b_end))})
        # Documents follow each other on one scale of bytes, the same for both sides as their bytes are.
        over = np.concatenate([(x.a.to_numpy() << 32) + x.b.to_numpy() for x in (pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc"))])
        over.sort(kind="stable")  # two rising runs
        over = over[np.concatenate([[True], over[1:] != over[:-1]])] if len(over) else over
        i, j = over >> 32, over & 0xFFFFFFFF
        #: Overlaps, and those that close a group.
        self.overlaps, closing = (i, j), a_end[i] == b_end[j]
        self.group_doc = self.a_doc[i[closing]]
        self.group_end = a_end[i[closing]] - np.concatenate([[0], a_end])[np.searchsorted(self.a_doc, self.group_doc)]
        self.a_upto, self.b_upto = i[closing] + 1, j[closing] + 1
        self.a_size, self.b_size = np.diff(self.a_upto, prepend=0), np.diff(self.b_upto, prepend=0)
        self.a_group = np.repeat(np.arange(len(self.a_size)), self.a_size)
        self.b_group = np.repeat(np.arange(len(self.b_size)), self.b_size)
        self.n_groups = np.bincount(self.group_doc, minlength=self.docs)
        self.links = self.a_size * self.b_size
        self.n_links = self._per_doc(self.links, self.group_doc)

    @staticmethod
    def _tokens(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(c) // 4 for c in coded], dtype=np.int64)
        return np.frombuffer(b"".join(coded), "<i4").astype(np.int64), np.repeat(np.arange(len(coded)), n), n

    def _per_doc(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        bounds = np.searchsorted(doc, np.arange(self.docs + 1))
        return total[bounds[1:]] - total[bounds[:-1]]

    def wording(self, both: Both) -> list[str]:
        """SHA-256 of the groups as text, '' for a document without tokens."""
        last_a, last_b = np.zeros(len(self.a_ids), dtype=bool), np.zeros(len(self.b_ids), dtype=bool)
        last_a[self.a_upto - 1], last_b[self.b_upto - 1] = True, True
        place = np.concatenate([np.arange(len(self.a_ids)) + (self.b_upto - self.b_size)[self.a_group], np.arange(len(self.b_ids)) + self.a_upto[self.b_group]])
        width = both.a.digits.shape[1], both.b.digits.shape[1]
        cells = np.zeros((len(place), max(width) + 1), dtype=np.uint8)
        size = np.empty(len(place), dtype=np.int64)
        half = np.arange(len(place)) < len(self.a_ids)
        for side, ids, where, last, mark in ((both.a, self.a_ids, place[half], last_a, b"|"), (both.b, self.b_ids, place[~half], last_b, b";")):
            cells[where, :side.digits.shape[1]] = side.digits[ids]
            cells[where, side.widths[ids]] = np.where(last, mark[0], ord(","))
            size[where] = side.widths[ids] + 1
        text = cells[np.arange(cells.shape[1]) < size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(text[low:high - 1]).hexdigest() if high > low else "" for low, high in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def pairs(self, low: int, high: int):
        """Linked id pairs of documents low to high - 1: blocks (document, pair, times), a document's pairs in one block or more."""
        groups = slice(*np.searchsorted(self.group_doc, [low, high]))
        if self.links[groups].sum() <= SLICE_LINKS:
            tokens = slice(*np.searchsorted(self.a_doc, [low, high]))
            yield self._counted(self.a_doc[tokens], self.a_ids[tokens], self.a_group[tokens], np.ones(tokens.stop - tokens.start, dtype=np.int64), None)
        elif high - low > 1:
            middle = (low + high) // 2
            yield from self.pairs(low, middle)
            yield from self.pairs(middle, high)
        else:
            yield from self._long(groups)

    def _counted(self, doc, a_ids, group, times, b):
        """Distinct (document, pair) of entries of A with all of B in their group, and how often each is linked."""
        b_ids, b_times, first, size = b if b is not None else (self.b_ids, None, self.b_upto - self.b_size, self.b_size)
        n = size[group]
        each = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[group][each]
        pair = (a_ids[each] << B_BITS) + b_ids[at]
        weight = times[each] if b_times is None else times[each] * b_times[at]
        order = np.lexsort((pair, doc[each])) if len(doc) and doc[0] != doc[-1] else np.argsort(pair, kind="stable")
        doc, pair, weight = doc[each][order], pair[order], weight[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        return doc[start], pair[start], np.add.reduceat(weight, start) if len(start) else weight

    def _long(self, groups: slice):
        """One document with more links than fit at once: equal ids of a group are one entry, and ranges of A's ids one block each."""
        def merged(ids, group, upto, size):
            tokens = slice(int(upto[groups.start] - size[groups.start]), int(upto[groups.stop - 1]))
            codes, times = np.unique((group[tokens] << 32) + ids[tokens], return_counts=True)
            return codes >> 32, codes & 0xFFFFFFFF, times
        a_group, a_ids, a_times = merged(self.a_ids, self.a_group, self.a_upto, self.a_size)
        b_group, b_ids, b_times = merged(self.b_ids, self.b_group, self.b_upto, self.b_size)
        bounds = np.searchsorted(b_group, np.arange(len(self.a_size) + 1))
        order = np.argsort(a_ids, kind="stable")
        a_group, a_ids, a_times = a_group[order], a_ids[order], a_times[order]
        total = np.cumsum(np.diff(bounds)[a_group])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(a_ids)) + 1, [len(a_ids)]])  # a block holds whole ids
        low = 0
        while low < len(a_ids):
            limit = (total[low - 1] if low else 0) + SLICE_LINKS
            high = int(cut[np.searchsorted(cut, np.searchsorted(total, limit, side="right"), side="right") - 1])
            high = high if high > low else int(cut[np.searchsorted(cut, low, side="right")])
            doc = np.full(high - low, self.group_doc[groups.start])
            yield self._counted(doc, a_ids[low:high], a_group[low:high], a_times[low:high], (b_ids, b_times, bounds[:-1], np.diff(bounds)))
            low = high


_FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_GROUPS = "a_ids array<int>, b_ids array<int>, a_upto array<int>, b_upto array<int>, ends array<long>"


def _slices(batch):
    """(first row, texts) of parts of a batch with about SLICE_BYTES of text."""
    low, texts, held = 0, [], 0
    for i, text in enumerate(batch.column(1)):
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held >= SLICE_BYTES:
            yield low, texts
            low, texts, held = i + 1, [], 0
    if texts:
        yield low, texts


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the alignment itself.

    ``a_ids``, ``b_ids`` are the tokens of a space and the text, by the ``tokenizers`` file ``a_path`` (byte-level) and the
    ``sentencepiece`` model ``b_path``. Group g ends at byte ``ends[g]`` behind the space's start, after ``a_upto[g]`` tokens of A and
    ``b_upto[g]`` of B. A text that is null, empty or not given back by both sides has no tokens and an empty
    ``groups_sha256``. Null and repeated ids are kept; other columns are not read. One narrow stage; texts of any length are
    encoded whole.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        both = _both(a_path, b_path)
        for batch in batches:
            for low, texts in _slices(batch):
                found = Aligned(both, both.encode(texts))
                a0, b0, g0 = (np.concatenate([[0], np.cumsum(n)]) for n in (found.n_a, found.n_b, found.n_groups))
                groups = [_lists(found.a_ids, a0, pa.int32()), _lists(found.b_ids, b0, pa.int32()), _lists(found.a_upto - a0[found.group_doc], g0, pa.int32()),
                          _lists(found.b_upto - b0[found.group_doc], g0, pa.int32()), _lists(found.group_end, g0, pa.int64())]
                facts = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links, found.wording(both))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), *facts, *groups],
                                                 names=["doc_id", *[c.split()[0] for c in (_FACTS + ", " + _GROUPS).split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_FACTS}, {_GROUPS}")


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Links of the alignments: row, doc_id, ``head`` (the first row of a document, with its facts), pairs, times.

    ``row`` numbers the rows of ``docs``. ``pairs`` are a document's distinct linked id pairs, rising, and ``times`` how many token
    pairs each stands for. A document with very many of them has further rows with other pairs and no facts.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["row", "doc_id", "head", *[c.split()[0] for c in _FACTS.split(", ")], "pairs", "times"]

    def run(batches):
        both = _both(a_path, b_path)
        for batch in batches:
            texts_only = batch.select(["doc_id", "text"])
            for low, texts in _slices(texts_only):
                found = Aligned(both, both.encode(texts))
                sha, seen = found.wording(both), np.zeros(len(texts), dtype=bool)
                for doc, pair, times in found.pairs(0, len(texts)):
                    have, start = np.unique(doc, return_index=True)
                    own, bounds, first = have, np.concatenate([start, [len(doc)]]), ~seen[have]
                    seen[have] = True
                    rows = pa.array(low + own)
                    facts = [pa.array(x[own], pa.int64(), mask=~first) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                    facts.append(pa.array([sha[d] if f else None for d, f in zip(own, first)], pa.string()))
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(first), *facts,
                                                      _lists(pair, bounds, pa.int64()), _lists(times, bounds, pa.int64())], names=names)
                none = np.flatnonzero(~seen)
                if len(none):
                    rows, zeros = pa.array(low + none), pa.array(np.zeros(len(none), dtype=np.int64))
                    empty = _lists(none[:0], np.zeros(len(none) + 1), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(np.ones(len(none), dtype=bool)),
                                                      *[zeros] * 4, pa.array([""] * len(none)), empty, empty], names=names)

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"row long, doc_id {kind}, head boolean, {_FACTS}, pairs array<long>, times array<long>")


def counted(links: DataFrame) -> DataFrame:
    """(pair, n, best) over the rows of ``linked``: documents that hold a pair linked, and whether its A id has no higher count."""
    n = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.shiftright("pair", B_BITS))
    highest = n.groupBy("a").agg(F.max("n").alias("highest"))
    return n.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def scored(docs: DataFrame, a_path: str, b_path: str, *, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of documents that hold it linked; ``n_best`` are links whose count is the highest of
    their A id, ``count_sum`` adds up the counts of all links. Texts without tokens (see ``aligned``) have zeros and ''. Null and repeated
    ids are kept, each row is a document; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        links = scratch.kept(linked(docs, a_path, b_path), "links")
        counts = scratch.kept(counted(links), "pair-counts")
        # The ``head`` most frequent pairs, sorted by pair: a fixed number of rows of 17 bytes.
        top = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow().sort_by("pair")
        shared = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy()))
        facts = ["row", "doc_id", "head", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        kinds = dict(links.dtypes)

        def summed(batches):
            pair, n, best = shared.value
            for whole in batches:
                for low in range(0, whole.num_rows, 256):
                    batch = whole.slice(low, 256)
                    values, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                    bounds = np.concatenate([[0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())])
                    at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
                    known = pair[at] == values if len(pair) else np.zeros(len(values), dtype=bool)
                    upto = np.zeros((3, len(values) + 1), dtype=np.int64)
                    if len(pair):
                        np.cumsum(np.where(known, times * n[at], 0), out=upto[0, 1:])
                        np.cumsum(np.where(known & best[at], times, 0), out=upto[1, 1:])
                    np.cumsum(~known, out=upto[2, 1:])
                    total, good = (np.diff(upto[k][bounds]) for k in (0, 1))
                    rest = upto[2][bounds]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in facts], pa.array(good), pa.array(total), _lists(values[~known], rest, pa.int64()),
                                                      _lists(times[~known], rest, pa.int64())], names=[*facts, "n_best", "count_sum", "pairs", "times"])

        schema = ", ".join(f"{c} {kinds[c]}" for c in facts) + ", n_best long, count_sum long, pairs array<long>, times array<long>"
        part = scratch.kept(links.select(*facts, "pairs", "times").mapInArrow(summed, schema), "parts")
        rest = part.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        joined = rest.join(counts, "pair").select("row", (F.col("times") * F.col("n")).alias("more"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("better"))
        further = part.where("not head").select("row", F.col("count_sum").alias("more"), F.col("n_best").alias("better"))
        sums = joined.unionByName(further).groupBy("row").agg(F.sum("more").alias("more"), F.sum("better").alias("better"))
        whole = part.where("head").join(sums, "row", "left").select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("better", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
        return scratch.result(whole, "alignments")
