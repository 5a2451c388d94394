"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of its encoding. ``Prefixes`` stores that token
per prefix: appending bytes only adds entries, and an edit only recomputes entries behind it. A token is the last one
of a prefix when it is a suffix of it and encodes together with the last token before it to just these two tokens.
Texts are first cut by the tokenizer's pattern; the pieces are encoded separately, as the usual libraries do.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Remembered pieces and token pairs of one worker. When as many are new, those not met since the last time are forgotten.
CACHE_ENTRIES = 1 << 18


class Vocabulary:
    """Ranks of a byte-level BPE: bytes -> id, where lower ids merge first. A longer token is made of two shorter ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks), default=0)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(token) for token in self.tokens]
        #: Finds all tokens that end at a byte, longest first; bytes stand for the characters of the same number.
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), rank)
        self.suffixes.make_automaton()
        self._parts: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Ids by repeated merging of the lowest pair, of those ``below`` an id if given; only for short strings."""
        none = len(self.tokens)
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= (none if below is None else below):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from last; None for a single byte."""
        if self.lengths[token] == 1:
            return None
        found = self._parts.get(token)
        if found is None:
            found = self._parts[token] = tuple(self.merged(self.tokens[token], token))
        return found

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand directly behind ``last``.

        Merges of both are undone at their common border, the later one first. They do not follow each other if some
        two neighbours met there would have merged before the merge that was undone.
        """
        found = self._pairs.get(last << 32 | token)
        if found is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            found = self._pairs[last << 32 | token] = self._border(last, token)
        return found

    def _border(self, left: int, right: int) -> bool:
        none = len(self.tokens)
        before = none  # ids below it merge before what has been undone so far
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], none) < before:
                return False
            of_left, of_right = self.parts(left), self.parts(right)
            if of_left is None and of_right is None:
                return True
            # Of two equal merges the one further left comes first, so the right one is undone first.
            if of_right is None or of_left is not None and left > right:
                before, left = left, of_left[1]
            else:
                before, right = right + 1, of_right[0]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        ids = self._older.get(piece)
        if ids is None:
            data = piece.encode()
            rank = self.ranks.get(data)
            ids = np.array([rank] if rank is not None else Prefixes(self, data).ids(), dtype="<u4").tobytes()
        if len(piece) <= 256:
            if len(self._pieces) >= CACHE_ENTRIES:
                self._older, self._pieces = self._pieces, {}
            self._pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, piece = self._pieces, self.piece
        # A generation that is put aside meanwhile still answers rightly.
        return b"".join([known.get(p) or piece(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Prefixes:
    """Encodings of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Lengthen the string; entries of the old prefixes stay as they are."""
        done = len(self.data)
        self.data += more
        last, lengths, follows = self.last, self.vocabulary.lengths, self.vocabulary.follows
        known = self.vocabulary._pairs
        low = max(0, done + 1 - self.vocabulary.longest)
        end = done
        for at, token in self.vocabulary.suffixes.iter(self.data[low:].decode("latin-1")):
            if low + at < end:
                continue
            if low + at > end:
                raise ValueError("the vocabulary lacks a byte")
            start = end + 1 - lengths[token]
            if start:
                found = known.get(last[start - 1] << 32 | token)
                if not (follows(last[start - 1], token) if found is None else found):
                    continue
            last.append(token)
            end += 1
        if end < len(self.data):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]. Entries before ``start`` stay; behind the edit, entries are taken over as soon as all
        those that a later one can look at agree with the old ones."""
        old, shift = self.last, len(new) - (stop - start)
        tail = self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        same, reach = 0, self.vocabulary.longest
        for i in range(len(tail)):
            self.append(tail[i:i + 1])
            was = old[stop + i]
            # An entry depends on at most ``reach`` bytes before it, all of them unchanged from here on.
            same = same + 1 if self.last[-1] == was and len(self.vocabulary.tokens[was]) <= i + 1 else 0
            if same >= reach:
                self.data += tail[i + 1:]
                self.last += old[stop + i + 1:]
                break
        assert len(self.last) == len(self.data) == len(old) + shift

    def ids(self, length: int | None = None) -> list[int]:
        """Encoding of the whole string, or of its first ``length`` bytes."""
        end, out = len(self.data) if length is None else length, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class EncodedText:
    """A text with its pieces and ids, kept right under appends and edits without encoding all of it again.

    The pattern looks at most two characters beyond a piece, and never back: pieces that end two characters before a
    change stay, and behind it cutting stops where it meets an old cut.
    """

    LOOK_AHEAD = 2

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.bounds: list[tuple[int, int]] = []
        self.pieces: list[bytes] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        keep = sum(1 for _ in self._stable(start))
        head, head_ids = self.bounds[:keep], self.pieces[:keep]
        old = {low + shift: i for i, (low, _) in enumerate(self.bounds) if low >= stop}
        at = head[-1][1] if head else 0
        for match in self.vocabulary.pattern.finditer(self.text, at):
            i = old.get(match.start()) if match.start() >= start + len(new) else None
            if i is not None:
                head += [(low + shift, high + shift) for low, high in self.bounds[i:]]
                head_ids += self.pieces[i:]
                break
            head.append(match.span())
            head_ids.append(self.vocabulary.piece(match.group()))
        self.bounds, self.pieces = head, head_ids

    def _stable(self, start: int) -> Iterator[int]:
        for i, (_, high) in enumerate(self.bounds):
            if high + self.LOOK_AHEAD > start:
                return
            yield i

    def ids(self) -> bytes:
        return b"".join(self.pieces)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token, rank) once per worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256, optionally the ids themselves.

    A null text counts as empty and gives 0 tokens; a null key stays null; repeated rows give repeated results; other
    columns are not read, whatever their names; an empty table gives an empty result. Texts of any length are encoded
    whole, in time linear in their length. ``path`` must be readable by every worker. One narrow stage, no shuffle.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                coded = [bpe.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()),
                           pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                           pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<i4") for c in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(columns)])

    return docs.select(key, text).mapInArrow(run, schema)
