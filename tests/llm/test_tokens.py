"""Alignment of tokenizers and packing of their ids against plain Python."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridsift.llm import alignment, packing

A, B, W = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = ["a", "B", "é", "é", "́", " ", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "'s", "'", "İ", "漢", "1", "23", "!!", ".", "<|endoftext|>", "<s>", "\x00",
         "🙂", "ß", "ﬁ", "​", "᠎", "nǅ", "the", " the", "　", "......", "word. ", "Ελλάς"]
TEXTS = [None, "", " ", "   ", "▁", "a ▁ b", "the cat", "the cat", "Straße 🙂🙂 漢字", "\n\n x", "<|endoftext|> </s>", "=" * 700, "x" * 3000, "🙂" * 300, "ab cd " * 900]


def joined(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


@pytest.fixture(scope="module")
def both():
    return alignment.Both(A, B)


def tokens(both, text):
    """(ids, end offsets) of both sides, nothing if a side does not give the text back."""
    if not text:
        return ([], []), ([], [])
    a = Tokenizer.from_file(A) if not hasattr(tokens, "a") else tokens.a
    a.encode_special_tokens = True
    tokens.a = a
    b = sentencepiece.SentencePieceProcessor(model_file=B) if not hasattr(tokens, "b") else tokens.b
    tokens.b = b
    found = []
    for ids, side in ((a.encode(" " + text, add_special_tokens=False).ids, both.a), (b.encode(text), both.b)):
        if b"".join(side.tokens[i] for i in ids) != (" " + text).encode():
            return ([], []), ([], [])
        found.append((ids, np.cumsum([len(side.tokens[i]) for i in ids]).tolist()))
    return tuple(found)


def groups(both, text):
    (a, a_ends), (b, b_ends) = tokens(both, text)
    out, low_a, low_b = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        high_a, high_b = a_ends.index(end) + 1, b_ends.index(end) + 1
        out.append((a[low_a:high_a], b[low_b:high_b], end))
        low_a, low_b = high_a, high_b
    return out


def test_ids_of_parts_are_those_of_whole_texts(both):
    rng = random.Random(5)
    texts = [joined(rng, 12) for _ in range(3000)] + TEXTS
    for text, got in zip(texts, both.encode(texts)):
        (a, _), (b, _) = tokens(both, text)
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [a, b], repr(text)


def test_links_of_long_documents(both, monkeypatch):
    rng = random.Random(6)
    texts = [joined(rng, 60) for _ in range(40)] + TEXTS
    found = alignment.Aligned(both, both.encode(texts))
    want = collections.Counter()
    for d, text in enumerate(texts):
        for a, b, _ in groups(both, text):
            want.update((d, (x << alignment.B_BITS) + y) for x in a for y in b)
    for limit in (1 << 22, 200, 3):
        monkeypatch.setattr(alignment, "SLICE_LINKS", limit)
        got = [(d, p, t) for block in found.pairs(0, len(texts)) for d, p, t in zip(*[x.tolist() for x in block])]
        assert len(got) == len({x[:2] for x in got})
        assert {(d, p): t for d, p, t in got} == want


def test_alignment_of_documents(spark, both):
    rng = random.Random(7)
    texts = [joined(rng, 40) for _ in range(150)] + TEXTS
    rows = [(i if i % 9 else None, t, "x", 1.0, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head string, n_a double, row int").repartition(3)
    made = [groups(both, t) for t in texts]
    links = [collections.Counter((x, y) for a, b, _ in g for x in a for y in b) for g in made]
    count = collections.Counter(p for n in links for p in n)
    highest = collections.defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    want = []
    for (doc_id, *_), g, n in zip(rows, made, links):
        wording = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g)
        want.append((doc_id, sum(len(a) for a, _, _ in g), sum(len(b) for _, b, _ in g), len(g), sum(n.values()), sum(t for p, t in n.items() if count[p] == highest[p[0]]),
                     sum(t * count[p] for p, t in n.items()), hashlib.sha256(wording.encode()).hexdigest() if g else ""))
    for head in (alignment.HEAD, 50, 0):
        got = alignment.scored(docs, A, B, head=head).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), head
    spans = {repr(r.groups_sha256): r for r in alignment.aligned(docs, A, B).collect()}
    for g in made:
        if g:
            wording = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g)
            row = spans[repr(hashlib.sha256(wording.encode()).hexdigest())]
            assert row.ends == [e for *_, e in g] and row.a_ids == [x for a, _, _ in g for x in a] and row.b_ids == [x for _, b, _ in g for x in b]
            assert np.diff(row.a_upto, prepend=0).tolist() == [len(a) for a, _, _ in g] and np.diff(row.b_upto, prepend=0).tolist() == [len(b) for _, b, _ in g]


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(docs, A, B).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.scored(empty, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_ids_of_words(both):
    rng, coder, plain = random.Random(8), packing.WordEncoder(W), Tokenizer.from_file(W)
    texts = [joined(rng, 12) for _ in range(4000)] + [t for t in TEXTS if t]
    for low in range(0, len(texts), 50):
        for text, ids in zip(texts[low:low + 50], coder.encode(texts[low:low + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room = capacity
            else:
                rooms.remove(room)
            rooms.append(room - length)
    return len(rooms)


def test_plan_is_best_fit():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([1, 5, 10, 16, 40])
        histogram = {n: rng.choice([1, 2, 3, 7, 50]) for n in range(1, capacity + 1) if rng.random() < 0.6}
        slots, number = packing.planned(histogram, capacity)
        assert number == best_fit(histogram, capacity)
        used = collections.defaultdict(list)
        for length, count in histogram.items():
            own = slots[slots[:, 0] == length]
            for rank in range(count):
                _, low, first, per, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                used[first + (rank - low) // per].append((offset + (rank - low) % per * length, length))
        assert len(used) == number
        for placed in used.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity


def test_plan_does_not_grow_with_counts():
    plans = [packing.planned({n: int(scale * np.exp(-n / 800)) + 1 for n in range(1, 4097)}, 4096) for scale in (1e3, 1e6, 1e9)]
    assert max(len(slots) for slots, _ in plans) < 20_000


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing_of_documents(spark, capacity):
    rng, plain = random.Random(10), Tokenizer.from_file(W)
    texts = [joined(rng, 40) for _ in range(120)] + TEXTS + [None] * 60 + ["word " * 9000]
    rows = [(i if i % 11 else None, t, "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task string, place int").repartition(4)
    got = packing.packed(docs, W, capacity=capacity, with_ids=True).collect()
    want, histogram = [], collections.Counter()
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], dtype="<u4")
            want.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part.tolist()))
            histogram[len(part)] += 1
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)) for r in got) == sorted(map(repr, want))
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for placed in places.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == best_fit(histogram, capacity)


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), W).count() == 0
    assert packing.packed(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), W).select("length", "sequence_id").distinct().count() == 1


def test_frequent_words_are_not_encoded_again(monkeypatch):
    """What is met all the time stays known however many new words come, and words that hold the mark have their own ids."""
    monkeypatch.setattr(packing, "WORDS", 64)
    encoder, plain, asked = packing.WordEncoder(W), Tokenizer.from_file(W), []
    learn = encoder._coded
    monkeypatch.setattr(encoder, "_coded", lambda words: asked.extend(words) or learn(words))
    for k in range(30):
        text = "always there | a|b ｜ x " + " ".join(f"new{k}x{i}" for i in range(20))
        assert encoder.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert asked.count(b"always") == asked.count(b"there") == 1


def test_frequent_parts_are_not_encoded_again(both, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 128)
    asked, ids = [], both.b.ids
    monkeypatch.setattr(both.b, "ids", lambda texts: asked.extend(texts) or ids(texts))
    for k in range(30):
        text = "alwaysthere with  two\n spaces ▁ é " + " ".join(f"new{k}x{i}" for i in range(20))
        a, b = both.encode([text])[0]
        (a_ids, _), (b_ids, _) = tokens(both, text)
        assert np.frombuffer(a, "<i4").tolist() == list(a_ids) and np.frombuffer(b, "<i4").tolist() == list(b_ids)
    assert asked.count(" alwaysthere") == 1
