"""Words, encoding, the full-text index and languages against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from gridsift.llm import bpe, langid, words
from gridsift.llm.fm import Index

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'re", "é", "漢字", "1", "23", "!!", "....", "=", "the", " the", "ing", "\t", "🙂", "X", "zz", "\x1c", "\u00a0"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def joined(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoding_equals_merging(vocabulary, reference):
    rng = random.Random(1)
    for text in [joined(rng, 40) for _ in range(1500)] + ["", "=" * 5000, " " * 3000 + "x", "ab" * 2000]:
        assert ids(vocabulary.encode(text)) == reference.encode_ordinary(text)
        assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


def test_neighbouring_tokens(vocabulary):
    rng, every = random.Random(2), list(vocabulary.ranks.values())
    for _ in range(5000):
        a, b = rng.choice(every), rng.choice(every)
        assert vocabulary.follows(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b])


def test_appends_and_edits(vocabulary):
    rng = random.Random(3)
    for _ in range(400):
        text, whole = bpe.EncodedText(vocabulary, joined(rng, 30)), bpe.Prefixes(vocabulary, joined(rng, 20).encode())
        for _ in range(3):
            low = rng.randint(0, len(text.text))
            text.edit(low, rng.randint(low, min(len(text.text), low + 4)), joined(rng, 4))
            text.append(joined(rng, 3))
            assert text.ids() == vocabulary.encode(text.text)
            low = rng.randint(0, len(whole.data))
            whole.edit(low, rng.randint(low, len(whole.data)), joined(rng, 4).encode())
            assert whole.last == bpe.Prefixes(vocabulary, whole.data).last


def test_encoded_rows(spark, reference):
    rows = [(1, "the cat's 12 things", "x"), (None, "é", "y"), (2, None, "z"), (2, None, "z"), (3, "", None), (4, "word " * 20000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a column named like a result
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert got == {(i, len(k), sha(np.array(k, "<u4").tobytes()), sha(t)) for i, k, t in want}
    assert bpe.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_words_and_grams():
    rng = random.Random(4)
    texts = [None, "", " ", "".join(rng.choice("aB é\t\n\x0b\x1c") for _ in range(300)), "one", "x " * 500]
    seen = {}
    for low, high, found in words.chunks(pa.array(texts), chunk=64):
        for i in range(low, high):
            want = re.findall(rb"[^\x20\x09-\x0D]+", (texts[i] or "").encode())
            at = range(*found.first[i - low:i - low + 2])
            assert [found.data[found.starts[k]:found.ends[k]].tobytes() for k in at] == want
            for k, word in zip(at, want):
                assert seen.setdefault(word, found.hashes[k]) == found.hashes[k]
        starts, hashes = found.grams(3)
        assert (words.run_hashes(found.hashes, starts, np.full(len(starts), 3)) == hashes).all()
    assert len(set(seen.values())) == len(seen)


def test_index_finds_all_places():
    rng = np.random.default_rng(5)
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, rng.integers(1, 6)))])
        text = rng.integers(0, rng.integers(1, 6), first[-1]).astype(np.uint64) * np.uint64(7919)
        values, depth = rng.integers(0, 100, len(first) - 1), int(rng.integers(1, 8))
        if not len(text):
            continue
        index, query = Index(text, first, values, depth), rng.integers(0, 6, 100).astype(np.uint64) * np.uint64(7919)
        at = np.flatnonzero(rng.random(100 - depth) < 0.8)
        for search in (index.search, index.matches):
            low, high = search(query, at, depth)
            for i, a, b in zip(at, low, high):
                want = [values[s] for s in range(len(values)) for j in range(first[s], first[s + 1] - depth + 1) if (text[j:j + depth] == query[i:i + depth]).all()]
                assert b - a == len(want)
                assert not want or index.least(np.array([a]), np.array([b]))[0] == min(want)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    asked = [r for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(asked) > 200 and sum(got[r.doc_id].lang_pred == r.lang for r in asked) >= 0.97 * len(asked)
    one = {r.lang: r.text for r in docs.select("lang", "text").where("length(text) > 2000").collect()}
    rows = [(1, one["en"][:1500] + one["fr"][:1000], None), (2, None, "fr"), (3, "12 !!", "en"), (None, one["de"], "de"), (4, "", None), (4, "", None)]
    extra = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score"), train=docs).collect()
    by = {r.doc_id: r for r in extra}
    assert set(by[1].languages) >= {"en", "fr"} and by[1].lang_pred == "en" and 0.4 < by[1].score < 0.8
    assert by[None].lang_pred == "de" and not by[None].rejected
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (2, 3, 4)) and len(extra) == 6
    assert langid.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(docs.limit(3), train=docs.limit(0)).collect()} == {"und"}
