"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import numpy as np

from gridsift.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """All rows (item place, item_id, rank, doc_id, score)."""
    words = [(doc_id, collections.Counter(split(text))) for doc_id, text in docs]
    n_docs, n_all = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = collections.Counter(t for _, w in words for t in w)
    out = []
    for place, (item_id, text) in enumerate(items):
        scores = []
        for doc_id, held in words:
            n = sum(held.values())
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 12 * (75 + 25 * n * n_docs // n_all)))
                        for t, q in collections.Counter(split(text)).items() if t in held)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", "-x", "É"]) for _ in range(n))


def test_search_equals_scoring_all(spark):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(60)] + ["The", "THE", "straße", "漢字", "a1"]
    docs = [(i, made(rng, rng.choice([0, 1, 5, 30, 200]), vocabulary)) for i in range(400)]
    docs += [(i + 400, docs[7][1]) for i in range(50)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (900, None), (901, "..."), (902, "w1 " * 20000)]
    items = [(i, made(rng, rng.choice([1, 3, 40]), vocabulary)) for i in range(30)] + [(3, docs[7][1]), (None, docs[9][1] + " w1"), (50, None), (51, ""), (52, "unknownterm"), (53, docs[7][1])]
    frame = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], "doc_id long, text string, n string, row int, score int").repartition(5)
    asked = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "item_id int, text string, row int, rank int").repartition(2)
    for k in (20, 1, 1000):
        got = search.searched(frame, asked, k=k).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ranked(docs, items, k))), k


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_item, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    for docs, items in ((none, item), (some, no_item), (none, no_item)):
        found = search.searched(docs, items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    # One document: its term weighs floor(1000 ln(4 / 3)).
    assert search.searched(some, item).head().score == 287 * (10**9 // (1000 + 12 * 100))


def test_bounds_stop_before_the_lists_end():
    rng = np.random.default_rng(2)
    n, terms = 20_000, 4
    of_doc, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    impact = (1000 / (1 + rng.pareto(0.3, n * terms))).astype(np.int64)
    impact[:terms * 30] = 999_999
    shard = search.Shard(terms, np.arange(n), np.zeros(n, dtype=bool), of_doc, term, impact)
    best = search.Best(20)
    shard.search(np.arange(terms), np.array([5, 3, 2, 1]), best)
    scores = np.bincount(of_doc, np.array([5, 3, 2, 1])[term] * impact)
    want = np.lexsort((np.arange(n), -scores))[:20]
    assert best.docs.tolist() == want.tolist() and best.scores.tolist() == scores[want].astype(int).tolist()
    assert shard.read < n * terms / 10  # places read by direct access


def test_shards_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, made(rng, 30, [f"w{j}" for j in range(40)])) for i in range(300)]
    items = [(i, made(rng, 6, [f"w{j}" for j in range(40)])) for i in range(25)]
    monkeypatch.setattr(search, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(search, "BLOCK_TERMS", 17)
    got = search.searched(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), shard_postings=500).collect()
    assert sorted(map(tuple, got)) == sorted(ranked(docs, items, 20))


def test_items_in_several_blocks(spark, monkeypatch):
    """Blocks are queries of their own: rows of one query taken bit by bit would need shuffle files that are removed by then."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self, *_, **__):
        raise AssertionError("rows taken bit by bit while shuffle files are removed")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(search, "BLOCK_TERMS", 6)
    rng = random.Random(2)
    docs = [(i, made(rng, 20, ["a", "b", "c", "d", "e", "f", "g", "h"])) for i in range(40)]
    items = [(i, " ".join(rng.sample("abcdefgh", n))) for i, n in enumerate([1, 1, 1, 1, 1, 8, 2, 3, 2, 8, 1])]
    found = search.searched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3), k=5)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, ranked(docs, items, 5)))
