"""Similar texts, passages, lines, vectors and benchmark items against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from gridsift.llm import decontaminate, jaccard, linededup, neighbours, substring
from gridsift.llm.components import components
from gridsift.session import Scratch

DOCS = "doc_id long, text string, member string, n_words string"  # extra columns named like inner ones


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words_of((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed):
    """Near copies of some texts by small edits, copies, a passage that many share, short, empty and null texts."""
    rng = random.Random(seed)
    make = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(n)]
    passage, rows = make(60), []
    for size in (7, 12, 30, 60, 150, 400):
        base = make(size)
        for _ in range(9):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(len(text))] = "new" + str(rng.randint(0, 99))
            rows.append(" ".join(text) if rng.random() < 0.7 else "  ".join(text).upper())
    rows += [" ".join(make(15) + passage + make(15)) for _ in range(12)] + [" ".join(passage)] * 3 + ["one two", "one  TWO", "One", "", " \n", None, None]
    rng.shuffle(rows)
    return [(i, t, "x", None) for i, t in enumerate(rows)]


def groups_of(rows, p=80, q=100):
    low = {i: i for i, *_ in rows}
    find = lambda x: x if low[x] == x else find(low[x])
    sets = {i: shingles(t) for i, t, *_ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups(spark, seed):
    rows = corpus(seed)
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {tuple(r) for r in got} == groups_of(rows) and len(got) == len(rows)


def test_similar_groups_of_odd_rows(spark):
    long = " ".join(f"w{i % 7919}" for i in range(60000))
    rows = [(None, "a b c d e f g", "", ""), (5, "a b c d e f g", "", ""), (3, "A b c d e f g", "", ""), (3, "A b c d e f g", "", ""), (3, "other words", "", ""),
            (None, "alone here", "", ""), (7, long, "", ""), (8, long + " end", "", ""), (None, None, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_groups(docs).collect()), key=str)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (3, 3), (3, 3), (None, None), (7, 7), (8, 7), (None, None)], key=str)
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def edited(rng, base, edits):
    text = list(base)
    for at in rng.sample(range(len(text)), edits):
        text[at] = f"new{rng.randint(0, 10**6)}"
    return " ".join(text)


@pytest.mark.parametrize("family", [2, 4, 14])
def test_similar_groups_list_no_key_of_two_sets_again(spark, monkeypatch, family):
    rng, listed, keep = random.Random(family), [], Scratch.kept

    def kept(self, df, name):
        out = keep(self, df, name)
        if name == "members":
            listed.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "kept", kept)
    bases = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(24)]
    rows = [(i, t, "x", None) for i, t in enumerate(edited(rng, base, 0 if k == 0 else 2) for base in bases for k in range(family))]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {tuple(r) for r in got} == groups_of(rows) and len(got) == len(rows)
    assert listed and (sum(listed) == 0 if family == 2 else listed[0] > 0)


def test_similar_groups_make_no_sets_that_sketches_tell_apart(spark, monkeypatch):
    """Long texts that share passages meet under keys; unlike ones are told apart without their shingles."""
    rng, asked, made = random.Random(5), [], jaccard._sets_of

    def spied(needed, *args):
        asked.extend(r.doc_id for r in needed.collect())
        return made(needed, *args)

    monkeypatch.setattr(jaccard, "_sets_of", spied)
    shared = [f"s{rng.randint(0, 10**9)}" for _ in range(900)]
    rows = [(i, " ".join(shared + [f"o{rng.randint(0, 10**9)}" for _ in range(900 + 150 * i)]), "", "") for i in range(6)]
    rows += [(20, " ".join(shared + shared[:40]), "", ""), (21, " ".join(shared), "", "")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {tuple(r) for r in got} == groups_of(rows)
    assert {20, 21} <= set(asked) <= {20, 21}


def test_wide_sketches_tell_no_similar_sets_apart(spark):
    rng, columns, pairs = np.random.default_rng(3), [], []
    for k, size in enumerate([500, 520, 600, 1000, 1020, 1024, 1030, 2040, 2060, 4090, 4100, 9000]):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        added = rng.integers(0, 2**63, size // 4, dtype=np.uint64)
        unlike = rng.integers(0, 2**63, size, dtype=np.uint64)
        columns += [base, np.concatenate([base, added]), np.concatenate([base[:size // 2], unlike[size // 2:]])]
        pairs += [(3 * k, 3 * k + 1), (3 * k, 3 * k + 2)]
    sizes = np.array([len(c) for c in columns])
    wide = jaccard._wide(np.repeat(np.arange(len(sizes)), sizes), np.concatenate(columns), sizes).to_pylist()
    reps = spark.createDataFrame([(i, int(n), w) for i, (n, w) in enumerate(zip(sizes, wide))], "set_id long, n_shingles long, wide array<long>")
    got = {(r.a, r.b): r.apart for r in jaccard._told_apart(spark.createDataFrame(pairs, "a long, b long"), reps, jaccard.THRESHOLD).collect()}
    assert set(got) == set(pairs) and got == {(a, b): b % 3 == 2 and sizes[a] > 512 for a, b in pairs}


def test_sets_are_made_again_without_shuffling_texts(spark):
    rows = [(None, "a b c d e f g"), (None, "not asked for"), (3, "h i j k l m n"), (3, "o p q r s t u"), (4, "h i j k l m n"), (5, "v w x y z a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = jaccard._shingled(docs, 5, jaccard.THRESHOLD, 0, None, spark.sparkContext.broadcast(np.zeros(1 << (jaccard.MAP_BITS - 3), dtype=np.uint8)))
    ids = {(r.doc_id, r.n_shingles, r.text_hash): r.set_id for r in ids.collect()}
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    wanted = [(ids[i, 3, hashed[t]], i) for i, t in (rows[0], rows[2], rows[5])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = jaccard._sets_of(spark.createDataFrame(wanted, "set_id long, doc_id long"), docs, 5)
        assert sorted(r.set_id for r in made.collect()) == sorted(s for s, _ in wanted)
        assert set(re.findall(r"hashpartitioning\((\w+)#", made._jdf.queryExecution().executedPlan().toString())) == {"set_id"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_keys_meet_whatever_the_plan():
    """Two sets within the bound share a key, with exact segments, one-deletion neighbourhoods and mixes of them."""
    rng = np.random.default_rng(7)
    none = np.zeros(1 << (jaccard.MAP_BITS - 3), dtype=np.uint8)
    hot = rng.integers(0, 256, len(none), dtype=np.uint8)
    plans = jaccard._bands(jaccard.THRESHOLD)
    for trial in range(300):
        size = int(rng.integers(4, 200))
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        room = jaccard.differences(size)
        gone = int(rng.integers(0, room + 1))
        other = np.concatenate([base[gone:], rng.integers(0, 2**63, int(rng.integers(0, room - gone + 1)), dtype=np.uint64)])
        both = [np.unique(base), np.unique(other)]
        if 9 * len(np.setxor1d(*both)) > len(both[0]) + len(both[1]):
            continue
        band = int(jaccard._band_of(np.array([min(map(len, both))]))[0])
        saved = plans[1][band]
        plans[1][band] = [saved, plans[0][band], plans[0][band] // 2][trial % 3]
        try:
            text = np.repeat([0, 1], [len(b) for b in both])
            owner, key, short = jaccard.keys_of(text, np.concatenate(both), np.array([len(b) for b in both]), np.array([band, band]), jaccard.THRESHOLD, 0, [none, hot][trial % 2])
        finally:
            plans[1][band] = saved
        assert short.any() or set(key[owner == 0]) & set(key[owner == 1])


def removed_words(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            first[tuple(w[k:k + window])] = min(i, first.get(tuple(w[k:k + window]), i))
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        yield i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("seed", [3, 4])
def test_passages(spark, seed):
    rows = corpus(seed)
    # Small shards: several of them in one task.
    got = substring.deduplicated(spark.createDataFrame(rows, DOCS).repartition(4), shard_words=200).collect()
    assert {tuple(r)[:4] for r in got} == set(removed_words(rows)) and len(got) == len(rows)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_passages_read_the_texts_once_for_anchors(spark):
    docs = spark.createDataFrame(corpus(5), DOCS).select("doc_id", "text")
    plan = substring._candidates(docs, substring.WINDOW, substring.ANCHOR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Union") == 0


def test_passages_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, "", ""), (2, text, "", ""), (2, "new " + text, "", ""), (None, text, "", ""), (3, text.replace(" ", "\t\n"), "", ""), (4, None, "", ""), (5, "a b", "", ""),
            (6, ("z " * 50000).strip(), "", ""), (7, "z " * 13, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.deduplicated(docs).collect()), key=str)
    assert got == sorted([(2, 40, 0), (2, 40, 0), (2, 41, 0), (None, 40, 0), (3, 40, 40), (4, 0, 0), (5, 2, 0), (6, 50000, 0), (7, 13, 13)], key=str)
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(6)
    blocks = [[f"line {rng.randint(0, 999)}" for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = []
    for i in range(60):
        lines = [x for _ in range(rng.randint(0, 5)) for x in (rng.choice(blocks) if rng.random() < 0.7 else [f"own {rng.random()}"])]
        rows.append((i, "\n".join(lines), "m", None))
    rows += [(70, None, "", ""), (71, "", "", ""), (None, rows[5][1], "", ""), (72, "\n\n\n\n", "", ""), (73, "x\n" * 3000, "", "")]

    def chunks(lines):
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % linededup.MODULUS for x in lines]
        cuts = [0] + [i for i in range(2, len(lines)) if (h[i - 2] * 263 + h[i - 1]) % linededup.MODULUS % 3 == 0]
        return [lines[a:b] for a, b in zip(cuts, [*cuts[1:], len(lines)])]

    seen, want = set(), set()
    for i, t, *_ in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0])):
        kept = []
        for chunk in chunks(t.split("\n")) if t is not None else []:
            if len(chunk) >= 2 and tuple(chunk) in seen:
                continue
            seen.add(tuple(chunk))
            kept += chunk
        want.add((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, n_removed string")
    got = linededup.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "hash", "n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()} == want
    assert linededup.without_repeats(docs.limit(0)).count() == 0
    twice = linededup.without_repeats(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 24))
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(base)]
    for k in range(120):  # near copies at many angles, a ball of many, and copies
        spread = [0.02, 0.2, 0.35][k % 3]
        rows.append((len(rows), (base[k % 7] + spread * rng.standard_normal(24)).tolist(), rows[k % 7][2]))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and float(unit[i] @ unit[j]) >= 0.93} for i in unit}
    low = {}
    for i in sorted(unit):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in low:
                low[j] = i
                todo += links[j]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [1.0] * 24, None), (None, [1.0] * 24, 1), (904, [], 0), (905, [None] + [1.0] * 23, 2),
           (906, [1e200] * 24, 7), (907, [2e200] * 24, 7), (908, [1.0] * 3, 7)]
    vectors = spark.createDataFrame([(*r, "u") for r in rows + odd], "vec_id long, embedding array<double>, label int, unit string").repartition(4)
    result = neighbours.linked(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result.collect()}
    exact = sum(got[i] == (len(links[i]), low[i], low[i] == i) for i in unit)
    assert exact >= 0.97 * len(unit)
    assert all(got[i][0] <= len(links[i]) for i in unit)  # no link below the threshold
    assert got[906] == (1, 906, True) and got[907] == (1, 906, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 908))
    expected, found = neighbours.recall(vectors, result).head()
    assert expected and found >= 0.9 * expected
    assert neighbours.linked(vectors.limit(0)).count() == 0


def test_vectors_of_a_large_label(spark):
    """Pairs just above the threshold, far from all else: nothing leads to them but the tables."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((20000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * base[:400]).sum(1, keepdims=True) * base[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.932, 0.97, (400, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, cosine * base[:400] + np.sqrt(1 - cosine**2) * side]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id for r in neighbours.linked(vectors).where("n_links > 0").collect()}
    assert len(got & set(range(400))) >= 0.9 * 400 and got <= {*range(400), *range(20000, 20400)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_benchmark(spark):
    item = "If Alice buys 12 apples for 3 dollars each, and then Alice gives 4 apples to Bob, how many dollars did Alice spend in 1,500 days?"
    other = "If Carol buys 15 apples for 7 euros each, and then Carol gives 9 apples to Dave, how many euros did Carol spend in 2,750 days?"
    mixed = other.replace("Carol gives", "Erin gives").replace("did Carol", "did Zoe")
    items = spark.createDataFrame([(1, item, 0), (2, "short one", 0), (3, None, 0), (None, item, 0), (1, item, 0), (4, "7 8 9 10 11 12 13", 0)], "item_id long, text string, hash int")
    rows = [(1, f"before. {item} after"), (2, f"It was so. {other}"), (3, mixed), (4, "apples and dollars for days"), (5, None), (6, ""), (None, item), (7, f"{item} " * 40 + "x " * 60000),
            (8, other), (8, other), (9, "7 8 9 10 11 12 13 14"), (10, " ".join(item.split()[3:]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(i, 1) for i in (1, 2, 7, 8, 10)} | {(9, 4)}  # item 4 has no window and stands verbatim in 9
    assert got[1, 1].verbatim and got[7, 1].verbatim and not got[2, 1].verbatim and got[1, 1].coverage == 1.0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_benchmark_items_without_windows(spark):
    """Against a search of every token sequence: items without a window are found verbatim, the shortest only as whole texts."""
    texts = ["What is 12 + 7 * 3 - 4?", "Name the capital", "Who wrote War and Peace?", "yes", "go on", "1 2 3 4 5 6 7 8 9 10 11", None, "", "?!"]
    items = [(i, t) for i, t in enumerate(texts)] + [(1, "Name the capital"), (None, "yes"), (20, "5 6 7 8 9 8 7 6 5"), (20, "New York City")]
    rng = random.Random(3)
    words = ["yes", "Go on", "name THE capital", "12", "is", "what", "4", "who", "wrote", "5 6 7 8 9", "8 7 6 5", "New York City", "1 2 3 4 5 6 7", "8 9 10 11"]
    docs = [(i, f" {rng.choice(['so', '-'])} ".join(["a", t or "", "b"])) for i, t in enumerate(texts)] + [(30 + i, t) for i, t in enumerate(texts)]
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    docs += [(300, "yes " * 40000 + "name the capital"), (None, "name the capital"), (301, "what is 12 + 8 * 3 - 4"), (302, "what is 12 7 3 4"), (302, "what is 12 7 3 4")]

    def tokens(t):
        return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())

    def held(item, doc):
        n = len(item)
        return n > 0 and (item == doc if n < 3 else any(doc[i:i + n] == item for i in range(len(doc) - n + 1)))

    want = {(d, i) for d, t in docs for i, q in items if None not in (d, i) and held(tokens(q), tokens(t))}
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and all(r.verbatim and r.coverage == 1 for r in got)
    assert {(300, 1), (302, 0), (33, 3), (2, 2)} <= want and (301, 0) not in want


def test_benchmark_names_that_open_sentences(spark):
    items = [(1, "Alice has 5 apples. Bob gives Alice 7 apples. Carol takes 3 apples. How many apples are left?"),
             (2, "Weng earns 12 dollars an hour. Weng worked 50 minutes of babysitting yesterday. How much did Weng earn?")]
    rows = [(1, "Dave has 8 apples. Erin gives Dave 9 apples. Frank takes 2 apples. How many apples are left?"),
            (2, "Tina earns 15 dollars an hour. Tina worked 40 minutes of babysitting yesterday. How much did Tina earn?"),
            (3, "Dave has 8 apples. Erin gives Zoe 9 apples. Frank takes 2 apples. How many apples are left?")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2)}


def test_benchmark_query_finds_whole_items(spark):
    from gridsift.llm.queries import op2_decontaminate
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(docs)
