"""Set-similarity join on word shingles by partitioning the universe of shingles.

Sets of about equal size (a band) share one partition of all shingles into m segments by hash. If two sets of sizes x
and y reach the threshold, they differ in at most (x + y) * (1 - t) / (1 + t) shingles. A set is found by the segments
it is given: an exact segment (1 unit) is missed only if it differs, a segment with its one-deletion neighbourhood
(2 units) only if two shingles differ there. With more units than possible differences one of them must be met.

Costs decide twice. Per band, a model picks m and how many segments get one-deletion neighbourhoods. Per set, exact
segments are taken in one global order, those with most rare shingles first, and only as many as are needed: since all
sets follow the same order, as in prefix filtering, both sides need index no more than that. Which shingles are frequent
is counted over all texts and told to all tasks as a bit map of fixed size; it steers costs and changes no result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridsift.llm.components import components
from gridsift.llm.words import chunks, mixed, signed
from gridsift.session import Scratch

WORDS, THRESHOLD = 5, (80, 100)
#: Sizes of one band span this factor.
BAND = 3
#: Margin of the units of a set over those needed, in standard deviations, in the cost model.
MARGIN = 4.0
#: Share of frequent shingles that a set may hold before it must take segments of nothing else, and the cost of such an
#: entry, or of a deletion that leaves a single shingle, against others: these meet unrelated sets.
COMMON_SHARE, COMMON_COST = 0.7, 12.0
#: A shingle is frequent from so many sets on; counts below the second number within one batch of texts are left out.
FREQUENT, FREQUENT_IN_BATCH = 16, 3
#: Bits of the map of frequent shingles (8 MB). Two shingles with one bit only cost time.
MAP_BITS = 26
#: Words of 64 bits of a set's parity sketch. Sets whose sketches differ in more bits than they may differ in shingles are
#: told apart without their shingles. Sets of more shingles than it has bits also get a wide one of at least as many bits.
SKETCH = 8
#: Keys from which on a task sorts what it holds; a chunk of texts may add some. It bounds memory and changes no result.
KEYS_AT_ONCE = 1 << 19
#: Where a key's sets are not connected yet, each is compared with so many others of it a round, in the order of a hash;
#: rounds go on while they connect at least this share of the compared pairs. What is left is then compared in full.
BESIDE, WORTH = 4, 0.02

SHINGLED = "doc_id long, n_shingles long, set_id long, check long, sketch array<long>, wide array<long>, short boolean, text_hash long"
GROUPED = "key long, member long, leader long"


def differences(n: np.ndarray | int, threshold=THRESHOLD):
    """Most shingles in which a set of n can differ from any partner that reaches the threshold."""
    p, q = threshold
    return (n + n * q // p) * (q - p) // (q + p)


@functools.cache
def plan(band: int, threshold=THRESHOLD) -> tuple[int, int]:
    """(segments, those of them with one-deletion neighbourhoods) of a band, by least cost at its lower end, middle and top."""
    low, high = BAND ** band, BAND ** (band + 1) - 1
    best = None
    for load in (0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 4.0, 5.0, 6.0, 8.0):
        m = max(1, round(high / load))
        for share in (0.0, 0.25, 0.5, 1.0):
            d, cost = round(m * share), 0.0
            for n in (low, (low + high) // 2, high):
                need = differences(n, threshold) + 1
                p0 = math.exp(-n / m)
                p1 = p0 * n / m
                deep = d * (p1 + 2 * (1 - p0 - p1))
                exact = (m - d) * (1 - p0)
                # Variance of an occupancy sum: what follows from the number of shingles, which is fixed, is taken off.
                mean, load_now = p1 + 2 * (1 - p0 - p1), n / m
                own = p1 + 4 * (1 - p0 - p1) - mean ** 2 - (p1 + 2 * (load_now - p1) - mean * load_now) ** 2 / load_now
                spread = math.sqrt((m - d) * p0 * (1 - (1 + load_now) * p0) + d * max(0.0, own))
                if deep + exact - MARGIN * spread < need:
                    cost = math.inf
                    break
                taken = max(0.0, need - deep)
                common = max(0.0, taken - (m - d) * (1 - p0 ** (1 - COMMON_SHARE))) + d * (p1 + p1 * n / m)
                cost += (taken + d * (1 - p0 - p1) + d * n / m + (COMMON_COST - 1) * common) / n
            if best is None or cost < best[0]:
                best = (cost, m, d)
    return (best[1], best[2]) if math.isfinite(best[0]) else (4 * high, 0)


@functools.cache
def _bands(threshold) -> tuple[np.ndarray, np.ndarray]:
    plans = [plan(band, threshold) for band in range(22)]
    return np.array([p[0] for p in plans], dtype=np.uint64), np.array([p[1] for p in plans], dtype=np.uint64)


def sets(words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, sets' sizes) of the distinct shingles, sorted by text and shingle; a shorter text is one shingle."""
    texts = len(words.first) - 1
    lengths = np.diff(words.first)
    owner = words.text_of()
    text, hashes = [], []
    for n in range(1, size + 1):
        if n < size and not (lengths == n).any():
            continue
        at, h = words.grams(n)
        keep = slice(None) if n == size else lengths[owner[at]] == n
        text.append(owner[at][keep])
        hashes.append(h[keep])
    text, hashes = np.concatenate(text), np.concatenate(hashes)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return text, hashes, np.bincount(text, minlength=texts)


def _sums(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Sum modulo 2^64 per text of values sorted by text."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.searchsorted(text, np.arange(texts + 1))
    return total[ends[1:]] - total[ends[:-1]]


def frequent(shingles: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each shingle."""
    place = (shingles >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def keys_of(text: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, bands: np.ndarray, threshold, seed: int, known: np.ndarray):
    """(text, index key) pairs of sets in their ``bands`` (-1: none), and which texts lack units."""
    texts = len(sizes)
    segments_of, deep_of = _bands(threshold)
    wanted = bands[text] >= 0
    text, shingles = text[wanted], shingles[wanted]
    band = bands[text]
    segment = mixed(shingles + np.uint64(0x51ED270B * (seed + 1))) % segments_of[band]
    order = np.lexsort((segment, text))
    text, segment, band, shingles = text[order], segment[order], band[order].astype(np.uint64), shingles[order]
    values = mixed(shingles ^ np.uint64(0xA24BAED4963EE407))
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (segment[1:] != segment[:-1])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(text)))
    total = np.add.reduceat(values, starts) if len(starts) else values
    place = mixed((band[starts] << np.uint64(40)) + (np.uint64(seed) << np.uint64(56)) + segment[starts] + np.uint64(1))
    key = mixed(total + place)
    owner = text[starts]
    deep = segment[starts] < deep_of[band[starts].astype(np.int64)]
    units = np.bincount(owner[deep], weights=np.minimum(count[deep], 2), minlength=texts).astype(np.int64)
    need = differences(sizes, threshold) + 1 - units
    # Exact segments in the global order, which their content decides: most rare shingles first, then most, then by key.
    rare = np.add.reduceat((~frequent(shingles, known)).astype(np.int64), starts) if len(starts) else count
    flat = np.flatnonzero(~deep)
    flat = flat[np.lexsort((key[flat], -count[flat], -rare[flat], owner[flat]))]
    first = np.searchsorted(owner[flat], np.arange(texts))
    rank = np.arange(len(flat)) - first[owner[flat]]
    taken = flat[rank < need[owner[flat]]]
    # One-deletion neighbours: the segment without each of its shingles, if any remains.
    of = np.cumsum(new) - 1
    inner = np.flatnonzero(deep[of] & (count[of] > 1))
    less = mixed(total[of[inner]] - values[inner] + place[of[inner]])
    exact = np.flatnonzero(deep)
    short = (bands >= 0) & (np.bincount(owner[flat], minlength=texts) < need)
    return np.concatenate([owner[taken], owner[exact], text[inner]]), np.concatenate([key[taken], key[exact], less]), short


def _band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([BAND ** k for k in range(1, 22)]), sizes, side="right")


def _frequent_map(docs: DataFrame, size: int) -> np.ndarray:
    """Bits of the shingles that many sets hold."""
    def count(batches):
        for batch in batches:
            every = [sets(words, size)[1] for _, _, words in chunks(batch.column(0), lower=True)]
            shingles = np.sort(np.concatenate(every)) if every else np.zeros(0, dtype=np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(starts, len(shingles)))
            often = n >= FREQUENT_IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(signed(shingles[starts[often]])), pa.array(n[often])], names=["shingle", "n"])

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return _bit_map(counts.select("shingle"))


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """Bit map of the upper MAP_BITS bits of the one column of 64-bit hashes; at most 2 ** (MAP_BITS - 6) rows reach the driver."""
    places = hashes.select(F.shiftrightunsigned(hashes.columns[0], 64 - MAP_BITS).alias("place")).distinct()
    table = places.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits.view(np.uint8)


def _sketches(text: np.ndarray, shingles: np.ndarray, texts: int) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH buckets, per text."""
    odd = np.bincount(text * (64 * SKETCH) + (mixed(shingles ^ np.uint64(0x632BE59BD9B4E019)) % np.uint64(64 * SKETCH)).astype(np.int64),
                      minlength=texts * 64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(texts, -1), axis=1, bitorder="little").view(np.int64).reshape(-1)


def _wide(text: np.ndarray, shingles: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Sketches of a power of two times 64 * SKETCH buckets, at least one a shingle; null where ``_sketches`` has as many.

    A sketch folds to one of fewer buckets by the parity of its parts.
    """
    words = np.where(sizes > 64 * SKETCH, SKETCH << np.ceil(np.log2(np.maximum(sizes, 1) / (64 * SKETCH))).clip(0).astype(np.int64), 0)
    first = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(words[text] > 0)
    bucket = mixed(shingles[at] ^ np.uint64(0x632BE59BD9B4E019)) % (64 * words[text[at]]).astype(np.uint64)
    odd = np.bincount(64 * first[text[at]] + bucket.astype(np.int64), minlength=64 * first[-1]) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(words == 0, False)), pa.array(bits))


def _apart(threshold, a: str, b: str):
    """Whether two rows' sketches and sizes already tell that the sets are not similar."""
    p, q = threshold
    differing = sum((F.bit_count(F.get(f"sketch_{a}", i).bitwiseXOR(F.get(f"sketch_{b}", i))) for i in range(SKETCH)), F.lit(0))
    n, m = F.col(f"n_shingles_{a}"), F.col(f"n_shingles_{b}")
    return (F.greatest(n, m) * p > F.least(n, m) * q) | (differing * (p + q) > (n + m) * (q - p))


def _keys(text, shingles, sizes, own, threshold, seed, only, known):
    """(text, index key) pairs of the texts of a slice, sorted by text, and which texts lack units."""
    texts = len(sizes)
    # Copies inside the slice are indexed once.
    fresh = np.zeros(texts, dtype=bool)
    fresh[np.unique(own, return_index=True)[1]] = True
    band = _band_of(sizes)
    lives = fresh & (differences(sizes, threshold) > 0)  # without room for a difference only equal sets are similar
    bands = np.where(lives, band, -1)
    lower = np.where(lives & (-(-sizes * threshold[0] // threshold[1]) < BAND ** band), band - 1, -1)
    if only is not None:
        bands, lower = np.where(np.isin(bands, only), bands, -1), np.where(np.isin(lower, only), lower, -1)
    parts = [keys_of(text, shingles, sizes, b, threshold, seed, known) for b in (bands, lower)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), parts[0][2] | parts[1][2]


def _set_ids(text, shingles, texts):
    return _sums(mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)), text, texts)


def _shingled(docs: DataFrame, size: int, threshold, seed: int, only: tuple[int, ...] | None, known) -> DataFrame:
    def run(batches):
        for batch in batches:
            for low, high, words in chunks(batch.column(1), lower=True):
                text, shingles, sizes = sets(words, size)
                texts = high - low
                own = _set_ids(text, shingles, texts)
                check = _sums(mixed(shingles + np.uint64(0x9FB21C651E98DF25)), text, texts)
                short = _keys(text, shingles, sizes, own, threshold, seed, only, known.value)[2]
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * SKETCH), pa.array(_sketches(text, shingles, texts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, texts), pa.array(sizes.astype(np.int64)), pa.array(signed(own)), pa.array(signed(check)), sketch,
                     _wide(text, shingles, sizes), pa.array(short), batch.column(2).slice(low, texts)],
                    names=["doc_id", "n_shingles", "set_id", "check", "sketch", "wide", "short", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(run, SHINGLED)


def _stars(docs: DataFrame, size: int, threshold, seed: int, only: tuple[int, ...] | None, known) -> DataFrame:
    """(key, member, leader): every set under a key with the one of fewest rare shingles there, for keys of several sets.

    In a group of near copies that one is most like the text they were made from. Sets that a task holds at once are first
    joined to their leader, which alone goes on to the shuffle: however many sets share a key, few rows of it arrive there.
    Keys are made and merged in one Python pass, so lists of keys never leave the worker.
    """
    def local(batches):
        held, count = [], 0
        for batch in batches:
            for low, high, words in chunks(batch.column(0), lower=True):
                text, shingles, sizes = sets(words, size)
                own = _set_ids(text, shingles, high - low)
                owner, key, _ = _keys(text, shingles, sizes, own, threshold, seed, only, known.value)
                rare = np.bincount(text, weights=~frequent(shingles, known.value), minlength=high - low).astype(np.int32)
                held.append((signed(own)[owner], rare[owner], signed(key)))
                count += len(key)
                if count >= KEYS_AT_ONCE:
                    yield led(*[np.concatenate(column) for column in zip(*held)])
                    held, count = [], 0
        if count:
            yield led(*[np.concatenate(column) for column in zip(*held)])

    def led(member, rare, key):
        order = np.lexsort((member, rare, key))
        key, member, rare = key[order], member[order], rare[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        leader = member[np.flatnonzero(new)[np.cumsum(new) - 1]]
        keep = new | (leader != member)
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(member[keep]), pa.array(leader[keep], mask=new[keep]), pa.array(rare[keep])],
                                          names=["key", "member", "leader", "rare"])

    found = docs.select("text").mapInArrow(local, GROUPED + ", rare int")
    # Rows that have their leader take the same exchange, so that the texts are read once; they are dealt evenly.
    dealt = found.repartition(F.when(F.col("leader").isNull(), F.col("key")).otherwise(F.xxhash64("key", "member", "leader")))
    return dealt.sortWithinPartitions("key", "rare", "member").select("key", "member", "leader").mapInArrow(_across, GROUPED)


def _across(batches):
    """(key, member, leader) of rows that come sorted by key: the first of a key without a leader leads the others without."""
    last_key, last_leader = None, 0
    for batch in batches:
        led = batch.column(2).is_valid()
        yield batch.filter(led)
        batch = batch.filter(pc.invert(led))
        key, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        leader = np.where(starts >= 0, member[np.maximum(starts, 0)], last_leader)
        last_key, last_leader = key[-1], leader[-1]
        keep = leader != member
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(member[keep]), pa.array(leader[keep])], names=["key", "member", "leader"])


def _beside(near: DataFrame, threshold) -> DataFrame:
    """(a, b) of rows (key, node, part, n_shingles, sketch) that come sorted by key: each with the next few of its key, if
    of other parts and not told apart by sizes and sketches. Keys of up to BESIDE + 1 sets are compared in full by it.
    """
    p, q = threshold

    def distinct(held):
        a, b = (np.concatenate(column) for column in zip(*held))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    def run(batches):
        tail, held, count = None, [], 0  # a pair mostly meets under many keys of a task
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now.append(batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH))
            key, node, part, n, sketch = now = now if tail is None else [np.concatenate(pair) for pair in zip(tail, now)]
            for step in range(1, BESIDE + 1):
                i = np.flatnonzero((key[step:] == key[:-step]) & (part[step:] != part[:-step]))
                i = i[np.maximum(n[i], n[i + step]) * p <= np.minimum(n[i], n[i + step]) * q]
                differing = np.bitwise_count(sketch[i] ^ sketch[i + step]).sum(1, dtype=np.int64)
                i = i[differing * (p + q) <= (n[i] + n[i + step]) * (q - p)]
                held.append((node[i], node[i + step]))
                count += len(i)
            tail = [x[-BESIDE:].copy() for x in now]
            if count >= KEYS_AT_ONCE:
                yield distinct(held)
                held, count = [], 0
        if count:
            yield distinct(held)

    return near.select("key", "node", "part", "n_shingles", "sketch").mapInArrow(run, "a long, b long")


def _sets_of(needed: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) of the sets in ``needed`` (set_id, doc_id), made again from one text of each.

    The texts stay where they are: a bit map of fixed size tells the tasks which ids are asked for. Ids that share a bit, and
    other texts of an id, only cost the shuffle of their shingles.
    """
    asked = docs.sparkSession.sparkContext.broadcast(_bit_map(needed.select(F.xxhash64("doc_id"))))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).filter(pa.array(frequent(batch.column(0).to_numpy().view(np.uint64), asked.value)))
            for low, high, words in chunks(texts, lower=True):
                text, shingles, sizes = sets(words, size)
                own = signed(_set_ids(text, shingles, high - low))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(shingles)))],
                                                 names=["set_id", "shingles"])

    made = docs.select(F.xxhash64(F.col("doc_id").cast("long")), "text").mapInArrow(run, "set_id long, shingles array<long>")
    return made.join(needed.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _judged(pairs: DataFrame, reps: DataFrame, threshold) -> DataFrame:
    """``pairs`` (a, b) with ``apart``: whether sizes and sketches alone tell that the sets are not similar."""
    of = {s: reps.select(F.col("set_id").alias(s), F.col("n_shingles").alias(f"n_shingles_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"}
    return pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", _apart(threshold, "a", "b").alias("apart"))


def _told_apart(pairs: DataFrame, reps: DataFrame, threshold) -> DataFrame:
    """``pairs`` (a, b) with ``apart``: whether the wide sketches tell that the sets are not similar, if both have one."""
    p, q = threshold

    def judge(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            apart = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = sorted((np.asarray(batch.column(c)[i].values) for c in (4, 5)), key=len)
                differing = np.bitwise_count((x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).view(np.uint64)).sum(dtype=np.int64)
                apart[i] = differing * (p + q) > (n[i] + m[i]) * (q - p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], names=["a", "b", "apart"])

    of = {s: reps.where("wide is not null").select(F.col("set_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab"}
    judged = pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(judge, "a long, b long, apart boolean")
    return pairs.join(judged.where("apart"), ["a", "b"], "left").select("a", "b", F.coalesce("apart", F.lit(False)).alias("apart"))


def _tested(pairs: DataFrame, shingles: DataFrame, threshold) -> DataFrame:
    """``pairs`` (a, b) with ``similar``: the exact test on the whole sets."""
    p, q = threshold

    def test(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            same = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values).view(np.uint64) for c in (a, b))
                if p * max(len(x), len(y)) <= q * min(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    same[i] = q * common >= p * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["a", "b", "similar"])

    joined = (pairs.join(shingles.select(F.col("set_id").alias("a"), F.col("shingles").alias("of_a")), "a")
              .join(shingles.select(F.col("set_id").alias("b"), F.col("shingles").alias("of_b")), "b").select("a", "b", "of_a", "of_b"))
    return joined.mapInArrow(test, "a long, b long, similar boolean")


def similar_groups(docs: DataFrame, *, size: int = WORDS, threshold: tuple[int, int] = THRESHOLD, with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, and text_hash (xxhash64 of the text) ``with_hash``.

    Texts link when threshold[1] * |A and B| >= threshold[0] * |A or B| on their distinct word shingles; shingles are
    told apart by 64-bit hashes. component_id is the smallest doc_id reachable by links. Null, empty and wordless texts
    have no shingles, link with nothing and keep their own doc_id. Rows with a null doc_id take part; their
    component_id is null if no row of their group has an id. Repeated rows give repeated results. Rows of one
    doc_id with different texts are judged apart; text_hash tells which is which. Columns besides doc_id and text are not read. An empty table gives an empty result.

    Equal sets count as one from the start. Under each index key all sets are compared with one leader, then, where that did
    not connect them, with some others, and in the end all that are still of different components with each other: every
    candidate pair is tested or already connected.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        known = spark.sparkContext.broadcast(_frequent_map(docs, size))
        # Two passes over the texts: the index keys, most of a set's bytes, go straight to their exchange and are never kept.
        shingled = scratch.kept(_shingled(docs, size, threshold, 0, None, known), "shingled")
        reps = scratch.kept(shingled.where("n_shingles > 0").groupBy("set_id", "n_shingles").agg(
            F.min("doc_id").alias("doc_id"), F.min("check").alias("check"), F.max("check").alias("_check"), F.max("short").alias("short"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide")).select(
            "set_id", "n_shingles", "doc_id", "short", "sketch", "wide", F.assert_true(F.col("check") == F.col("_check"), F.lit("two sets with one 64-bit id")).alias("ok")), "classes")
        grouped, seed, short = _stars(docs, size, threshold, 0, None, known), 0, reps.where("short")
        # Sets whose segments happened to be too full lack units; their bands are dealt anew until none does.
        lacking = short.select("set_id", "n_shingles")
        while True:
            sizes = [row[0] for row in lacking.select(F.floor(F.log(float(BAND), F.col("n_shingles") + 0.5)).cast("int").alias("band")).distinct().collect()]
            if not sizes:
                break
            seed += 1
            only = tuple(sorted({b for band in sizes for b in (band, band - 1)}))
            again = scratch.kept(_shingled(docs, size, threshold, seed, only, known), "shingled")
            grouped = grouped.unionByName(_stars(docs, size, threshold, seed, only, known))
            lacking = lacking.join(again.where("short").select("set_id").distinct(), "set_id", "left_semi")
        grouped = scratch.kept(grouped, "grouped")
        found = scratch.kept(shingled.select("doc_id", "n_shingles", "text_hash", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")), "texts")
        scratch.drop(shingled)

        def compared(pairs: DataFrame) -> DataFrame:
            """Pairs with the exact answer; only sets that no sketch tells apart are made, and go straight to their exchange."""
            judged = scratch.kept(_told_apart(pairs, reps, threshold), "judged")
            near = judged.where("not apart").select("a", "b")
            asked = near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
            asked = scratch.kept(asked.join(reps.select("set_id", "doc_id"), "set_id"), "asked")
            apart = judged.where("apart").select("a", "b", F.lit(False).alias("similar"))
            if not asked.head(1):
                return apart
            return scratch.kept(_tested(near, _sets_of(asked, docs, size), threshold).unionByName(apart), "tested")

        pairs = grouped.select(F.least("member", "leader").alias("a"), F.greatest("member", "leader").alias("b")).distinct()
        pairs = scratch.kept(_judged(pairs, reps, threshold).where("not apart").select("a", "b"), "pairs")
        tested = compared(pairs) if pairs.head(1) else pairs.withColumn("similar", F.lit(False))
        links = tested.where("similar").select("a", "b")
        parts = components(links, scratch)

        # All sets under keys where some set is not connected with its leader; only those matter from here on. Where a key has
        # two sets only, they have been compared: unrelated sets mostly meet so, and ever more of them in larger tables.
        def placed(df, node, out):
            return df.join(parts.select(F.col("node").alias(node), F.col("component").alias("_part")), node, "left").withColumn(
                out, F.coalesce("_part", node)).drop("_part")

        several = grouped.groupBy("key").agg(F.min(F.struct("member", "leader")).alias("low"), F.max(F.struct("member", "leader")).alias("high")).where("low <> high")
        several = scratch.kept(grouped.join(several.select("key"), "key", "left_semi"), "several")
        scratch.drop(grouped)
        apart = placed(placed(several, "member", "part_m"), "leader", "part_l").where("part_m <> part_l").select("key").distinct()
        members = scratch.kept(several.join(apart, "key", "left_semi").select("key", F.explode(F.array("member", "leader")).alias("node")).distinct(), "members")
        scratch.drop(several)
        sized = lambda members: placed(members, "node", "part").join(reps.select(F.col("set_id").alias("node"), "n_shingles", "sketch"), "node")
        least = 2
        while True:
            open_members = placed(members, "node", "part")
            still = open_members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where(
                (F.col("low") != F.col("high")) & (F.col("n") >= least)).select("key")
            before, members = members, scratch.kept(open_members.join(still, "key", "left_semi").select("key", "node"), "members")
            scratch.drop(before)
            near = sized(members).repartition("key").sortWithinPartitions("key", F.xxhash64("node", "part"))
            more = scratch.kept(_beside(near, threshold).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            least = BESIDE + 2
            count = more.count()
            if not count:
                break
            answered = compared(more)
            tested, links = tested.unionByName(answered), links.unionByName(answered.where("similar").select("a", "b"))
            parts = components(links, scratch)
            if answered.where("similar").count() < WORTH * count:
                break
        large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")
        rest = sized(members.join(large, "key", "left_semi"))
        left, right = (rest.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "part", "n_shingles", "sketch")]) for s in "ab")
        more = (left.join(right, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("part_a") != F.col("part_b")) & ~_apart(threshold, "a", "b"))
                .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = scratch.kept(more, "pairs")
        if more.head(1):
            links = links.unionByName(compared(more).where("similar").select("a", "b"))

        parts = components(links, scratch)
        ids = reps.select("set_id", "doc_id").join(parts.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn(
            "component", F.coalesce("component", "set_id"))
        lows = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        labels = ids.join(lows, "component").select("set_id", "component_id")
        return scratch.result(found.join(labels, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *["text_hash"] * with_hash), "groups")
