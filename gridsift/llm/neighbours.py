"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors that lie close to a leader first become its ball: by the triangle inequality for angles, most pairs between balls
need no look. The graph of the leaders starts from neighbours in several sorted random projections and is refined by
local joins: every vector shows its neighbours, and those it is a neighbour of, to each other. A list that holds links only is
saturated and grows. All links of a sample of leaders, found by comparing it with everything, tell which sizes of labels still
lack links; those get further sorted projections until the sample's links are there. Links between leaders then decide their balls' pairs, which are counted as wholes where the angles
allow and compared one by one where not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridsift.llm.components import components
from gridsift.session import Scratch

THRESHOLD = 0.93
#: Neighbours kept per vector until its list is saturated, then twice as many, and so on.
NEIGHBOURS = 8
#: Sorted projections that seed the graph, sign bits of each, and neighbours taken on each side.
TABLES, CODE_BITS, BESIDE = 8, 12, 2
#: Rounds of local joins before the first audit; they end earlier once one adds less than ``STILL`` of the links' and lists' entries.
ROUNDS, STILL = 6, 0.002
#: Share of the audited links that must be found, and leaders that are audited per class of label sizes (powers of two).
TARGET, AUDIT = 0.95, 4096
#: Neighbours on each side in the tables that an audit asks for; their codes have as many bits as their label needs.
BESIDE_MORE = 4
#: Balls: sign bits that must agree with the leader, and the least cosine to it.
BALL_BITS, BALL_COSINE = 16, 0.9995
#: Vectors of one local join; larger neighbourhoods are dealt anew into such blocks each round.
BLOCK = 48
SEED = 11

_UNIT = "vec_id long, label long, unit array<double>, code long, codes array<long>"


def _planes(bits: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, bits))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _units(vectors: DataFrame) -> DataFrame:
    """Usable vectors at length one, in double precision, with their codes. Vectors of other sizes meet in no bucket."""
    def run(batches):
        for batch in batches:
            rows: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            for vec_id, label, values in zip(*[c.to_pylist() for c in batch.columns]):
                if vec_id is None or label is None or values is None or not values or None in values:
                    continue
                x = np.asarray(values, dtype=np.float64)
                peak = np.abs(x).max()
                if not np.isfinite(x).all() or peak == 0:
                    continue
                x = x / peak  # so that no square over- or underflows
                rows.setdefault(len(x), []).append((vec_id, label, x / math.sqrt(x @ x)))
            for size, found in rows.items():
                unit = np.stack([r[2] for r in found])
                weights = 1 << np.arange(BALL_BITS, dtype=np.int64)
                code = ((unit @ _planes(BALL_BITS, size, SEED)) > 0) @ weights * 1021 + size % 1021
                signs = [((unit @ _planes(CODE_BITS, size, SEED + 1 + t)) > 0) @ (1 << np.arange(CODE_BITS, dtype=np.int64)) for t in range(TABLES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array(list(unit), pa.list_(pa.float64())),
                     pa.array(code), pa.array(list(np.stack(signs, axis=1)), pa.list_(pa.int64()))], names=["vec_id", "label", "unit", "code", "codes"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, _UNIT)


def _cosines(pairs: DataFrame, a: str, b: str, keep: list[str], name: str = "cosine") -> DataFrame:
    """``keep`` columns and the cosine of two unit-vector columns, computed on whole batches."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            if len(x) and (batch.num_rows * len(x[0]) == len(x.flatten()) == len(y.flatten())):
                value = np.einsum("ij,ij->i", _matrix(x), _matrix(y))
            else:  # sizes differ: never alike
                value = np.array([float(np.dot(p.values, q.values)) if len(p) == len(q) else -1.0 for p, q in zip(x, y)])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(value)], names=[*keep, name])

    return pairs.select(a, b, *keep).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + f", {name} double")


def _seeds(leaders: DataFrame) -> DataFrame:
    """(u, v): neighbours in the order of each table's codes, within a label. Slices of the order are cut at partition ends."""
    coded = leaders.select("vec_id", "label", F.posexplode("codes").alias("table", "code"))
    return _beside(coded, ["table", "label", "code", "vec_id"], BESIDE)


def _more_seeds(leaders: DataFrame, first: int, tables: int) -> DataFrame:
    """(u, v): neighbours in ``tables`` further tables, for leaders with ``bits``: sign bits as many as tell a label's vectors
    apart, so that the neighbours are those of one code, and a further projection as the order within a code."""
    def run(batches):
        for batch in batches:
            vec, label, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            length = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                unit = _matrix(batch.column(2).take(pa.array(at)))
                for table in range(first, first + tables):
                    shown = unit @ _planes(64, int(size), SEED + 1 + table)
                    signs = (shown[:, :63] > 0) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(vec[at]), pa.array(label[at]), pa.array(np.full(len(at), table, dtype=np.int32)),
                         pa.array(signs >> (63 - bits[at])), pa.array(shown[:, 63])], names=["vec_id", "label", "table", "code", "within"])

    coded = leaders.select("vec_id", "label", "unit", "bits").mapInArrow(run, "vec_id long, label long, table int, code long, within double")
    return _beside(coded, ["table", "label", "code", "within", "vec_id"], BESIDE_MORE)


def _beside(coded: DataFrame, order: list[str], beside: int) -> DataFrame:
    sorted_codes = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        tail = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)])
            both = now if tail is None else np.concatenate([tail, now], axis=1)
            vec, label, table = both
            pairs = []
            for step in range(1, beside + 1):
                same = (label[step:] == label[:-step]) & (table[step:] == table[:-step]) & (vec[step:] != vec[:-step])
                pairs.append(np.stack([vec[:-step][same], vec[step:][same]]))
            tail = both[:, -beside:]
            u, v = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return sorted_codes.select("vec_id", "label", "table").mapInArrow(run, "u long, v long").distinct()


def _local_joins(graph: DataFrame, leaders: DataFrame, round_no: int, threshold: float) -> DataFrame:
    """(u, v, cosine): pairs of one vector's neighbourhood, either way round, that were not both known before.

    Neighbourhoods larger than ``BLOCK`` are dealt into blocks by a hash of the round, so none is held whole.
    """
    both = graph.select(F.col("u").alias("m"), F.col("v").alias("n"), "fresh").unionByName(graph.select(F.col("v").alias("m"), F.col("u").alias("n"), "fresh"))
    members = both.groupBy("m", "n").agg(F.max("fresh").alias("fresh"))
    degree = members.groupBy("m").agg(F.count(F.lit(1)).alias("degree"))
    blocks = F.when(F.col("degree") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("m", "n", F.lit(round_no)), F.ceil(F.col("degree") / BLOCK).cast("int")))
    shown = members.join(degree.where("degree > 1"), "m").withColumn("block", blocks).join(leaders.select(F.col("vec_id").alias("n"), "unit"), "n")
    # A block has about BLOCK members: the degree over the number of blocks, dealt by hash.
    rows = shown.groupBy("m", "block").agg(F.collect_list("n").alias("ids"), F.collect_list("fresh").alias("fresh"), F.flatten(F.collect_list("unit")).alias("units"))

    def run(batches):
        for batch in batches:
            u_all, v_all, c_all = [], [], []
            for ids, fresh, units in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids, new = np.asarray(ids.values), np.asarray(fresh.values.to_numpy(zero_copy_only=False), dtype=bool)
                if not new.any() or len(units) % len(ids):
                    continue
                x = np.asarray(units.values).reshape(len(ids), -1)
                cosine = x @ x.T
                i, j = np.nonzero(np.triu(new[:, None] | new[None, :], 1))
                # Of each member its best few of this block, and all links.
                best = np.sort(np.where(np.eye(len(ids), dtype=bool), -2, cosine), axis=1)[:, -min(4, len(ids)):][:, 0]
                take = (cosine[i, j] >= threshold) | (cosine[i, j] >= np.minimum(best[i], best[j]))
                u_all.append(np.minimum(ids[i[take]], ids[j[take]]))
                v_all.append(np.maximum(ids[i[take]], ids[j[take]]))
                c_all.append(cosine[i[take], j[take]])
            if u_all:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u_all, v_all, c_all)], names=["u", "v", "cosine"])

    return rows.select("ids", "fresh", "units").mapInArrow(run, "u long, v long, cosine double").where("u <> v").groupBy("u", "v").agg(F.max("cosine").alias("cosine"))


def _audit(leaders: DataFrame, labels: DataFrame, threshold: float, sample: int) -> DataFrame:
    """(size_class, u, v): all links of about ``sample`` leaders per class of label sizes, by comparing them with their whole label.

    The sample is drawn by a hash of the id. It is sent to all tasks: its size follows from the number of classes alone.
    """
    spark = leaders.sparkSession
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < F.ceil(F.lit(float(sample)) / F.col("total") * (1 << 30))
    held = leaders.select("vec_id", "label", "unit").join(labels, "label").where(drawn).select("vec_id", "label", "unit", "size_class").toArrow()
    rows: dict[tuple[int, int], list] = {}
    for vec_id, label, unit, size_class in zip(*[c.to_pylist() for c in held.columns]):
        rows.setdefault((label, len(unit)), []).append((vec_id, unit, size_class))
    shared = spark.sparkContext.broadcast({k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), v[0][2]) for k, v in rows.items()})

    def run(batches):
        for batch in batches:
            vec, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            length = np.diff(batch.column(2).offsets.to_numpy())
            for key in set(zip(label.tolist(), length.tolist())) & set(shared.value):
                ids, x, size_class = shared.value[key]
                at = np.flatnonzero((label == key[0]) & (length == key[1]))
                for part in np.array_split(at, -(-len(at) // 512)):
                    i, j = np.nonzero(_matrix(batch.column(2).take(pa.array(part))) @ x.T >= threshold + 1e-9)
                    u, v = vec[part[i]], ids[j]
                    other = u != v
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(other.sum(), size_class, dtype=np.int32)), pa.array(np.minimum(u, v)[other]), pa.array(np.maximum(u, v)[other])],
                        names=["size_class", "u", "v"])

    return leaders.select("vec_id", "label", "unit").mapInArrow(run, "size_class int, u long, v long").distinct()


def neighbour_graph(leaders: DataFrame, scratch: Scratch, *, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS,
                    target: float = TARGET, sample: int = AUDIT) -> DataFrame:
    """(u, v, cosine) with u < v: neighbour lists of the leaders (vec_id, label, unit, codes), all found links among them.

    A list holds ``neighbours`` entries, and as long as all of them are links it takes twice as many: all links of a
    vector stay. Links found are always exact. Whether all are found is audited per class of label sizes on about ``sample``
    leaders each: classes with less than ``target`` of their links get twice as many tables as before and a further round of
    local joins, until every class has it. Each table finds each link with a chance that no table before it changes.
    """
    def pruned(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        each = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"), "cosine").unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y"), "cosine"))
        ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y")))
        # Saturated lists: a link always stays, so a list full of links goes on growing.
        listed = ranked.where((F.col("place") <= neighbours) | (F.col("cosine") >= threshold))
        out = listed.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "cosine").distinct()
        if known is None:
            return out.withColumn("fresh", F.lit(True))
        old = known.select("u", "v", F.lit(False).alias("_old"))
        return out.join(old, ["u", "v"], "left").select("u", "v", "cosine", F.coalesce("_old", F.lit(True)).alias("fresh"))

    units = leaders.select("vec_id", "unit")
    seeds = _seeds(leaders).join(units.withColumnsRenamed({"vec_id": "u", "unit": "of_u"}), "u").join(units.withColumnsRenamed({"vec_id": "v", "unit": "of_v"}), "v")
    graph = scratch.kept(pruned(_cosines(seeds, "of_u", "of_v", ["u", "v"]), None), "graph")
    for round_no in range(ROUNDS):
        found = _local_joins(graph, leaders, round_no, threshold)
        merged = graph.select("u", "v", "cosine").unionByName(found).groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
        graph = scratch.kept(pruned(merged, graph), "graph")
        total, fresh = graph.agg(F.count(F.lit(1)), F.sum(F.col("fresh").cast("long"))).head()
        if not total or (fresh or 0) <= STILL * total:
            break

    labels = leaders.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    labels = scratch.kept(labels.join(labels.groupBy("size_class").agg(F.sum("n").alias("total")), "size_class"), "labels")
    audited = scratch.kept(_audit(leaders, labels, threshold, sample), "audited")
    bits = F.greatest(F.lit(CODE_BITS), F.least(F.lit(62), F.col("size_class") + 1)).cast("long")
    first, tables = TABLES, TABLES
    while True:
        found = F.sum(F.col("cosine").isNotNull().cast("long")) / F.count(F.lit(1))
        short = audited.join(graph, ["u", "v"], "left").groupBy("size_class").agg(found.alias("recall")).where(F.col("recall") < target)
        short = [row.size_class for row in short.collect()]  # at most 63 classes
        if not short:
            return graph.select("u", "v", "cosine")
        of_short = leaders.join(labels.where(F.col("size_class").isin(short)).select("label", bits.alias("bits")), "label")
        more = _more_seeds(of_short, first, tables).join(units.withColumnsRenamed({"vec_id": "u", "unit": "of_u"}), "u").join(
            units.withColumnsRenamed({"vec_id": "v", "unit": "of_v"}), "v")
        merged = graph.select("u", "v", "cosine").unionByName(_cosines(more, "of_u", "of_v", ["u", "v"])).groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
        graph = scratch.kept(pruned(merged, graph), "graph")
        found = _local_joins(graph, leaders, first, threshold)
        merged = graph.select("u", "v", "cosine").unionByName(found).groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
        graph = scratch.kept(pruned(merged, graph), "graph")
        first, tables = first + tables, 2 * tables


def linked(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine in double precision is ``threshold`` or more. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id, whose
    component is null and which are kept. Vectors of different sizes never link. Rows that repeat a vec_id are one vector: the
    result is that of its rows together, repeated. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    wide = math.acos(threshold)
    with Scratch(spark) as scratch:
        units = scratch.kept(_units(vectors).dropDuplicates(["vec_id", "label"]), "units")
        # Balls: the smallest id of a code leads those of the code that are close enough to it.
        heads = units.groupBy("label", "code").agg(F.min("vec_id").alias("leader"))
        led = units.join(heads, ["label", "code"]).join(units.select(F.col("vec_id").alias("leader"), F.col("label"), F.col("unit").alias("of_leader")), ["leader", "label"])
        balls = _cosines(led, "unit", "of_leader", ["vec_id", "label", "leader"]).select(
            "vec_id", "label", F.when(F.col("cosine") >= BALL_COSINE, F.col("leader")).otherwise(F.col("vec_id")).alias("leader"),
            F.when(F.col("cosine") >= BALL_COSINE, F.acos(F.least("cosine", F.lit(1.0)))).otherwise(0.0).alias("angle"))
        balls = scratch.kept(balls, "balls")
        sizes = scratch.kept(balls.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius")), "sizes")
        leaders = scratch.kept(units.join(sizes.select(F.col("leader").alias("vec_id"), "label"), ["vec_id", "label"], "left_semi"), "leaders")
        # Leaders whose balls may hold a link: the angle of the threshold and two radii.
        reach = math.cos(min(math.pi, wide + 2 * math.acos(BALL_COSINE)))
        graph = neighbour_graph(leaders, scratch, threshold=reach).where(F.col("cosine") >= reach)
        of = sizes.select(F.col("leader").alias("u"), "label", F.col("size").alias("size_u"), F.col("radius").alias("radius_u"))
        to = sizes.select(F.col("leader").alias("v"), "label", F.col("size").alias("size_v"), F.col("radius").alias("radius_v"))
        met = graph.join(of, "u").join(to, ["v", "label"]).withColumn("between", F.acos(F.least("cosine", F.lit(1.0))))
        slack = 1e-7  # rounding of angles: pairs so near the bound are compared
        met = met.withColumn("most", F.col("between") + F.col("radius_u") + F.col("radius_v")).withColumn(
            "least", F.col("between") - F.col("radius_u") - F.col("radius_v"))
        met = scratch.kept(met.where(F.col("least") <= wide + slack), "met")
        whole = met.where(F.col("most") < wide - slack)
        single = met.where(F.col("most") >= wide - slack).select("u", "v", "label")

        def members(side: str) -> DataFrame:
            return balls.select(F.col("leader").alias(side), "label", F.col("vec_id").alias(f"of_{side}")).join(
                units.select(F.col("vec_id").alias(f"of_{side}"), "label", F.col("unit").alias(f"unit_{side}")), [f"of_{side}", "label"])

        pairs = _cosines(single.join(members("u"), ["u", "label"]).join(members("v"), ["v", "label"]), "unit_u", "unit_v", ["of_u", "of_v"]).where(F.col("cosine") >= threshold)
        pairs = scratch.kept(pairs.select(F.col("of_u").alias("a"), F.col("of_v").alias("b")).distinct(), "pairs")

        # Links of a vector: its own ball, balls linked as wholes, and single pairs.
        own = balls.join(sizes, ["leader", "label"]).select("vec_id", (F.col("size") - 1).alias("n"))
        wholes = whole.select(F.col("u").alias("leader"), "label", F.col("size_v").alias("n")).unionByName(
            whole.select(F.col("v").alias("leader"), "label", F.col("size_u").alias("n"))).groupBy("leader", "label").agg(F.sum("n").alias("n"))
        singles = pairs.select(F.explode(F.array("a", "b")).alias("vec_id"), F.lit(1).cast("long").alias("n"))
        counts = own.unionByName(balls.join(wholes, ["leader", "label"]).select("vec_id", "n")).unionByName(singles).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
        edges = balls.select(F.col("vec_id").alias("a"), F.col("leader").alias("b")).unionByName(whole.select(F.col("u").alias("a"), F.col("v").alias("b"))).unionByName(pairs)
        parts = components(edges, scratch)
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
        result = rows.join(counts, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        return scratch.result(result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "linked")


def recall(vectors: DataFrame, result: DataFrame, *, threshold: float = THRESHOLD, every: int = 20) -> DataFrame:
    """(expected, found): links of the vectors whose id is divisible by ``every``, against brute force over all vectors.

    The stated query vectors go through all others of their label in blocks; their links are counted, not listed.
    """
    units = _units(vectors).select("vec_id", "label", "unit").dropDuplicates(["vec_id", "label"])
    queries = units.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    blocks = queries.groupBy("label", "block").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("unit")).alias("units"))

    def run(batches):
        for batch in batches:
            for vec_id, unit, ids, units in zip(*batch.columns):
                ids, x = np.asarray(ids.values), np.asarray(unit.values)
                cosine = np.asarray(units.values).reshape(len(ids), -1) @ x
                hit = (cosine >= threshold) & (ids != vec_id.as_py())
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(np.ones(hit.sum(), dtype=np.int64))], names=["vec_id", "n"])

    links = units.join(blocks, "label").select("vec_id", "unit", "ids", "units").mapInArrow(run, "vec_id long, n long")
    expected = queries.select("vec_id").distinct().join(links.groupBy("vec_id").agg(F.sum("n").alias("expected")), "vec_id", "left").fillna(0)
    return expected.join(result.select("vec_id", "n_links").distinct(), "vec_id").agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.least("expected", "n_links")), F.lit(0)).alias("found"))
