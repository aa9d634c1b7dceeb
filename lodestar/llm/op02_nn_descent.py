"""Embedding near-duplicates by NN-descent.

Only vectors with equal labels are compared, by cosine in double precision; vectors that are null or zero or hold a
null or non-finite component, and rows with a null label, link with nothing.  Equal vectors of one label are one node.

1. Start: in each of several orders (label, signs of random projections) every node meets its `window` successors.
   Bits and number of orders (`ORDERS` at least) follow the rows of the largest label.
2. Rounds: each node's neighbours, forward and a hashed sample of the reverse, are joined at that node; pairs that beat
   a member's worst neighbour enter its list, and the best `k` stay.  Links (cosine at or above the threshold) are kept
   apart, whatever the lists drop.  A round ends the refinement when the audit holds, no components merge and at most
   `CHANGED` of the lists' entries are new.
3. Audit: every vector whose id is divisible by `audit` is compared to all rows, `AUDITED` of them at a time (a bounded block,
   so it may be broadcast).  While the mean recall of these vectors, or of those with few links, is under `recall`, rounds
   go on with further orders; if it stays there, the operator raises.  Audited links are a measure and never added.
4. Lists that hold nothing but links are saturated.  They are enlarged by the k best neighbours outside the node's
   component, which take part in the joins, until one of them is no link and no components merge; and to every member
   of the component, compared in blocks of `BLOCK`: links are counted, never written out as pairs.

Repeated rows repeat their results.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, python_ready, scratch
from lodestar.llm.graph import components

K, ORDERS, WINDOW, ROUNDS, RECALL, AUDIT, AUDITED, BLOCK = 10, 8, 16, 6, 0.98, 50, 2000, 1024
MISS, FEW, CHANGED = 1e-3, 10, 0.05
log = logging.getLogger(__name__)


def _unit(column: pa.Array) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(held[0].column(k)[0].as_py() for k in keys) != values[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _effort(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of orders for the largest label: a pair at the threshold, whose codes have to agree in
    the bits that leave a window of rows, meets in no order with a chance of at most MISS."""
    depth = np.log2(max(2, rows))
    agree = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** max(1.0, depth - np.log2(WINDOW))
    orders = int(np.ceil(np.log(MISS) / np.log1p(-agree))) if agree < 1 else 1
    return min(62, 16 + int(np.ceil(depth))), max(ORDERS, orders)


def _starts(nodes: DataFrame, orders: range, bits: int, k: int) -> DataFrame:
    found = _start(nodes, orders[0], bits, WINDOW, k)
    for order in orders[1:]:
        found = found.unionByName(_start(nodes, order, bits, WINDOW, k))
    return materialise(found, "starts")


def _merged(labels: DataFrame) -> int:
    """Nodes less components: how many unions the links stand for."""
    r = labels.agg(F.count("*").alias("n"), F.count_distinct("label").alias("c")).first()
    return r["n"] - r["c"]


def _recall(truth: DataFrame, labels: DataFrame) -> tuple[int, float, float]:
    """Audited vectors with links, their mean recall, and that of those with at most FEW links.  Each vector counts
    once, so that large groups cannot hide lost pairs.  A link counts as found when a component holds both ends."""
    left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    each = truth.join(left, "a", "left").join(right, "b", "left").groupBy("a").agg(F.avg(F.coalesce((F.col("la") == F.col("lb")).cast("double"), F.lit(0.0))).alias("r"), F.count("*").alias("n"))
    r = each.agg(F.count("*").alias("n"), F.avg("r").alias("all"), F.avg(F.when(F.col("n") <= FEW, F.col("r"))).alias("small")).first()
    return r["n"], 1.0 if r["all"] is None else r["all"], 1.0 if r["small"] is None else r["small"]


def _start(nodes: DataFrame, order: int, bits: int, window: int, k: int) -> DataFrame:
    """a, b, s: the best k of each node's next rows in one order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for raw in batch.column("vec").to_pylist():
                v = np.frombuffer(raw)
                planes = np.random.default_rng([order, len(v)]).standard_normal((bits, len(v))) if not codes or len(v) != planes.shape[1] else planes
                codes.append(int(((planes @ v) > 0) @ (1 << np.arange(bits)[::-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], ["node", "label", "vec", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([before, batch]) if before is not None else batch
            skip = before.num_rows if before is not None else 0
            before = rows.slice(max(0, rows.num_rows - window))
            label, size, node = rows.column("label").to_numpy(), np.array([len(x) for x in rows.column("vec").to_pylist()]), rows.column("node").to_numpy()
            unit = np.zeros((rows.num_rows, size.max() // 8))
            for n in np.unique(size):
                unit[size == n, : n // 8] = _unit(rows.column("vec").filter(pa.array(size == n)))
            a, b = [], []
            for step in range(1, window + 1):
                i = np.arange(max(0, skip - step), rows.num_rows - step)
                i = i[(label[i] == label[i + step]) & (size[i] == size[i + step])]
                a.append(i)
                b.append(i + step)
            a, b = np.concatenate(a), np.concatenate(b)
            s = np.einsum("ij,ij->i", unit[a], unit[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a], node[b]])), pa.array(np.concatenate([node[b], node[a]])), pa.array(np.concatenate([s, s]))], ["a", "b", "s"])

    placed = nodes.select("node", "label", "vec").mapInArrow(place, "node bigint, label bigint, vec binary, code bigint")
    return placed.repartitionByRange("label", "code", "node").sortWithinPartitions("label", "code", "node").mapInArrow(meet, "a bigint, b bigint, s double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node, each once."""
    once = pairs.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _lists(pairs: DataFrame, labels: DataFrame, k: int, threshold: float, more: DataFrame | None = None) -> DataFrame:
    """a, b, s, far: the k best neighbours, and for nodes whose k best all are links the k best outside the node's
    component (far), also from `more`; so the lists stand for the whole component and a way out of it."""
    near = materialise(_best(pairs, k), "near")
    full = near.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold)).select("a")
    rest = pairs if more is None else pairs.select("a", "b", "s").unionByName(more)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    rest = rest.join(full, "a", "left_semi").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "s")
    return near.withColumn("far", F.lit(False)).unionByName(_best(rest, k).withColumn("far", F.lit(True)))


def _local_join(graph: DataFrame, nodes: DataFrame, labels: DataFrame, k: int, turn: int, threshold: float) -> DataFrame:
    """Candidates a, b, s from the neighbours that meet at each node."""
    degree = graph.groupBy("b", "far").agg(F.count("*").alias("degree"))
    chance = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(1 << 20)) < F.lit(2 * k << 20) / F.col("degree")
    reverse = graph.join(degree, ["b", "far"]).where(chance).select(F.col("b").alias("at"), F.col("a").alias("node"))
    forward = graph.select(F.col("a").alias("at"), F.col("b").alias("node"))
    own = nodes.select(F.col("node").alias("at"), "node")
    held = lambda far: F.when(F.col("far") == F.lit(far), F.col("s"))
    worst = graph.groupBy(F.col("a").alias("node")).agg(*(f(held(x)).alias(n + str(x)) for x in (False, True) for f, n in ((F.min, "s"), (F.count, "n"))))
    bound = lambda x: F.when(F.col(f"n{x}") >= k, F.col(f"s{x}")).otherwise(F.lit(-2.0))
    # Only a node whose list holds nothing but links looks beyond its component.
    worst = worst.select("node", bound(False).alias("worst"), F.when(bound(False) >= threshold, bound(True)).otherwise(F.lit(2.0)).alias("beyond"))
    members = forward.unionByName(reverse).unionByName(own).distinct().join(nodes.select("node", "vec"), "node").join(worst, "node", "left").join(labels, "node", "left")
    members = members.select("at", "node", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("beyond", F.lit(2.0)).alias("beyond"), F.coalesce("label", "node").alias("component"))
    members = members.repartition("at").sortWithinPartitions("at", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s = [], [], []
        for group in _by_key(batches, ["at"]):
            node, worst, unit = group.column("node").to_numpy(), group.column("worst").to_numpy(), _unit(group.column("vec"))
            sims = unit @ unit.T
            np.fill_diagonal(sims, -3)
            component, beyond = group.column("component").to_numpy(), group.column("beyond").to_numpy()
            turns = [(sims, worst)]
            if (beyond < 2).any():
                turns.append((np.where(component[:, None] == component[None, :], -3, sims), beyond))
            for sims_, least in turns:
                top = np.argsort(-sims_, axis=1)[:, :k]
                best = np.take_along_axis(sims_, top, axis=1)
                i, j = np.nonzero((best > least[:, None]) | (best >= threshold))
                a.append(node[i])
                b.append(node[top[i, j]])
                s.append(best[i, j])
            if sum(map(len, a)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "s"])
                a, b, s = [], [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "s"])

    return members.mapInArrow(join, "a bigint, b bigint, s double")


def _truth(nodes: DataFrame, audit: int, threshold: float) -> DataFrame:
    """All links (a, b) of every vector whose id is divisible by `audit`, block by block."""
    spark = nodes.sparkSession
    path = scratch(spark, "audit")
    spark.createDataFrame([], "a bigint, b bigint").write.parquet(path)
    queries = nodes.where(F.col("node") % audit == 0).select("node", "label", "vec").toLocalIterator()
    while block := [tuple(r) for r in islice(queries, AUDITED)]:
        _audited(nodes, block, threshold).write.mode("append").parquet(path)
    return spark.read.schema("a bigint, b bigint").parquet(path)


def _audited(nodes: DataFrame, queries: list, threshold: float) -> DataFrame:
    """All links (a, b) of the queries, a bounded list of (node, label, vec)."""
    by: dict[tuple, tuple] = {}
    for node, label, vec in queries:
        by.setdefault((label, len(vec)), ([], []))[0].append(node)
        by[label, len(vec)][1].append(bytes(vec))
    held = {key: (np.array(ids), _unit(pa.array(vecs))) for key, (ids, vecs) in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, size = batch.column("node").to_numpy(), batch.column("label").to_numpy(), np.array([len(x) for x in batch.column("vec").to_pylist()])
            for (own, width), (ids, unit) in held.items():
                rows = np.flatnonzero((label == own) & (size == width))
                if len(rows):
                    i, j = np.nonzero(_unit(batch.column("vec").take(pa.array(rows))) @ unit.T >= threshold)
                    a, b = ids[j], node[rows[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return nodes.select("node", "label", "vec").mapInArrow(run, "a bigint, b bigint")


def _count_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """members: component, node, copies, vec.  node, others: copies of all nodes linked with it."""
    import pandas as pd

    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    split = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    split = split.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("other", "parts")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unit, copies, part, node = _unit(pa.array(rows["vec"])), rows["copies"].to_numpy(), rows["part"].to_numpy(), rows["node"].to_numpy()
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= part[:, None] != part[None, :]
        return pd.DataFrame({"node": node, "others": near @ copies})

    return split.groupBy("component", "p", "q").applyInPandas(run, "node bigint, others bigint").groupBy("node").agg(F.sum("others").alias("others"))


def near_duplicates(table: DataFrame, threshold: float = 0.98, k: int = K, recall: float = RECALL, rounds: int = ROUNDS, audit: int = AUDIT) -> DataFrame:
    """vec_id, n_links, component_id (long), kept (boolean)."""
    python_ready(table.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                ok = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
                vectors.append(np.array(v, np.float64).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary())], ["vec_id", "label", "vec"])

    source = table.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(source.mapInArrow(check, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, label bigint, vec binary"), "vectors")
    nodes = rows.where("vec is not null and vec_id is not null").groupBy("label", "vec").agg(F.min("vec_id").cast("long").alias("node"), F.count_distinct("vec_id").alias("copies"))
    nodes = materialise(nodes.select("node", "label", "vec", "copies"), "nodes")

    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, orders = _effort(largest, threshold)
    found = _starts(nodes, range(orders), bits, k)
    links = materialise(found.where(F.col("s") >= threshold).select("a", "b").distinct(), "links")
    truth = _truth(nodes, audit, threshold)
    reached = components(links)
    graph = materialise(_lists(found, reached, k, threshold), "graph")
    merged, used, turn = _merged(reached), orders, 0
    while True:
        met = materialise(_local_join(graph, nodes, reached, k, turn, threshold), "met")
        if turn and not held:  # the orders so far were too few for this table
            met = met.unionByName(_starts(nodes, range(used, used + orders), bits, k))
            used += orders
        links = materialise(links.unionByName(met.where(F.col("s") >= threshold).select("a", "b")).distinct(), "links")
        reached = components(links)
        had, merged = merged, _merged(reached)
        # Where components have merged, lists of neighbours outside them may be empty: the starts fill them again.
        was, graph = graph, materialise(_lists(graph.select("a", "b", "s").unionByName(met), reached, k, threshold, found if merged > had else None), "graph")
        n, overall, small = _recall(truth, reached)
        held = min(overall, small) >= recall
        changed = graph.join(was, ["a", "b"], "left_anti").count() / max(1, graph.count())
        turn += 1
        log.info("round %d, %d orders of %d bits: %d audited vectors with links, recall %.4f, of those with few links %.4f; %d merged, %.3f of the lists new", turn, used, bits, n, overall, small, merged, changed)
        if held and merged == had and changed <= CHANGED:
            break
        if turn >= rounds + bits:
            if not held or merged != had:
                raise RuntimeError(f"NN-descent: recall {overall:.4f}, of vectors with few links {small:.4f}, after {turn} rounds and {used} orders; {merged - had} components merged in the last")
            break
    labels = reached.select("node", F.col("label").alias("component"))
    others = _count_in_blocks(labels.join(nodes.select("node", "copies", "vec"), "node"), threshold)
    of_node = nodes.join(labels, "node", "left").join(others, "node", "left")
    of_node = of_node.select("label", "vec", F.coalesce("component", "node").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.join(of_node, ["label", "vec"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
