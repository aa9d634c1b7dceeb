"""Near-duplicates by SetSketch registers.

1. Every text becomes its set of distinct word shingles, as 64-bit hashes.  Equal sets are one node (copies are never
   expanded).  A node's sketch has `bands * rows` registers: register i is floor(1 - log_b x) of the smallest
   exponential value x that hash i gives any shingle, truncated to 0..q+1; sketches of a union are register maxima.
2. Registers are cut into bands; nodes with an equal band share a bucket.  128 registers in bands of 4 lose a pair of
   similarity 0.8 with probability (1 - 0.8**4)**32 = 5e-8.
3. Each bucket's members are compared to its smallest one by the joint likelihood of both sketches; each member's
   best such pair is verified on the full sets, and verified links are joined into components.  So a large group of
   near copies collapses without its pairs.
4. Buckets that still hold several components: pairs of members from different components are estimated in blocks
   from longer sketches (WIDE registers, for nodes that share a bucket; of a coarser base, BASE ** COARSE, so that
   one takes a byte), a pair in the first bucket it shares only.
   Each round verifies each member's likeliest partners, few at first, joins components, and drops what has become
   linked; the last round verifies every pair left that may reach the threshold.  So only pairs that do not
   link have to be tested one by one.  A block that has no further pair to verify doesn't come again.

Sets travel only for pairs to verify, a hot leader's over up to `SALTS` salted copies.
Null text and text without words: an empty set, linked with nothing.  Repeated rows repeat their results.
A null doc_id takes the component of its copies (null if it has none) and is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialise, pieces, python_ready, text_of
from lodestar.llm.graph import components, joined_components

BASE, TOP, RATE = 1.001, (1 << 16) - 2, 20.0
BANDS, ROWS, SALTS, BLOCK = 32, 4, 256, 1024
#: A pair is verified if its estimate is no further below the threshold; about 5 standard errors of either sketch.
SLACK, WIDE, WIDE_SLACK, COARSE = 0.18, 1024, 0.064, 182
#: Partners of a member that a round verifies in each bucket; None: all.
PARTNERS = (1, 8, None)
#: Pairs whose short sketches a task compares at once.
SLAB = 1 << 15
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch, some less than pieces() cuts at: both sides of a batch hold it, in buffers of up to twice that.
BATCH = 7 << 20
GROUP = ["bucket", "p", "q"]
_U = np.uint64


def _finish(z: np.ndarray) -> np.ndarray:
    z ^= z >> _U(31)
    z *= _U(0x7FB5D329728EA185)
    z ^= z >> _U(27)
    z *= _U(0x81DADEF4BC2DD44D)
    z ^= z >> _U(33)
    return z


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    flat, at = words.flatten(), np.asarray(words.offsets, dtype=np.int64)
    at = at - at[0]
    real = pc.not_equal(flat, "")
    if not pc.all(real, min_count=0).as_py():
        kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        flat, at = flat.filter(real), kept[at]
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), _U, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy()]
    n = len(hashes)
    with np.errstate(over="ignore"):
        powers = [_U(1)]
        for _ in range(width):
            powers.append(powers[-1] * _U(0xD1342543DE82EF95))
        windows = np.zeros(max(0, n - width + 1), _U)
        for k in range(width):
            windows += hashes[k : n - width + 1 + k] * powers[width - k] if len(windows) else windows
        windows = _finish(windows)
        out = []
        for i in range(len(at) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                out.append(np.unique(windows[a : b - width + 1]))
            elif b > a:
                part = hashes[a:b]
                out.append(_finish((part * np.array(powers[1 : b - a + 1])).sum(keepdims=True) + _U((b - a) * 0x9E3779B9)))
            else:
                out.append(np.zeros(0, _U))
    return out


@lru_cache(maxsize=4)
def _multipliers(registers: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, registers, dtype=np.uint64) * _U(2) + _U(1)


def sketch(items: np.ndarray, registers: int) -> np.ndarray:
    """Registers of a non-empty set."""
    factors, least = _multipliers(registers)[:, None], np.full(registers, ~_U(0), _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 512):
            np.minimum(least, (factors * items[None, i : i + 512]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def coarsened(registers: np.ndarray) -> np.ndarray:
    """The registers of base BASE ** COARSE: floor(1 - y / c) from floor(1 - y) for a whole c; one byte holds them."""
    return np.clip(1 + (registers.astype(np.int64) - 1) // COARSE, 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _differs(x: np.ndarray, base: float) -> np.ndarray:
    """Chance that a register is larger on one side, whose own share of the union is x."""
    return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 101, base: float = BASE) -> np.ndarray:
    """Similarity of each row's two sets, by the joint likelihood of which registers are larger, smaller or equal."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    up, down = np.maximum(_differs(u - v * j, base), 1e-12), np.maximum(_differs(v - u * j, base), 1e-12)
    score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _attach(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, ...) with `columns` of both nodes, as a_..., b_...; a's row goes to salted copies."""
    pairs = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
    left = table.select(F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    left = left.join(pairs.select("a", "salt").distinct(), "a")
    right = table.select(F.col("node").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return pairs.join(left, ["a", "salt"]).drop("salt").join(right, "b")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                j = estimate(_matrix(batch.column("a_sketch")), _matrix(batch.column("b_sketch")), batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], ["a", "b", "j"]).filter(pa.array(j >= threshold - SLACK))

    return _attach(pairs, nodes, ["sketch", "n"]).mapInArrow(run, "a bigint, b bigint, j double")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a_items"), batch.column("b_items"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                ok.append(both * 100 >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _attach(pairs, sets, ["items"]).mapInArrow(run, "a bigint, b bigint")


def _likely(rows: pa.Table, threshold: float, partners: int | None) -> pa.RecordBatch:
    """Pairs (a, b) of _crossing() from whole groups, whose rows stand together: all, or the `partners` likeliest of each
    row; and (bucket, p, q) of the groups that hold further ones."""
    column = lambda name: rows.column(name).to_numpy()
    raw = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint8).reshape(rows.num_rows, 2 * BANDS * ROWS + WIDE)
    short, wide = np.ascontiguousarray(raw[:, : 2 * BANDS * ROWS]).view(np.uint16), raw[:, 2 * BANDS * ROWS :]
    n, label, part, node, band, within = map(column, ("n", "label", "part", "node", "band", "p"))
    across = within != column("q")
    starts = _starts(rows)
    ends = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
    # Registers that equal sizes have in common at the lowest similarity to verify, less what sizes and chance may take away.
    least = 1 - 2 * float(_differs(np.float64((1 - threshold + WIDE_SLACK) / 2), BASE**COARSE)) - 0.05
    later = ends - np.arange(len(node)) - 1  # members of the group after each row
    total, found, i = np.cumsum(later), [], 0
    while i < len(node):
        stop = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLAB, side="right")))
        counts = later[i:stop]
        x = np.repeat(np.arange(i, stop), counts)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        i = stop
        fresh = (label[x] != label[y]) & ~(across[x] & (part[x] == part[y]))
        x, y = x[fresh], y[fresh]
        same = short[x] == short[y]
        bands = same.reshape(len(x), BANDS, ROWS).all(axis=2)
        first = np.where(bands.any(axis=1), bands.argmax(axis=1), BANDS)  # pairs that an earlier band has brought together are that bucket's
        fresh = (first >= band[x]) & (same.mean(axis=1) >= threshold - SLACK - 0.05)  # equal registers are about the similarity; the likelihood decides
        x, y = x[fresh], y[fresh]
        for k in range(0, len(x), SLAB // 8):
            u, v = x[k : k + SLAB // 8], y[k : k + SLAB // 8]
            alike = (wide[u] == wide[v]).mean(axis=1) >= least
            u, v = u[alike], v[alike]
            j = estimate(wide[u], wide[v], n[u], n[v], 201, BASE**COARSE)
            near = j >= threshold - WIDE_SLACK
            found.append((u[near], v[near], j[near]))
    x, y, j = (np.concatenate(part) if found else np.zeros(0) for part in (zip(*found, strict=True) if found else ((), (), ())))
    x, y = x.astype(np.int64), y.astype(np.int64)
    more = np.zeros(0, np.int64)  # first rows of groups with further pairs
    if partners is not None and len(x):
        pair = np.arange(len(x))
        both, pair = np.concatenate([x, y]), np.concatenate([pair, pair])
        order = np.lexsort((np.concatenate([y, x]), -np.concatenate([j, j]), both))
        own, pair = both[order], pair[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        chosen = np.unique(pair[rank < partners])
        rest = np.setdiff1d(np.arange(len(x)), chosen, assume_unique=True)
        more = np.unique(starts[np.searchsorted(starts, x[rest], side="right") - 1])
        x, y = x[chosen], y[chosen]
    pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), axis=0)
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [pa.concat_arrays([pa.array(pairs[:, k], pa.int64()), none(len(more))]) for k in (0, 1)]
    columns += [pa.concat_arrays([none(len(pairs)), pa.array(column(c)[more], pa.int64())]) for c in GROUP]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", *GROUP])


def _starts(rows: pa.Table) -> np.ndarray:
    """Where the groups (bucket, p, q) of sorted rows begin."""
    keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)


def _blocks(shared: DataFrame) -> DataFrame:
    """shared (bucket, node, band) in groups (bucket, p, q): the pairs of blocks of a bucket; a group has two blocks at most."""
    sizes = shared.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    split = shared.join(sizes, "bucket").withColumn("part", F.pmod(F.hash("node"), F.col("parts").cast("int")).cast("long"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return split.select(*GROUP[:1], F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.col("band").cast("int").alias("band"), "node", "part")


def _crossing(blocks: DataFrame, labels: DataFrame, wide: DataFrame, threshold: float, partners: int | None) -> DataFrame:
    """Likely pairs (a, b) of different components inside the groups of `blocks`: of each member the `partners` likeliest;
    and the groups that hold further ones.  Sketches are attached last, to members of groups with several components only.
    Groups are small but many, so a task compares those of an Arrow batch at once and holds back the last, which may go
    on in the next."""
    labelled = blocks.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy(*GROUP).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*GROUP)
    mixed = labelled.join(several, GROUP).join(wide, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = pa.concat_tables([held, rows]) if held is not None else rows
                last = int(_starts(rows)[-1])
                if last:
                    yield _likely(rows.slice(0, last), threshold, partners)
                held = rows.slice(last)
        if held is not None:
            yield _likely(held, threshold, partners)

    split = mixed.select(*GROUP, "band", "node", "label", "n", "part", "wide")
    split = split.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    return split.mapInArrow(run, "a bigint, b bigint, bucket bigint, p bigint, q bigint")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles (long), component_id (smallest doc_id that links reach), kept (boolean)."""
    python_ready(docs.sparkSession, BATCH)
    source = docs.select("doc_id", text_of().alias("ss_text"))
    id_type = source.schema[0].dataType.simpleString()
    registers = BANDS * ROWS
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in pieces(batch, "ss_text"):
                sets = shingle_sets(part.column("ss_text"), width)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                made = [sketch(s, registers).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests), pa.array(made, pa.binary())], ["doc_id", "n", "digest", "sketch"])

    rows = kept(source.mapInArrow(sketches, f"doc_id {id_type}, n bigint, digest binary, sketch binary"), "sketches")
    nodes = rows.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.random.default_rng(5).integers(0, 1 << 63, BANDS, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore"):
                    wide = _matrix(batch.column("sketch")).reshape(batch.num_rows, BANDS, ROWS).astype(_U)
                    key = np.zeros(wide.shape[:2], _U)
                    for r in range(ROWS):
                        key = key << _U(16) | wide[:, :, r] if ROWS == 4 else key * _U(0xD1342543DE82EF95) + wide[:, :, r]
                    key = _finish(key ^ turn[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))], ["bucket", "node", "band"])

    members = nodes.select("node", "sketch").mapInArrow(buckets, "bucket bigint, node bigint, band int")
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1").select("bucket", "leader")
    shared = kept(members.join(leaders, "bucket"), "buckets")

    stars = shared.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = _estimated(stars, nodes.select("node", "n", "sketch"), threshold)
    best = kept(near.groupBy("b").agg(F.max_by("a", F.struct("j", "a")).alias("a")).select("a", "b"), "best")

    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "digest", F.col("least").alias("doc_id"))
    wanted = kept(wanted, "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    chosen = wanted.select("doc_id").where("doc_id is not null").distinct()
    texts = source.join(F.broadcast(chosen) if small else chosen, "doc_id", "left_semi")
    if not wanted.where("doc_id is null").isEmpty():
        texts = texts.unionByName(source.where("doc_id is null"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in pieces(batch, "ss_text"):
                made = shingle_sets(part.column("ss_text"), width)
                raw, wide = [s.tobytes() for s in made], []
                for items_ in made:
                    registers = sketch(items_, WIDE) if len(items_) else None
                    wide.append(None if registers is None else registers[: BANDS * ROWS].tobytes() + coarsened(registers).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw]), pa.array(raw, pa.binary()), pa.array(wide, pa.binary())], ["digest", "items", "wide"])

    sets = texts.mapInArrow(items, "digest binary, items binary, wide binary").join(wanted.select("node", "digest"), "digest")
    sets = kept(sets.groupBy("node").agg(F.first("items").alias("items"), F.first("wide").alias("wide")), "sets")

    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = kept(_verified(best, sets, threshold), "links")
    labels = components(links)
    wide = sets.select("node", "wide", (F.octet_length("items") / 8).cast("bigint").alias("n"))
    blocks = kept(_blocks(shared), "blocks")
    for partners in PARTNERS:
        found = kept(_crossing(blocks, labels, wide, threshold, partners), "crossing")
        pairs = found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        links = kept(_verified(pairs, sets, threshold), "links")
        if not links.isEmpty():
            labels = joined_components(labels, links)
        tested = tested.unionByName(found.where("a is not null").select("a", "b"))
        blocks = blocks.join(found.where("bucket is not null").select(*GROUP), GROUP, "left_semi")

    of_node = nodes.select("node", "digest", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_node.groupBy("label").agg(F.min("least").alias("component_id"))
    of_digest = of_node.join(smallest, "label").select("digest", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_digest, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = materialise(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")), "near")
    for table in made:  # only the verdicts are read from now on
        discard(table)
    return out
