"""Language-model scores from Brown classes.

Every training word has a class of its own choosing: the end of a text is class 0, and exchange clustering deals all other words,
whatever their count, over the rest.  The number of classes grows with the vocabulary (CLASSES * V ** 0.25).

1. Texts become chunks: arrays of local word numbers with the sorted hashes of the chunk's words.  The table is bucketed
   by a chunk number that hashes to the writing task's own bucket, so that it is never shuffled.
2. Words live in shards, ranges of their hashes with about SHARD_WORDS words each.  Chunks send each shard its words'
   counts, and later the counts of the classes before and after them, already summed within the chunk; a shard's task
   adds them up as they stream in, and answers each chunk's question for a word's count or class likewise.
3. A half pass moves the words of every second shard, each to the class that raises the class-bigram likelihood most.
   A shard's task gets the shard's words first and counts one part of them at a time, in a table of at most CELLS cells
   that every chunk's counts are added to in place, so that what it holds depends on neither corpus nor vocabulary.
   Only the class-by-class matrix comes to the driver.  Passes end when the mutual information of neighbouring
   classes settles (a whole pass gains less than SETTLED of it), or falls, or after `passes`.

P(w | before) = weight * P(class(w) | class(before)) * count(w) / count(class(w)) + (1 - weight) * (count(w) + 1) / (N + V + 1),
with transition counts smoothed by `smooth` pseudo-counts of the class's overall share.  A text starts after an end; words
without a training count stand in the last class as context.

Words are known by 63-bit hashes.  Null or empty text: one token, its end.  Without training texts every token is
unknown.  A null doc_id counts as an empty one.  Repeated rows count as often as they stand there.  Other columns of docs
are not read.
"""

from __future__ import annotations

import logging
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialise, pieces, python_ready, scratch, text_of

CLASSES, PASSES, SETTLED, WEIGHT, SMOOTH, SHARD_WORDS = 2.0, 4, 0.05, 0.8, 1.0, 200_000
#: Entries that a shard's task adds up at once (beside one for each of its words), and whose scores it holds at once.
HELD, BLOCK = 1_000_000, 50_000
#: Cells (word by context) that a shard's task counts at once, 8 bytes each.
CELLS = 8_000_000
#: Bytes of an Arrow batch: some less than pieces() cuts at, so that a batch of texts is one chunk, and chunks come one by one.
BATCH = 7 << 20
log = logging.getLogger(__name__)


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers of all texts in a row, the distinct words, and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    flat, at = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    at = at - at[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(real)])[at]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist(), at


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in words), np.int64, len(words))


def _held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids], bool)


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark gives 64-bit numbers: their Murmur3 hash with seed 42, modulo."""
    u = np.uint32
    with np.errstate(over="ignore"):
        turn = lambda x, r: x << u(r) | x >> u(32 - r)
        raw, h = numbers.astype(np.int64).view(np.uint64), np.full(len(numbers), 42, u)
        for k in (raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)):
            h = turn(h ^ turn(k.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        return (h ^ h >> u(16)).view(np.int32).astype(np.int64) % buckets


def _numbers(partition: int, buckets: int) -> Iterator[int]:
    """Chunk numbers of a task, all of one bucket."""
    first = partition << 36
    while True:
        some = np.arange(first, first + 64 * buckets)
        yield from some[bucket_of(some, buckets) == partition % buckets].tolist()
        first += 64 * buckets


CHUNK = "chunk bigint, ids array<{id}>, held binary, lengths binary, flow binary, words binary, train binary, ends bigint, pairs bigint, low array<bigint>"


def chunked(source: DataFrame, buckets: int) -> DataFrame:
    """One row for some MB of text: doc ids, which are held out (bytes), tokens of each text (32 bits), the texts' tokens as
    local numbers (32 bits; 0: end, else place in `words` plus 1), the words' sorted hashes (64 bits), training
    counts by local number (32 bits), training texts, number of words, and the hashes in the lowest 1/256 of their range."""
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(TaskContext.get().partitionId(), buckets)
        for batch in batches:
            for part in pieces(batch, "bc_text"):
                index, words, at = _words(part.column("bc_text"))
                known, local = np.unique(_hashes(words), return_inverse=True)
                lengths = np.diff(at) + 1
                flow = np.zeros(len(index) + part.num_rows, np.uint32)
                inside = np.ones(len(flow), bool)
                inside[np.cumsum(lengths) - 1] = False
                flow[inside] = 1 + local[index]
                held = _held_out(part.column("doc_id").to_pylist())
                train = np.bincount(flow[np.repeat(~held, lengths)], minlength=len(known) + 1)
                ids = part.column("doc_id")
                row = {
                    "chunk": pa.array([next(numbers)], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "held": [held.tobytes()], "lengths": [lengths.astype(np.uint32).tobytes()],
                    "flow": [flow.tobytes()], "words": [known.tobytes()], "train": [train.astype(np.uint32).tobytes()], "ends": pa.array([train[0]], pa.int64()), "pairs": pa.array([len(known)], pa.int64()),
                    "low": pa.array([known[known < 1 << 55]], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in row.values()], list(row))

    return source.mapInArrow(run, CHUNK.format(id=id_type))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = list(zip(batch.schema.names, batch.columns, strict=True))
        yield from ({name: c[i].as_py() for name, c in columns} for i in range(batch.num_rows))  # a row's copies at a time


def _cuts(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's words begin and end; a shard is the value of a hash's top `bits` of 63."""
    return np.append(np.searchsorted(words, np.arange(1 << bits, dtype=np.int64) << 63 - bits), len(words))


def _sharded(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


def _add(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of each."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, sums, len(keys)).astype(np.int64)


def tally(chunks: DataFrame, bits: int) -> DataFrame:
    """shard, words (sorted hashes), n (64-bit training counts, over 0)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, n = np.frombuffer(row["words"], np.int64), np.frombuffer(row["train"], np.uint32)[1:]
            words, n = words[n > 0], n[n > 0].astype(np.int64)
            cuts = _cuts(words, bits)
            use = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), pa.array([words[cuts[s] : cuts[s + 1]].tobytes() for s in use], pa.binary()), pa.array([n[cuts[s] : cuts[s + 1]].tobytes() for s in use], pa.binary())], ["shard", "words", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(_rows(batches), lambda r: r["shard"]):
            words, n, waiting = [], [], 0
            for row in rows:
                words.append(np.frombuffer(row["words"], np.int64))
                n.append(np.frombuffer(row["n"], np.int64))
                waiting += len(words[-1])
                if waiting > HELD:
                    words, n, waiting = *([x] for x in _add(np.concatenate(words), np.concatenate(n))), 0
            words, n = _add(np.concatenate(words), np.concatenate(n))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([n.sum()], pa.int64())], ["shard", "words", "n", "v", "total"])

    sent = chunks.select("words", "train").mapInArrow(send, "shard bigint, words binary, n binary")
    return _sharded(sent).mapInArrow(add, "shard bigint, words binary, n binary, v bigint, total bigint")


def _frequent(counts: DataFrame, most: int) -> dict[int, int]:
    """The `most` words of the largest counts, in that order, with 1, 2, 3, ..."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, n = np.frombuffer(row["words"], np.int64), np.frombuffer(row["n"], np.int64)
            use = np.lexsort((words, -n))[:most]
            yield pa.RecordBatch.from_arrays([pa.array(words[use]), pa.array(n[use])], ["word", "n"])

    rows = counts.select("words", "n").mapInArrow(best, "word bigint, n bigint").orderBy(F.desc("n"), "word").limit(most).collect()
    return {r["word"]: i + 1 for i, r in enumerate(rows)}


def answer(chunks: DataFrame, state: DataFrame, bits: int, value: np.dtype, missing: int, shards: tuple[int, int] = (0, 1)) -> DataFrame:
    """chunk, shard, values: of each word of the chunk in the shards `shards` (remainder, divisor), in the order of hashes.
    state: shard, words, values.  A shard's state comes first, so the chunks' questions stream past it."""
    remainder, divisor = shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = np.frombuffer(row["words"], np.int64)
            cuts = _cuts(words, bits)
            use = [s for s in np.flatnonzero(np.diff(cuts)).tolist() if s % divisor == remainder]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(use), pa.int64()), pa.array(use, pa.int64()), pa.array([words[cuts[s] : cuts[s + 1]].tobytes() for s in use], pa.binary())], ["chunk", "shard", "words"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known, values = None, np.zeros(0, np.int64), np.zeros(0, value)
        for row in _rows(batches):
            if row["shard"] != shard:
                shard, known, values = row["shard"], np.zeros(0, np.int64), np.zeros(0, value)
            words = np.frombuffer(row["words"], np.int64)
            if row["values"] is not None:
                known, values = words, np.frombuffer(row["values"], value)
                continue
            out = np.full(len(words), missing, value)
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                out = np.where(known[at] == words, values[at], out).astype(value)
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([shard], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["chunk", "shard", "values"])

    asked = chunks.select("chunk", "words").mapInArrow(ask, "chunk bigint, shard bigint, words binary").withColumn("values", F.lit(None).cast("binary"))
    told = state.select(F.lit(-1).cast("long").alias("chunk"), "shard", "words", "values")
    both = told.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("values").isNull())
    return both.mapInArrow(reply, "chunk bigint, shard bigint, values binary")


def _told(chunks: DataFrame, buckets: int, **answers: DataFrame | None) -> DataFrame:
    """chunks with the answers for each, as arrays of (shard, values); the chunks stay where they are."""
    for name, rows in answers.items():
        if rows is None:
            chunks = chunks.withColumn(name, F.array().cast("array<struct<shard:bigint,values:binary>>"))
        else:
            lists = rows.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("shard", "values")).alias(name))
            chunks = chunks.join(lists.hint("shuffle_hash"), "chunk", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<shard:bigint,values:binary>>")))
    return chunks


def _values(row: dict, name: str, words: np.ndarray, bits: int, default: np.ndarray) -> np.ndarray:
    """Values by local number; 0 is the end."""
    out, cuts = default.copy(), _cuts(words, bits)
    for part in row[name]:
        own = np.frombuffer(part["values"], default.dtype)
        out[1 + cuts[part["shard"]] : 1 + cuts[part["shard"] + 1]] = own
    return out


def _first_classes(words: np.ndarray, frequent: dict[int, int], width: int) -> np.ndarray:
    """Where exchange starts: the most frequent words have a class each, all others the last one."""
    out = np.full(len(words) + 1, width - 1, np.uint16)
    out[0] = 0
    if frequent and len(words):
        top = np.array(sorted(frequent), np.int64)
        at = np.searchsorted(words, top)
        hit = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == top)
        out[1 + at[hit]] = [frequent[w] for w in top[hit].tolist()]
    return out


def part_bits(bits: int, width: int, most: int) -> int:
    """Further bits of a hash that cut a shard of `most` words into parts of about CELLS cells at most."""
    return int(np.ceil(np.log2(max(1, most * 2 * width / CELLS))))


def contexts(told: DataFrame, frequent: dict[int, int], width: int, bits: int, shards: tuple[int, int], finer: int = 0) -> DataFrame:
    """Of each chunk and part (`finer` further bits) of a shard to move: the words, their classes, and the counts of classes after
    them (code: class) and before them (code: width + class), word by word.  Shard -1 has the chunk's class-by-class
    counts instead."""
    code = np.uint8 if 2 * width <= 256 else np.uint16
    remainder, divisor = shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = np.frombuffer(row["words"], np.int64)
            classes = _values(row, "classes", words, bits, _first_classes(words, frequent, width)).astype(np.int64)
            flow, held, lengths = np.frombuffer(row["flow"], np.uint32).astype(np.int64), np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], np.uint32)
            use = np.repeat(~held, lengths)
            before, after = np.concatenate([[0], flow[:-1]])[use], flow[use]
            out: list[tuple] = [(-1, 0, b"", b"", b"", b"", np.bincount(classes[before] * width + classes[after], minlength=width * width).tobytes(), b"")]
            cuts, place = _cuts(words, bits + finer), np.full(len(words) + 1, -1)
            moving = [p for p in np.flatnonzero(np.diff(cuts)).tolist() if (p >> finer) % divisor == remainder]
            chosen = np.concatenate([np.zeros(0, np.int64), *(np.arange(cuts[p], cuts[p + 1]) for p in moving)])
            place[1 + chosen] = np.arange(len(chosen))
            cells = []
            for own, other, shift in ((before, after, 0), (after, before, width)):
                at = place[own]
                cells.append(at[at >= 0] * (2 * width) + shift + classes[other[at >= 0]])
            cells = np.concatenate(cells)
            cells.sort()
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
            n, full = np.diff(np.append(starts, len(cells))), cells[starts]
            del cells
            entries = np.bincount(full // (2 * width), minlength=len(chosen)) if len(chosen) else np.zeros(0, np.int64)
            codes = (full % (2 * width)).astype(code)
            ends, done = np.concatenate([[0], np.cumsum(entries)]), 0
            for p in moving:
                own = slice(done, done + cuts[p + 1] - cuts[p])
                done = own.stop
                seen = np.flatnonzero(entries[own])  # words of held-out texts alone have no entries
                if len(seen):
                    part = slice(ends[own.start], ends[own.stop])
                    large = np.flatnonzero(n[part] > 254)
                    out.append((p >> finer, p, words[cuts[p] : cuts[p + 1]][seen].tobytes(), classes[1 + cuts[p] : 1 + cuts[p + 1]][seen].astype(np.uint16).tobytes(), entries[own][seen].astype(np.uint16).tobytes(), codes[part].tobytes(), np.minimum(n[part], 255).astype(np.uint8).tobytes(), n[part][large].tobytes()))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(2)), *(pa.array([r[k] for r in out], pa.binary()) for k in range(2, 8))], ["shard", "part", "words", "classes", "entries", "codes", "n", "large"])

    return told.select("words", "flow", "held", "lengths", "classes").mapInArrow(run, "shard bigint, part bigint, words binary, classes binary, entries binary, codes binary, n binary, large binary")


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(owner: np.ndarray, codes: np.ndarray, n: np.ndarray, classes: np.ndarray, bigram: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most; 0 is the end's own, and empty classes stay empty.

    As all words of a half pass move at once, gains are those of a small part of a word's tokens: the log probabilities of
    its neighbours' classes given each class, which change only as far as classes do.  (Gains of whole words would
    draw all of them into an empty class at once.)
    owner: sorted word numbers 0.. of the entries; codes: class after, or width + class before; n: how often.
    """
    width = len(bigram)
    share = bigram.sum(axis=0) / max(bigram.sum(), 1)
    beside = [np.log((x + share[None, :] + 1e-9) / (x.sum(axis=1, keepdims=True) + 1 + 1e-9 * width)) for x in (bigram, bigram.T)]
    table = np.concatenate(beside, axis=1).T.astype(np.float32)  # code, class
    closed = (bigram.sum(axis=1) + bigram.sum(axis=0)) == 0
    out, starts, first = classes.copy(), np.searchsorted(owner, np.arange(len(classes) + 1)), 0
    while first < len(classes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK, side="right")) - 1)
        a, b = starts[first], starts[last]
        full = np.flatnonzero(np.diff(starts[first : last + 1]))
        score = np.zeros((last - first, width))
        score[full] = np.add.reduceat(table[codes[a:b]] * n[a:b, None], starts[first + full] - a, axis=0, dtype=np.float64)
        score[np.arange(last - first), classes[first:last]] += 1e-4  # ties stay
        score[:, closed] = -np.inf
        score[:, 0] = -np.inf
        out[first:last] = score.argmax(axis=1)
        first = last
    return out


def exchange(sent: DataFrame, counts: DataFrame, bigram: np.ndarray, bits: int, shards: tuple[int, int], finer: int = 0) -> DataFrame:
    """shard, words, values: the classes of the words of the moved shards.  counts: shard, words (all training words)."""
    width = len(bigram)
    code = np.uint8 if 2 * width <= 256 else np.uint16
    remainder, divisor = shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(_rows(batches), lambda r: r["shard"]):
            words = np.frombuffer(next(rows)["words"], np.int64)  # the shard's own row comes first
            cuts, out = _cuts(words, bits + finer), np.zeros(len(words), np.uint16)
            for p, parts in groupby(rows, lambda r: r["part"]):
                known = words[cuts[p] : cuts[p + 1]]
                classes, total = np.zeros(len(known), np.uint16), np.zeros(len(known) * 2 * width, np.int64)
                for row in parts:
                    n = np.frombuffer(row["n"], np.uint8).astype(np.int64)
                    n[n == 255] = np.frombuffer(row["large"], np.int64)
                    at = np.searchsorted(known, np.frombuffer(row["words"], np.int64))
                    classes[at] = np.frombuffer(row["classes"], np.uint16)
                    # A chunk names each cell once.
                    total[np.repeat(at * (2 * width), np.frombuffer(row["entries"], np.uint16)) + np.frombuffer(row["codes"], code)] += n
                full = np.flatnonzero(total)
                out[cuts[p] : cuts[p + 1]] = best_classes(full // (2 * width), full % (2 * width), total[full], classes, bigram)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["shard", "words", "values"])

    own = counts.where((F.col("shard") % divisor) == remainder).select("shard", F.lit(-1).cast("long").alias("part"), "words", *(F.lit(None).cast("binary").alias(c) for c in ("classes", "entries", "codes", "n", "large")))
    both = own.unionByName(sent.where("shard >= 0")).repartition("shard").sortWithinPartitions("shard", "part")
    return both.mapInArrow(run, "shard bigint, words binary, values binary")


def _matrix(sent: DataFrame, width: int) -> np.ndarray:
    """The class-by-class counts of all chunks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for row in _rows(batches):
            total += np.frombuffer(row["codes"], np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    cells = sent.where("shard = -1").select(F.col("n").alias("codes")).mapInArrow(add, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width * width)
    for r in cells:
        out[r["cell"]] = r["n"]
    return out.reshape(width, width)


def information(bigram: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats a token."""
    total = max(bigram.sum(), 1)
    return float((_gain(bigram).sum() - _gain(bigram.sum(axis=1)).sum() - _gain(bigram.sum(axis=0)).sum()) / total + np.log(total))


def transitions(bigram: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """P(class after | class before), a row for each class before, and the tokens of each class."""
    in_class = bigram.sum(axis=0)
    share = in_class / max(in_class.sum(), 1)
    return (bigram + smooth * share[None, :]) / (bigram.sum(axis=1, keepdims=True) + smooth), in_class


def score(docs: DataFrame, width: int | None = None, passes: int = PASSES, weight: float = WEIGHT, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.  width: number of classes, from the
    vocabulary unless given."""
    spark = docs.sparkSession
    python_ready(spark, BATCH)
    source = docs.select("doc_id", text_of().alias("bc_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    buckets = max(1, min(source.rdd.getNumPartitions(), 50_000))
    name = f"lodestar_chunks_{uuid.uuid4().hex}"
    chunked(source, buckets).write.bucketBy(buckets, "chunk").option("path", scratch(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    try:
        low = chunks.select(F.explode("low").alias("w")).agg(F.count_distinct("w")).first()[0]
        bits = max(3, int(np.ceil(np.log2(max(1, low * 256 / SHARD_WORDS)))))
        counts = materialise(tally(chunks, bits), "counts")
        sums = counts.agg(F.sum("total").alias("n"), F.sum("v").alias("v"), F.max("v").alias("most")).first()
        ends = chunks.agg(F.sum("ends")).first()[0] or 0
        tokens, types = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
        width = width or max(4, round(CLASSES * types**0.25))
        frequent, finer = _frequent(counts, width - 2), part_bits(bits, width, sums["most"] or 0)

        answers: dict[int, DataFrame] = {}
        gathered = lambda: answers[0].unionByName(answers[1]) if len(answers) == 2 else answers.get(0)
        history: list[float] = []
        for turn in range(2 * passes + 1):
            half = (turn % 2, 2)
            sent = materialise(contexts(_told(chunks, buckets, classes=gathered()), frequent, width, bits, half, finer), "contexts")
            bigram = _matrix(sent, width)
            history.append(information(bigram))
            log.info("half pass %d: %d classes, mutual information %.4f", turn, width, history[-1])
            if turn == 2 * passes or turn > 2 and history[-1] - history[-3] <= SETTLED * abs(history[-1]):
                break
            state = materialise(exchange(sent, counts, bigram, bits, half, finer), "classes")
            discard(sent)
            answers[turn % 2] = materialise(answer(chunks, state, bits, np.dtype(np.uint16), width - 1, half), "answers")

        move, in_class = transitions(bigram, smooth)
        factor = weight * move / np.maximum(in_class, 1)[None, :]  # times the word's count
        base = 1 / (tokens + types + 1)
        told = _told(chunks, buckets, classes=gathered(), counts=answer(chunks, counts.select("shard", "words", F.col("n").alias("values")), bits, np.dtype(np.int64), 0))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _rows([batch.select(["words", "flow", "held", "lengths", "classes", "counts"])])
                for i, row in enumerate(rows):
                    words = np.frombuffer(row["words"], np.int64)
                    classes = _values(row, "classes", words, bits, _first_classes(words, frequent, width)).astype(np.int64)
                    n = _values(row, "counts", words, bits, np.zeros(len(words) + 1, np.int64))
                    n[0] = ends
                    flow, lengths = np.frombuffer(row["flow"], np.uint32), np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
                    at, after = np.cumsum(lengths) - lengths, classes[flow]
                    before = np.concatenate([[0], after[:-1]])  # the first of each text follows an end
                    plain = np.log10((n + 1) * base)
                    model = np.log10(factor[before, after] * n[flow] + ((1 - weight) * base * (n + 1))[flow])
                    sums = [np.add.reduceat(x, at) for x in ((n > 0).astype(np.int64)[flow], plain[flow], model)]
                    yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(np.frombuffer(row["held"], bool)), pa.array(lengths), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        judged = told.select("ids", "words", "flow", "held", "lengths", "classes", "counts").mapInArrow(judge, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
        out = materialise(judged, "scores")
    finally:
        python_ready(spark)
        discard(chunks)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
