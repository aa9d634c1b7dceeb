"""Packing in the order of a space-filling curve.

Each document's token counts, hashed into signed dimensions, are projected to a few; the point's Hilbert key orders
the documents, so neighbours in a sequence are alike.  The tokenized table is written once (ids as 16-bit integers
where the vocabulary allows it), range-partitioned and sorted by (key, doc_id), and each range is laid out end to end
and cut every `length` tokens.  Only the last sequence of a range may be short; it is cut at its largest powers of two down to
`least`, the rest being padded.  Equal keys (groups of copies) are split by doc_id, so no range has to hold a whole group.
Sequence ids are (range, number) pairs in one integer.  Null text: only the end token.
Repeated rows are packed as often as they stand there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestar.llm import bpe
from lodestar.llm.common import materialise, pieces, python_ready, text_of

#: Bytes of an Arrow batch, some less than pieces() cuts at.
BATCH = 7 << 20
LENGTH, END_ID, HASHED, DIMENSIONS, BITS, LEAST = 1024, 0, 256, 4, 8, 64
PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def projection(vocabulary: int, hashed: int = HASHED, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Row i: the signed hashed dimension of token i, projected."""
    with np.errstate(over="ignore"):
        h = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    basis = np.random.default_rng(7).standard_normal((hashed, dimensions)).astype(np.float32)
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    return basis[(h >> np.uint64(40)).astype(np.int64) % hashed] * sign[:, None]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (rows; coordinates below 2**bits) on the Hilbert curve."""
    axes = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the top
        bit, low = 1 << level, (1 << level) - 1
        for d in range(len(axes)):
            high = (axes[d] & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[d] = axes[d] ^ swap if d else axes[0]
    for d in range(1, len(axes)):  # Gray code
        axes[d] ^= axes[d - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    python_ready(docs.sparkSession, BATCH)
    source = docs.select("doc_id", text_of().alias("cp_text"))
    id_type = source.schema[0].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.load(tokenizer)
        size = own.tokenizer.get_vocab_size()
        rows, kind = np.ascontiguousarray(projection(size).T, np.float64), np.dtype("<u2" if size <= 1 << 16 else "<u4")
        for batch in batches:
            for part in pieces(batch, "cp_text"):
                flat, at = own.encode(part.column("cp_text"))
                n = np.diff(at)
                sums = np.zeros((part.num_rows, len(rows)))
                full = np.flatnonzero(n)
                if len(full):
                    for d, row in enumerate(rows):
                        sums[full, d] = np.add.reduceat(row[flat], at[:-1][full])
                mean = sums / np.maximum(n, 1)[:, None]
                grid = np.minimum((1 / (1 + np.exp(-10 * mean)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                small, end = flat.astype(kind), np.array([END_ID], kind).tobytes()
                ids = [small[at[i] : at[i + 1]].tobytes() + end for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hilbert_key(grid)), pa.array(n + 1), pa.array([kind.itemsize] * part.num_rows, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "curve", "n", "width", "ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, position = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ids if i == 0 else pa.int64()) for i in range(7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        ids = None
        for batch in batches:
            for part in pieces(batch, "ids"):
                ids = part.column("doc_id").type
                rows = held
                for doc, width, raw in zip(part.column("doc_id").to_pylist(), part.column("width").to_pylist(), part.column("ids").to_pylist(), strict=True):
                    tokens, start = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                    while start < len(tokens):
                        take = min(length - position % length, len(tokens) - start)
                        rows.append((doc, start, take, zlib.crc32(tokens[start : start + take]), len(tokens), first + position // length, position % length, tokens[start : start + take]))
                        start, position = start + take, position + take
                last = first + position // length  # not full yet
                ready, held = [r for r in rows if r[5] < last], [r for r in rows if r[5] >= last]
                if ready:
                    yield table(ready)
        if held:
            yield table(shorten(held, first + position // length, position % length))

    def shorten(rows: list[tuple], sequence: int, left: int) -> list[tuple]:
        """Cut the open sequence of a range into ones of powers of two, while they have at least `least` tokens."""
        bounds, at = [], 0
        while (size := 1 << (left - at).bit_length() - 1 if left > at else 0) >= least:
            bounds.append(at := at + size)
        out = []
        for doc, start, _, _, total, _, offset, tokens in rows:
            done = 0
            while done < len(tokens):
                place = offset + done
                k = sum(place >= b for b in bounds)
                take = min(len(tokens) - done, (bounds[k] if k < len(bounds) else left) - place)
                out.append((doc, start + done, take, zlib.crc32(tokens[done : done + take]), total, sequence + k, place - (bounds[k - 1] if k else 0), None))
                done += take
        return out

    tokens = materialise(source.mapInArrow(tokenize, f"doc_id {id_type}, curve bigint, n bigint, width int, ids binary"), "curve")
    return tokens.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "n").mapInArrow(lay, PIECES.format(id=id_type))
