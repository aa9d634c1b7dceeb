"""Substring dedup by content-defined chunking.

A gear hash (32 bits, so a window of 32 bytes) rolls over each text with A-Z in lower case and white space as spaces.
A word begins a chunk where the hash of the bytes before it falls below `1/mean` of its range, and after at most
`longest` words; so cut points follow the content and return soon after an insertion.  Chunks are compared by a 64-bit
digest of their bytes.  Of each digest one occurrence stays: the first in the smallest doc_id.  The others are
repeated, and runs of repeated chunks with at least `least` words are spans to remove.  As `least` is more than a
chunk can hold, one collision of digests cannot make a span.

Digests are reduced with partial aggregation and only repeated ones meet their occurrences again, in a plain shuffled
join, which adaptive execution splits where a digest is hot.  Spans are gathered per document, so by no more than its text.
Null or empty text has no chunks; rows with a null doc_id neither remove anything nor lose anything; repeated rows of
the same doc_id are one document, and texts that differ under one doc_id are compared at the same positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, python_ready, text_of

MEAN, LONGEST, LEAST = 6, 12, 20
WINDOW = 32
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0  # the padding between texts leaves no trace
_NORMAL = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b or 1 for b in range(256))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + G[data[i]] in 32 bits at every place, by doubling the span that each sum covers."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is evaluated before it is added
        span *= 2
    return h


def chunks(texts: list[str], mean: int = MEAN, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' chunks: text number, digest, first word, number of words."""
    import xxhash

    raw = [t.encode("utf-8", "surrogatepass").translate(_NORMAL) for t in texts]
    buffer = bytes(WINDOW) + bytes(WINDOW).join(raw) + bytes(WINDOW)
    data = np.frombuffer(buffer, np.uint8)
    first = WINDOW + np.cumsum([0, *(len(r) + WINDOW for r in raw)])[:-1]
    blank = (data == 32) | (data == 0)
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    owner = np.searchsorted(first, start, side="right") - 1
    if not len(start):
        return owner, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.ones(len(start), bool)
    opens[1:] = owner[1:] != owner[:-1]
    cut = opens | (gear(data)[start - 1] < np.uint32((1 << 32) // mean))
    place = np.arange(len(start))
    cut |= (place - np.maximum.accumulate(np.where(cut, place, 0))) % longest == 0
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(start)))
    view = memoryview(buffer)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[head].tolist(), end[head + size - 1].tolist(), strict=True)), np.uint64, len(head))
    number = place - np.maximum.accumulate(np.where(opens, place, 0))
    return owner[head], digest.view(np.int64), number[head], size


def _occurrences(docs: DataFrame, once: bool, mean: int, longest: int) -> DataFrame:
    """digest, doc_id, place (first word * 256 + words), again (not the first of its digest in the document)."""
    source = docs.where("doc_id is not null").select("doc_id", text_of().alias("gc_text"))
    id_type = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "gc_text", 4 << 20):
                owner, digest, word, size = chunks(part.column("gc_text").to_pylist(), mean, longest)
                order = np.lexsort((word, digest, owner))
                again = np.zeros(len(owner), bool)
                again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
                use = np.flatnonzero(~again) if once else np.arange(len(owner))
                columns = [pa.array(digest[use]), part.column("doc_id").take(pa.array(owner[use]))]
                if once:
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((word << 8 | size).astype(np.int64)), pa.array(again)], ["digest", "doc_id", "place", "again"])

    return source.mapInArrow(run, f"digest bigint, doc_id {id_type}" + ("" if once else ", place bigint, again boolean"))


def repeated_spans(docs: DataFrame, mean: int = MEAN, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """One row for each span to remove: doc_id, first_word, n_words, n_chunks (long), first_doc_id (the smallest
    doc_id that keeps the span's first chunk)."""
    if not 0 < longest < 256:
        raise ValueError("a place has room for chunks of 1 to 255 words")
    python_ready(docs.sparkSession)
    seen = _occurrences(docs, True, mean, longest).groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
    # A chunk that repeats inside one document only is told by `again` alone.
    joined = _occurrences(docs, False, mean, longest).join(seen.where("first_doc_id <> last").drop("last"), "digest", "left")
    hits = joined.where("again or doc_id <> first_doc_id").select("doc_id", "place", F.coalesce("first_doc_id", "doc_id").alias("first_doc_id"))
    lists = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("place", "first_doc_id"))).alias("hits"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                at: dict[int, tuple] = {}
                for hit in found:
                    word, size = hit["place"] >> 8, hit["place"] & 255
                    if word not in at or hit["first_doc_id"] < at[word][1]:
                        at[word] = size, hit["first_doc_id"]
                open_at = None
                for word in sorted(at):
                    size, other = at[word]
                    if open_at and open_at[0] + open_at[1] == word:
                        open_at[1] += size
                        open_at[2] += 1
                    else:
                        if open_at and open_at[1] >= least:
                            out.append((doc, *open_at))
                        open_at = [word, size, 1, other]
                if open_at and open_at[1] >= least:
                    out.append((doc, *open_at))
            kinds = [batch.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), batch.column("doc_id").type]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "first_word", "n_words", "n_chunks", "first_doc_id"])

    return lists.mapInArrow(runs, f"doc_id {id_type}, first_word bigint, n_words bigint, n_chunks bigint, first_doc_id {id_type}")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of the spans cut from their texts, each with the white space after it.  Same columns."""
    import re

    python_ready(docs.sparkSession)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lists = spans.groupBy(F.col("doc_id").alias("gc_id")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("gc_spans"))
    joined = docs.join(lists, docs.doc_id == lists.gc_id, "left").drop("gc_id")
    schema, at = docs.schema, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("gc_spans").to_pylist()):
                if spans and texts[i]:
                    start = [m.start() for m in word.finditer(texts[i])] + [len(texts[i])]
                    text, left = [], 0
                    for s in sorted(spans, key=lambda s: s["first_word"]):
                        if s["first_word"] + s["n_words"] < len(start):
                            text.append(texts[i][left : start[s["first_word"]]])
                            left = start[s["first_word"] + s["n_words"]]
                    texts[i] = "".join([*text, texts[i][left:]])
            columns = [batch.column(c) for c in schema.names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(cut, schema)
