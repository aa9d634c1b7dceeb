"""Token counts through a digest cache.

Cache: a Parquet table (digest, version, n_tokens) in a shared folder.  Texts are joined to it by the SHA-256 of their
UTF-8 bytes and the version, a digest of the tokenizer's file and this module's rules.  Only distinct misses are
encoded; their counts are appended.  The normalisation is that null counts as empty: this tokenizer tells any two
other texts apart.  Texts are reduced to one for each digest before the shuffle, so a hot text travels once from each task;
the final join carries digests only.  A task that runs again gives the same rows, and the cache is read with one count
for each digest, so an append that is repeated changes nothing.
Null and empty texts have 0 tokens.  Repeated rows yield repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, python_ready, text_of

LIMIT = 4096
CACHE_WORDS = 450_000
SCHEMA = "digest binary, version string, n_tokens bigint"
_META = "▁"  # stands for a space in the vocabulary


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"count rules 1").hexdigest()[:16]


class PieceCounter:
    """Tokens of texts by sentencepiece.

    No piece of such a vocabulary goes on past a space after a non-space (checked), and none holds a line feed, so the
    words between single spaces or line feeds are encoded apart, each once for a batch or while it is cached.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        probe = [" a  b", "ﬁ　\t", "a\nb"]  # the normaliser has to leave texts alone
        self.apart = not any(_META in p.lstrip(_META) or "\n" in p for p in vocabulary) and all(self.processor.decode(self.processor.encode(x)) == x for x in probe)
        self.kept: dict[bool, list[dict[str, int]]] = {True: [{}, {}], False: [{}, {}]}

    def _encode(self, words: list[str], space: bool) -> list[int]:
        if space:
            return list(map(len, self.processor.encode(words, num_threads=1)))
        return [len(x) - 2 for x in self.processor.encode(["\n" + w for w in words], num_threads=1)]  # a space and a line feed come first

    def _many(self, words: list[str], space: bool) -> list[int]:
        kept = self.kept[space]
        if len(kept[0]) > CACHE_WORDS:
            kept[:] = {}, kept[0]
        known, older = kept
        missing = [w for w in words if w not in known]
        new = [w for w in missing if w not in older]
        known.update((w, older[w]) for w in missing if w in older)
        known.update(zip(new, self._encode(new, space), strict=True))
        return list(map(known.__getitem__, words))

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.apart:
            return np.array(list(map(len, self.processor.encode(texts.to_pylist(), num_threads=1))), np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        at = np.asarray(lists.offsets, dtype=np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        feed = np.fromiter((w == "\n" for w in words), bool, len(words))
        bad = np.fromiter((not w or _META in w for w in words), bool, len(words))
        first = np.zeros(len(index), bool)
        first[at[:-1]] = True
        bare = np.zeros(len(index), bool)
        bare[1:] = feed[index][:-1]
        bare &= ~feed[index]
        wrong = bad[index] | (first & feed[index])
        slow = np.add.reduceat(wrong.astype(np.int64), at[:-1]) > 0
        spaced = np.zeros(len(words), np.int64)
        good = [i for i in range(len(words)) if not (bad[i] or feed[i])]
        spaced[good] = self._many([words[i] for i in good], True)
        spaced[feed] = 1
        alone = np.zeros(len(words), np.int64)
        use = [i for i in np.unique(index[bare]).tolist() if not bad[i]]
        alone[use] = self._many([words[i] for i in use], False)
        out = np.add.reduceat(np.where(bare, alone[index], spaced[index]), at[:-1])
        for i in np.flatnonzero(slow).tolist():
            out[i] = len(self.processor.encode(texts[i].as_py(), num_threads=1))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """All columns of docs, and n_bytes, n_tokens (long), over_limit (boolean).

    tokenizer: path of a sentencepiece .model on every machine.  cache: folder of the cache table; made if missing.
    """
    spark = docs.sparkSession
    python_ready(spark)
    version = version_of(tokenizer)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    known = lambda: spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
    digest = F.unhex(F.sha2(text_of().cast("binary"), 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for part in pieces(batch, "tc_text"):
                counts = own.counts(part.column("tc_text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * part.num_rows), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    distinct = docs.select(digest.alias("digest"), text_of().alias("tc_text")).groupBy("digest").agg(F.first("tc_text").alias("tc_text"))
    misses = distinct.join(known().select("digest").hint("shuffle_hash"), "digest", "left_anti")
    misses.mapInArrow(encode, SCHEMA).write.mode("append").parquet(cache)

    counts = known().groupBy(F.col("digest").alias("tc_digest")).agg(F.max("n_tokens").alias("n_tokens"))
    out = docs.withColumn("n_bytes", F.octet_length(text_of()).cast("long")).withColumn("tc_digest", digest)
    out = out.join(counts, "tc_digest", "left").drop("tc_digest")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
