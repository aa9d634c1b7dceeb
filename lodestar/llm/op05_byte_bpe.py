"""Byte-level BPE encoding and decoding over Arrow batches (see bpe.py for the kernel).

Each row's whole text is encoded to ids with the first and end character of every token, and decoded back to bytes
through the byte table reversed.  No shuffle; a row needs nothing but itself.  Null text counts as empty: no ids.
Repeated rows yield repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm import bpe
from lodestar.llm.common import pieces, python_ready, text_of

FIELDS = {"ids": "array<bigint>", "starts": "array<bigint>", "ends": "array<bigint>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, tokenizer: str, pattern: str | None = None, id_column: str = "doc_id", outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded", "n_tokens")) -> DataFrame:
    """id_column and the chosen outputs: ids, starts and ends (characters, end exclusive), decoded (bytes), n_tokens,
    ids_sha256 (over little-endian unsigned 32-bit ids), decoded_sha256."""
    python_ready(docs.sparkSession)
    source = docs.select(docs[id_column], text_of().alias("bb_text"))
    id_type = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.load(tokenizer, pattern)
        for batch in batches:
            for part in pieces(batch, "bb_text"):
                flat, at = own.encode(part.column("bb_text"))
                ids = [flat[at[i] : at[i + 1]] for i in range(part.num_rows)]
                made: dict[str, list] = {}
                if "ids" in outputs:
                    made["ids"] = [x.astype(np.int64) for x in ids]
                if {"starts", "ends"} & set(outputs):
                    spans = [own.offsets(t, x) for t, x in zip(part.column("bb_text").to_pylist(), ids, strict=True)]
                    made["starts"], made["ends"] = [s[0] for s in spans], [s[1] for s in spans]
                if {"decoded", "decoded_sha256"} & set(outputs):
                    decoded = [own.decode(x) for x in ids]
                    made["decoded"], made["decoded_sha256"] = decoded, [hashlib.sha256(x).hexdigest() for x in decoded]
                made["n_tokens"] = np.diff(at).tolist()
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[k], kinds[FIELDS[k]]) for k in outputs)], [id_column, *outputs])

    kinds = {"array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return source.mapInArrow(run, ", ".join([f"`{id_column}` {id_type}", *(f"{k} {FIELDS[k]}" for k in outputs)]))
