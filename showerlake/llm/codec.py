"""Operator 1: byte-level BPE encoding and decoding of a text column.

Null texts count as empty; an empty text has no ids and decodes to no bytes.
Rows keep their multiplicity, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.bpe import ByteTable, encode_batches, encoder
from showerlake.llm.common import prepare, tidy


def _quiet() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encode(df: DataFrame, vocabulary: str, pattern: str | None = None, *, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, spans array<struct<start, end>>]) of every row; spans are in characters."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        made = encoder(vocabulary, pattern)
        table = ByteTable(made) if offsets else None
        for batch in batches:
            for lo, hi, ids, at in encode_batches(made, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(lo, hi - lo), lists]
                if table is not None:
                    texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                    spans = [table.offsets(ids[at[i] : at[i + 1]].tolist(), t or "") for i, t in enumerate(texts)]
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    columns.append(pa.array([[{"start": a, "end": b} for a, b in row] for row in spans], kind))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "spans"][: len(columns)])

    schema = "id long, ids array<int>" + (", spans array<struct<start: int, end: int>>" if offsets else "")
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, vocabulary: str, pattern: str | None = None, *, id_column: str = "id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes binary, text string) of rows of ids; null lists count as empty, bad UTF-8 becomes U+FFFD."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        table = ByteTable(encoder(vocabulary, pattern))
        for batch in batches:
            raw = [b"".join(table.table[i] for i in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw])], ["id", "bytes", "text"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).alias("ids")).mapInArrow(tidy(run), "id long, bytes binary, text string")


def round_trip(df: DataFrame, vocabulary: str, pattern: str | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of every row's ids and of the bytes that they decode to, in one pass without the ids leaving the worker."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _quiet()
        made = encoder(vocabulary, pattern)
        table = ByteTable(made)
        for batch in batches:
            for lo, hi, ids, at in encode_batches(made, batch.column(1)):
                raw, ends = table.decode(ids, at)
                packed, raw = ids.astype("<u4").view(np.uint8), np.ascontiguousarray(raw)
                a = [hashlib.sha256(packed[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(hi - lo)]
                b = [hashlib.sha256(raw[ends[i] : ends[i + 1]]).hexdigest() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), schema)
