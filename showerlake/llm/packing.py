"""Operator 3: packing documents into token sequences along a space-filling curve.

A document's words are hashed to signs and summed into a few dimensions, its
direction there is put on a Hilbert curve, and documents are range-sorted by
their place on it (then by id), so that alike documents share sequences. Ranges
hold about equal bytes (`along_curve`). The ids of a range are cut every `length` tokens; what is left at its end
is cut at powers of two, which need no padding. Nothing global is gathered:
sequence ids are (partition << 32) + number within it.

Null texts count as empty and still have their end id; empty tables give no
rows; equal rows are packed once each; a very long text is cut into many
sequences, within its range. Other columns than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.bpe import encode_batches, encoder
from showerlake.llm.common import default_partitions, prepare, text_buffers, tidy, words_of
from showerlake.llm.hilbert import hilbert_key

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert long"
DIMENSIONS, BITS, CELL_BITS, TARGET_BYTES = 5, 12, 16, 32 << 20


def document_vectors(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed word vectors, each the sum of its words' +-1 signs, divided by the root of their number."""
    out = np.zeros((len(column), dimensions))
    for lo, hi, words in words_of(column):
        for d in range(dimensions):
            signs = np.where(words.h >> np.uint64(5 + 7 * d) & np.uint64(1), 1.0, -1.0)
            out[lo:hi, d] = np.bincount(words.row, signs, minlength=hi - lo) / np.sqrt(np.maximum(np.diff(words.at), 1))
    return out


def curve_keys(column: pa.Array) -> np.ndarray:
    """Each text's place on the curve."""
    cells = np.clip((np.arctan(document_vectors(column) / 3) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    return hilbert_key(cells, BITS).astype(np.int64)


def with_curve_key(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, hilbert): each document's place on the curve."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_keys(batch.column(1)))], ["doc_id", "text", "hilbert"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, text string, hilbert long")


def curve_bytes(df: DataFrame, *, text_column: str = "text") -> DataFrame:
    """(cell, bytes): the bytes of all documents in each cell of the curve, and a few for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS)
        for batch in batches:
            _, at = text_buffers(batch.column(0))
            total += np.bincount(curve_keys(batch.column(0)) >> (BITS * DIMENSIONS - CELL_BITS), np.diff(at) + 32, len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].astype(np.int64))], ["cell", "bytes"])

    return df.select(F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), "cell int, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes"))


def along_curve(placed: DataFrame, sizes: DataFrame, partitions: int) -> DataFrame:
    """Documents in curve order, dealt to `partitions` or more ranges of about equal bytes (TARGET_BYTES at most, but for one text).

    The bytes of all documents are added up for cells of the curve (2**CELL_BITS
    of them), of which a range holds neighbouring ones; a cell that is too large
    for a range, such as that of a hot group of copies, is dealt out by ids.
    """
    spark = placed.sparkSession
    cell = F.shiftrightunsigned("hilbert", BITS * DIMENSIONS - CELL_BITS).cast("int")
    sums = sizes.orderBy("cell").toPandas()  # 2**CELL_BITS rows at most
    weight = sums["bytes"].to_numpy().astype(float)
    wanted = max(partitions, math.ceil(weight.sum() / TARGET_BYTES))
    most = max(weight.sum() / wanted, 1.0)
    first, splits, at, held = [], [], 0, 0.0
    for w in weight:
        if held and held + w > most:
            at, held = at + 1, 0.0
        parts = math.ceil(w / most)
        first.append(at)
        splits.append(parts)
        if parts > 1:
            at, held = at + parts, 0.0
        else:
            held += w
    sums["first"], sums["splits"] = first, splits
    table = spark.createDataFrame(sums[["cell", "first", "splits"]].astype("int32"), "cell int, first int, splits int") if len(sums) else spark.createDataFrame([], "cell int, first int, splits int")
    dealt = placed.withColumn("cell", cell).join(F.broadcast(table), "cell")  # 12 bytes for each cell
    part = F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("splits")).cast("int")
    return dealt.repartitionById(at + 1, part).select("doc_id", "text", "hilbert").sortWithinPartitions("hilbert", "doc_id")


def cuts(total: int, length: int, at_end: bool) -> list[int]:
    """Lengths of the sequences that `total` tokens fill; without at_end what doesn't fill one is left."""
    out = [length] * (total // length)
    rest = total % length if at_end else 0
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(df: DataFrame, vocabulary: str, *, end_id: int = 1, length: int = 2048, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence (see PIECES)."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 32
        docs: list[tuple[int, int, int, int, np.ndarray]] = []  # doc_id, key, ids already packed, ids in all, the others
        waiting = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal docs, waiting, first
            sizes = cuts(waiting, length, last)
            rows, k, used, room = [], 0, 0, sum(sizes)
            left: list[tuple[int, int, int, int, np.ndarray]] = []
            for doc, key, start, total, ids in docs:
                done = 0
                while done < len(ids) and room:
                    n = min(len(ids) - done, sizes[k] - used)
                    rows.append((doc, start + done, n, zlib.crc32(ids[done : done + n]), total, first + k, used, key))
                    done, used, room = done + n, used + n, room - n
                    if used == sizes[k]:
                        k, used = k + 1, 0
                if done < len(ids):
                    left.append((doc, key, start + done, total, ids[done:]))
            docs, waiting, first = left, sum(len(x[4]) for x in left), first + len(sizes)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, ids, at in encode_batches(made, batch.column(1)):
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                docs += [(names[lo + i], keys[lo + i], 0, int(at[i + 1] - at[i]), ids[at[i] : at[i + 1]]) for i in range(hi - lo)]
                waiting += len(ids)
                yield flush(False)
        yield flush(True)

    placed = with_curve_key(df, id_column=id_column, text_column=text_column)
    return along_curve(placed, curve_bytes(df, text_column=text_column), partitions or default_partitions(spark)).mapInArrow(tidy(run), PIECES)
