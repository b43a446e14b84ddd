"""Operator 7: token ids in Parquet files that allow selective reads.

A file holds documents in ascending id order: the ids as a list column, delta
encoded without a dictionary (or dictionary encoded), in row groups of ROW_GROUP
documents (fewer where these have GROUP_TOKENS ids), with page indexes, beside
metadata columns that can be read without touching the ids. Files of the range
partitions, of about equal bytes, follow each other in id order; the manifest has
each file's first and last id, so that `read_range` opens only the files and row
groups that hold the ids asked for. A task writes files under names of its own attempt and reports
them; only reported files count, so a task that is run again leaves no mix.

Null texts count as empty: they hold only the end id. Rows with equal ids keep
an arbitrary order among each other; a null id sorts first. An empty table
gives no files and no rows. Other columns than id and text are not read.

Files are written by pyarrow into `folder`, whose scheme must be one that it
knows (s3a and s3n are read as s3); if not, writing fails before it begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from showerlake.llm.bpe import encode_batches, encoder
from showerlake.llm.common import default_partitions, materialise, prepare, tidy

MANIFEST = "part int, path string, rows long, tokens long, first_id long, last_id long"
#: Documents of a row group, ids at which it ends early, cells of ids by which bytes are balanced, bytes of a range.
ROW_GROUP, GROUP_TOKENS, CELLS, TARGET_BYTES = 1024, 4_000_000, 4096, 64 << 20


def open_folder(uri: str):
    """(file system, path) of a URI, for pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def in_id_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Documents in ascending id order, in `partitions` or more ranges of about equal bytes; one id is never split.

    Ids are cut into CELLS cells of about equal rows, the bytes of all documents
    are added up for each, and neighbouring cells make a range.
    """
    spark = rows.sparkSession
    found = rows.agg(F.percentile_approx("doc_id", [i / CELLS for i in range(1, CELLS)], 4 * CELLS)).first()[0] or []
    borders = np.unique(np.array(found, np.int64))
    shared = spark.sparkContext.broadcast(borders)

    @F.arrow_udf("int")
    def cell(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(shared.value, ids.fill_null(0).to_numpy(), side="right")
        return pa.array(np.where(np.asarray(ids.is_valid()), at, 0), pa.int32())

    size = F.coalesce(F.length(F.col("text").cast("binary")), F.lit(0)) + 32
    sums = rows.select("doc_id", size.alias("size")).groupBy(cell("doc_id").alias("cell")).agg(F.sum("size").alias("bytes")).collect()  # CELLS rows at most
    weight = np.zeros(len(borders) + 1)
    for r in sums:
        weight[r.cell] = r.bytes
    most = max(weight.sum() / max(partitions, -(-weight.sum() // TARGET_BYTES)), 1.0)
    part = ((np.cumsum(weight) - weight / 2) // most).astype(int)
    part = np.unique(part, return_inverse=True)[1]
    placed = F.element_at(F.lit([int(x) for x in part]), cell("doc_id") + 1)
    return rows.repartitionById(int(part[-1]) + 1, placed).sortWithinPartitions("doc_id")


def write(df: DataFrame, folder: str, vocabulary: str, *, end_id: int | None = 2, encoding: str = "delta", id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None, row_group: int = ROW_GROUP, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Encodes texts into files of folder; returns their manifest (see MANIFEST)."""
    spark = df.sparkSession
    prepare(spark)
    open_folder(folder)  # fails early
    file_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])
    how = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED", "doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made, writer, rows, tokens = encoder(vocabulary), None, 0, 0
        system, top = open_folder(folder)
        context = TaskContext.get()
        path = f"{top}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        first = last = None

        def flush() -> None:
            nonlocal writer, held
            if not held:
                return
            if writer is None:
                system.create_dir(top, recursive=True)
                writer = pq.ParquetWriter(system.open_output_stream(path), file_schema, compression="zstd", version="2.6", data_page_version="2.0", write_page_index=True, **how)
            sizes = np.concatenate([n for _, n, _ in held])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([x for *_, x in held]), pa.int32()), type=file_schema.field("ids").type)
            writer.write_table(pa.Table.from_arrays([pa.concat_arrays([x for x, *_ in held]), pa.array(sizes, pa.int64()), lists], schema=file_schema), row_group_size=row_group)
            held = []

        for batch in batches:
            for lo, hi, ids, at in encode_batches(made, batch.column(1)):
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                names = batch.column(0).slice(lo, hi - lo)
                if len(some := names.drop_null()):
                    first, last = some[0].as_py() if first is None else first, some[-1].as_py()
                a = 0
                while a < hi - lo:  # row groups end after `row_group` documents, or with the one that reaches group_tokens
                    docs, ids_held = sum(len(x) for x, *_ in held), sum(len(x) for *_, x in held)
                    z = min(hi - lo, a + row_group - docs, a + 1 + int(np.searchsorted(at[a + 1 :] - at[a], group_tokens - ids_held)))
                    held.append((names.slice(a, z - a), np.diff(at[a : z + 1]), ids[at[a] : at[z]]))
                    if docs + z - a >= row_group or ids_held + at[z] - at[a] >= group_tokens:
                        flush()
                    a = z
                rows, tokens = rows + hi - lo, tokens + int(at[-1])
        flush()
        if writer is not None:
            writer.close()
            if writer.file_handle is not None:
                writer.file_handle.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [path], "rows": [rows], "tokens": [tokens], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64())})

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return materialise(in_id_order(rows, partitions or default_partitions(spark)).mapInArrow(tidy(run), MANIFEST), "manifest")


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a manifest's files; start counts the ids of all documents before."""
    spark = manifest.sparkSession
    prepare(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for k in range(file.num_row_groups):
                        group = file.read_row_group(k, columns=["doc_id", "ids"])
                        lists = group["ids"].combine_chunks()
                        at = lists.offsets.to_numpy().astype(np.int64)
                        ids = np.ascontiguousarray(lists.values.to_numpy(), "<u4").view(np.uint8)
                        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([group["doc_id"].combine_chunks(), pa.array(base + at[:-1] - at[0], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(at[-1] - at[0])

    spread = files.select("path", "base", "part").repartition(default_partitions(spark), "part").select("path", "base")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The files as a table; only the named columns are read."""
    paths = [r.path for r in manifest.select("path").collect()]  # a path for each file
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return spark.read.parquet(*[scheme + p for p in paths]).select(*columns)


def read_range(manifest: DataFrame, folder: str, low: int, high: int, columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Rows of ids from low to high: files by the manifest, row groups by their statistics, and of these the named columns."""
    spark = manifest.sparkSession
    prepare(spark)
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for k in range(file.num_row_groups):
                        about = file.metadata.row_group(k).column(0).statistics
                        if about is not None and about.has_min_max and (about.max < low or about.min > high):
                            continue
                        group = file.read_row_group(k, columns=list(dict.fromkeys(["doc_id", *columns])))
                        inside = pc.and_(pc.greater_equal(group["doc_id"], low), pc.less_equal(group["doc_id"], high))
                        yield from group.filter(inside).select(list(columns)).to_batches()

    files = manifest.where((F.col("first_id") <= high) & (F.col("last_id") >= low)).select("path")
    return files.repartition(default_partitions(spark), "path").mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in columns))
