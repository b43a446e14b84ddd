"""HDF5 and ROOT event files, read and written by executors; h5py and podio are needed there.

Only sizes and attributes are read on the driver. Each task reads a range of rows
or events, and files must be on a path that all machines see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Datasets of the group `steps`, the columns that they make, and types in the file.
STEPS = {"event_id": ("shower_id", "int32"), "energy": ("e", "float32"), "time": ("t", "float32"), "cell_id": ("cell_id", "uint64"), "pdg": ("pdg", "int32"), "cluster_label": ("cluster_label", "int64"), "track_id": ("track_id", "int32")}
KINDS = {"int32": pa.int32(), "float32": pa.float32(), "uint64": pa.int64(), "int64": pa.int64()}
SQL_KINDS = {"int32": "int", "float32": "float", "uint64": "bigint", "int64": "bigint"}
#: Rows, and events, of a task.
ROWS, EVENTS = 2_000_000, 100


def _module(name: str):
    try:
        return __import__(name, fromlist=["root_io"])
    except ImportError as error:
        raise ImportError(f"reading or writing this format needs {name}") from error


def plain_path(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _ranges(spark: SparkSession, total: int, size: int) -> DataFrame:
    """(start, stop) of a range for each task."""
    number = max(1, -(-total // size))
    at = spark.range(0, number, 1, number)
    return at.select((F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(total)).alias("stop"))


def hdf5_steps(spark: SparkSession, path: str, *, rows: int = ROWS) -> DataFrame:
    """Deposits of an HDF5 file; point_index is the place among the event's rows, in file order."""
    path, h5py = plain_path(path), _module("h5py")
    with h5py.File(path, "r") as file:
        steps = file["steps"]
        total, there = steps["event_id"].shape[0], [n for n in STEPS if n in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h5py = _module("h5py")
        with h5py.File(path, "r") as file:
            steps = file["steps"]
            for batch in batches:
                for start, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    made = [pa.array(np.arange(start, stop))]
                    for name in there:
                        kind = STEPS[name][1]
                        values = np.asarray(steps[name][start:stop]).astype(kind)
                        made.append(pa.array(values.view("int64") if kind == "uint64" else values, KINDS[kind]))
                    place = np.asarray(steps["position"][start:stop]).astype("float32").reshape(-1, 3)
                    made += [pa.array(np.ascontiguousarray(place[:, k])) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(made, ["row", *(STEPS[n][0] for n in there), "x", "y", "z"])

    schema = ", ".join(["row long", *(f"{STEPS[n][0]} {SQL_KINDS[STEPS[n][1]]}" for n in there), "x float", "y float", "z float"])
    found = _ranges(spark, total, rows).mapInArrow(run, schema)
    return found.withColumn("point_index", (F.row_number().over(Window.partitionBy("shower_id").orderBy("row")) - 1).cast("bigint")).drop("row")


def hdf5_primaries(spark: SparkSession, path: str, *, rows: int = ROWS) -> DataFrame:
    """(shower_id, pdg, vertex, momentum, row) of the group `primary`; of duplicates the last row counts (steps.last_primary)."""
    path, h5py = plain_path(path), _module("h5py")
    with h5py.File(path, "r") as file:
        there = "primary" in file and "event_id" in file["primary"]
        total = file["primary"]["event_id"].shape[0] if there else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _module("h5py").File(path, "r") as file:
            for batch in batches:
                for start, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if start >= stop:
                        continue
                    own = file["primary"]
                    ints = [pa.array(np.asarray(own[n][start:stop]).astype("int32")) for n in ("event_id", "pdg")]
                    vectors = [pa.array(np.asarray(own[n][start:stop]).astype("float32").reshape(-1, 3).tolist(), pa.list_(pa.float32())) for n in ("vertex", "momentum")]
                    yield pa.RecordBatch.from_arrays([*ints, *vectors, pa.array(np.arange(start, stop))], ["shower_id", "pdg", "vertex", "momentum", "row"])

    return _ranges(spark, total, rows).mapInArrow(run, "shower_id int, pdg int, vertex array<float>, momentum array<float>, row long")


def hdf5_meta(path: str) -> dict:
    """A file's attributes."""
    with _module("h5py").File(plain_path(path), "r") as file:
        return {k: v.tolist() if hasattr(v, "tolist") else v for k, v in dict(file.attrs).items()}


def write_hdf5(steps: DataFrame, folder: str, *, algorithm: str, source_input: str, primaries: DataFrame | None = None, extra: dict | None = None, files: int | None = None) -> DataFrame:
    """Writes an HDF5 file for each range of showers; returns (path, rows) of the files, sorted by shower.

    Optional datasets are written for the columns that the table has; primaries
    without a code or vectors get 0 and zero vectors.
    """
    _module("h5py")
    top = plain_path(folder)
    names = {column: (name, kind) for name, (column, kind) in STEPS.items() if column in steps.columns}
    order = [*names, "x", "y", "z"]
    zero = F.array(*[F.lit(0.0).cast("float")] * 3)
    own = F.struct(*[F.col(c) for c in order], "point_index")
    spread = steps.groupBy("shower_id").agg(F.sort_array(F.collect_list(F.struct("point_index", own.alias("s")))).alias("steps"))
    if primaries is not None:
        first = primaries.select("shower_id", F.struct(F.coalesce("pdg", F.lit(0)).alias("pdg"), F.coalesce("vertex", zero).alias("vertex"), F.coalesce("momentum", zero).alias("momentum")).alias("primary"))
        spread = spread.join(first, "shower_id", "left")
    else:
        spread = spread.withColumn("primary", F.lit(None).cast("struct<pdg: int, vertex: array<float>, momentum: array<float>>"))
    attributes = {"algorithm": algorithm, "source_input": source_input} | (extra or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        made: dict[str, list] = {c: [] for c in order}
        first: list[tuple] = []
        for batch in batches:
            for shower, rows, primary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in rows:
                    for c in order:
                        made[c].append(row["s"][c])
                if primary is not None:
                    first.append((shower, primary["pdg"], primary["vertex"], primary["momentum"]))
        if not made["shower_id"]:
            return
        context = TaskContext.get()
        os.makedirs(top, exist_ok=True)
        path = f"{top}/part-{context.partitionId():05d}.h5"
        half = f"{path}.{context.taskAttemptId()}"
        with _module("h5py").File(half, "w") as file:
            for k, v in attributes.items():
                file.attrs[k] = np.asarray(v, np.int32) if isinstance(v, list) else v
            group = file.create_group("steps")
            for column, (name, kind) in names.items():
                values = np.array(made[column], "int64" if kind == "uint64" else kind)
                group.create_dataset(name, data=values.view("uint64") if kind == "uint64" else values)
            group.create_dataset("position", data=np.stack([np.array(made[c], "float32") for c in "xyz"], 1))
            if first:
                group = file.create_group("primary")
                for k, (name, kind) in enumerate((("event_id", "int32"), ("pdg", "int32"), ("vertex", "float32"), ("momentum", "float32"))):
                    group.create_dataset(name, data=np.array([x[k] for x in first], kind))
        os.replace(half, path)  # a task that runs again replaces its file
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(made["shower_id"])])], ["path", "rows"])

    ranges = spread.repartitionByRange(files, "shower_id") if files else spread.repartitionByRange("shower_id")
    rows = ranges.sortWithinPartitions("shower_id").select("shower_id", "steps", "primary").mapInArrow(run, "path string, rows long").collect()  # a row for each file
    return steps.sparkSession.createDataFrame(rows, "path string, rows long")


def events(spark: SparkSession, path: str, collections: list[str] | None, *, size: int = EVENTS) -> tuple[DataFrame, DataFrame]:
    """(steps, primaries) of a ROOT event file, by podio.

    shower_id is the event's number, subdetector the collection's place in the
    list; the primary is the first particle that the simulation did not create. No
    collections give no deposits.
    """
    path, names = plain_path(path), list(collections or [])
    total = len(_module("podio").root_io.Reader(path).get("events"))

    def frames(batches: Iterator[pa.RecordBatch]):
        found = _module("podio").root_io.Reader(path).get("events")
        for batch in batches:
            for start, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number in range(start, stop):
                    yield number, found[number]

    def deposits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, frame in frames(batches):
            rows = []
            for k, name in enumerate(names):
                for hit in frame.get(name) or []:
                    cell = int(hit.getCellID()) % 2**64
                    for part in hit.getContributions():
                        at = part.getStepPosition()
                        rows.append((at.x, at.y, at.z, part.getEnergy(), part.getTime(), cell - 2**64 if cell >= 2**63 else cell, k, part.getPDG(), part.getParticle().getObjectID().index))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.float32()] * 5 + [pa.int64(), pa.int16(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), *[pa.array([float(x) for x in c] if t == pa.float32() else c, t) for c, t in zip(columns, kinds, strict=True)]], ["shower_id", "point_index", "x", "y", "z", "e", "t", "cell_id", "subdetector", "pdg", "track_id"])

    def particles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, frame in frames(batches):
            for name in ("MCParticles", "MCParticle"):
                try:
                    there = list(frame.get(name) or [])
                except Exception:  # the file has no such collection, which podio tells in several ways
                    there = []
                own = next((p for p in there if not p.isCreatedInSimulation()), None)
                if own is not None:
                    vectors = [[float(getattr(v, c)) for c in "xyz"] for v in (own.getVertex(), own.getMomentum())]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([int(own.getPDG())], pa.int32()), *[pa.array([v], pa.list_(pa.float32())) for v in vectors]], ["shower_id", "pdg", "vertex", "momentum"])
                    break

    at = _ranges(spark, total, size)
    steps = at.mapInArrow(deposits, "shower_id int, point_index long, x float, y float, z float, e float, t float, cell_id long, subdetector smallint, pdg int, track_id int")
    return steps, at.mapInArrow(particles, "shower_id int, pdg int, vertex array<float>, momentum array<float>")
