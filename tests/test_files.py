"""HDF5 and event files through stand-ins for the libraries that aren't installed, and streams."""

import json
import os
import pickle
import sys
from datetime import datetime

import numpy as np
import pytest

from showerlake.operators.merge import MergeWithinCell
from showerlake.sources import files
from showerlake.sources.steps import last_primary, read_steps
from showerlake.streaming.stream import compress_batches, stream_merge

FAKES = os.path.join(os.path.dirname(__file__), "fakes")


@pytest.fixture
def fakes(spark, monkeypatch):
    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = os.pathsep.join(x for x in (FAKES, os.path.dirname(os.path.dirname(FAKES)), before) if x)
    monkeypatch.syspath_prepend(FAKES)
    yield
    env["PYTHONPATH"] = before
    for name in ("h5py", "podio", "podio.root_io"):
        sys.modules.pop(name, None)


def test_hdf5_is_read_by_ranges(spark, fakes, tmp_path):
    n = 50
    steps = {
        "event_id": np.arange(n, dtype=np.int32) % 4, "energy": np.arange(n, dtype=np.float32), "position": np.arange(3 * n, dtype=np.float32).reshape(n, 3),
        "cell_id": np.full(n, 2**63 + 5, np.uint64), "cluster_label": np.arange(n) // 2,
    }
    primary = {"event_id": np.array([1, 0, 1], np.int32), "pdg": np.array([11, 22, -11], np.int32), "vertex": np.zeros((3, 3), np.float32), "momentum": np.eye(3, dtype=np.float32)}
    path = str(tmp_path / "in.h5")
    with open(path, "wb") as file:
        pickle.dump(({"steps": steps, "primary": primary}, {"algorithm": "none", "debug_output": np.bool_(True)}), file)
    made = files.hdf5_steps(spark, path, rows=7)
    rows = made.orderBy("shower_id", "point_index").collect()
    assert [(r.shower_id, r.point_index, r.e) for r in rows] == [(s, i, float(s + 4 * i)) for s in range(4) for i in range(len(range(s, n, 4)))]
    assert {r.cell_id for r in rows} == {-(2**63) + 5} and rows[0].z == 2.0 and rows[1].cluster_label == 2 and "t" not in made.columns
    found = {r.shower_id: r for r in last_primary(files.hdf5_primaries(spark, path, rows=2), "row").collect()}
    assert found[1].pdg == -11 and found[1].momentum == [0.0, 0.0, 1.0] and found[0].pdg == 22
    assert files.hdf5_meta(path) == {"algorithm": "none", "debug_output": True}
    assert read_steps(spark, path, shower_limit=2).select("shower_id").distinct().count() == 2


def test_hdf5_is_written_by_ranges(spark, fakes, tmp_path):
    rows = [(s, i, float(i), 1.0, 2.0, 0.5, None if i else -1, s) for s in range(6) for i in range(5)]
    steps = spark.createDataFrame(rows, "shower_id int, point_index bigint, x float, y float, z float, e float, cell_id bigint, pdg int").fillna(7, ["cell_id"])
    primaries = spark.createDataFrame([(2, 11, None, [1.0, 0.0, 0.0])], "shower_id int, pdg int, vertex array<float>, momentum array<float>")
    made = files.write_hdf5(steps, str(tmp_path / "out"), algorithm="a", source_input="b", primaries=primaries, extra={"debug_event_indices": [1, 2]}, files=3).collect()
    assert sum(r.rows for r in made) == 30 and len(made) > 1
    back = None
    for r in sorted(made):
        one = files.hdf5_steps(spark, r.path, rows=4)
        back = one if back is None else back.unionByName(one)
        assert files.hdf5_meta(r.path) == {"algorithm": "a", "source_input": "b", "debug_event_indices": [1, 2]}
    columns = ["shower_id", "point_index", "x", "e", "cell_id", "pdg"]
    assert sorted(back.select(columns).collect()) == sorted(steps.select(columns).collect())
    first = [p for r in made for p in files.hdf5_primaries(spark, r.path).collect()]
    assert [(p.shower_id, p.pdg, p.vertex, p.momentum) for p in first] == [(2, 11, [0.0] * 3, [1.0, 0.0, 0.0])]


def test_events(spark, fakes, tmp_path):
    hits = [{"cell": 2**63 + 1, "parts": [[1, 2, 3, 0.5, 9, 11, 4], [4, 5, 6, 0.25, 8, 22, 5]]}]
    particles = [{"created": True, "pdg": 1, "vertex": [0, 0, 0], "momentum": [0, 0, 1]}, {"created": False, "pdg": 22, "vertex": [1, 1, 1], "momentum": [0, 3, 0]}]
    path = str(tmp_path / "in.root")
    with open(path, "w") as file:
        json.dump([{"particles": particles, "collections": {"A": [], "B": hits}}, {"particles": [], "collections": {"A": hits, "B": hits}}], file)
    steps, primaries = files.events(spark, path, ["A", "B"], size=1)
    rows = steps.orderBy("shower_id", "point_index").collect()
    assert [(r.shower_id, r.point_index, r.subdetector, r.x, r.pdg, r.track_id) for r in rows] == [(0, 0, 1, 1, 11, 4), (0, 1, 1, 4, 22, 5), (1, 0, 0, 1, 11, 4), (1, 1, 0, 4, 22, 5), (1, 2, 1, 1, 11, 4), (1, 3, 1, 4, 22, 5)]
    assert {r.cell_id for r in rows} == {-(2**63) + 1}
    assert [(r.shower_id, r.pdg, r.momentum) for r in primaries.collect()] == [(0, 22, [0.0, 3.0, 0.0])]
    assert files.events(spark, path, None)[0].count() == 0
    assert read_steps(spark, path, collections=["B"]).count() == 4


def test_missing_libraries(spark):
    for name in ("x.root", "x.h5"):
        with pytest.raises(ImportError, match="needs"):
            read_steps(spark, name)


SCHEMA = "ts timestamp, shower_id int, point_index bigint, cell_id bigint, x float, y float, z float, t float, e float"


def _rows(*minutes, x=1.0, e=2.0):
    return [(datetime(2024, 1, 1, m // 60, m % 60), 1, i, 7, x, 2 * x, 3 * x, 4 * x, e) for i, m in enumerate(minutes)]


def _drop_in(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_a_stream_is_merged_by_window_and_late_rows_go(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        query = stream_merge(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    _drop_in(spark, source, "a", _rows(5, 10, x=1.0) + _rows(20, x=4.0, e=4.0))
    run()
    _drop_in(spark, source, "b", _rows(130))  # the first window is closed from now on
    run()
    _drop_in(spark, source, "c", _rows(15, x=100.0) + _rows(300))  # one row is too late
    run()
    rows = {r.window_start.hour: r for r in spark.read.parquet(sink).collect()}
    assert (rows[0].n, rows[0].e, rows[0].x, rows[0].y, rows[0].z, rows[0].t) == (3, 8.0, 2.5, 5.0, 7.5, 10.0)
    assert rows[2].n == 1 and set(rows) == {0, 2}


def test_the_batch_query_divides_as_its_sql_and_keeps_rows_without_a_time(spark, tmp_path):
    from showerlake.plans.queries import QUERIES

    five = datetime(2024, 1, 1, 5, 30)
    rows = [
        (five, 1, "click", 0.0), (five, 1, "click", -0.0), (five, 2, "click", None), (five, 3, "click", None), (five, 3, "click", -2.5),
        (None, 1, "view", 2.0), (None, 1, "view", 3.0), (None, 2, "view", 0.0), (None, None, None, None), (datetime(1970, 1, 1), 1, "view", 1.0),
    ]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["stream_merge_batch"](spark, str(tmp_path)).select("window_start", "shower_id", "cell_id", "n", "e", "x", "y", "t").collect()
    hour = datetime(2024, 1, 1, 5)
    expected = {
        (hour, 1, 1, 2, 0.0, "nan", "nan", "nan"), (hour, 2, 1, 1, None, None, None, None), (hour, 3, 1, 2, 2.5, 5.0, 30.0, 1.0),
        (None, 1, 2, 2, 5.0, None, None, None), (None, 2, 2, 1, 0.0, None, None, None), (None, None, 0, 1, None, None, None, None),
        (datetime(1970, 1, 1), 1, 2, 1, 1.0, 0.0, 0.0, 1.0),
    }
    assert len(found) == 7 and {tuple("nan" if isinstance(v, float) and np.isnan(v) else v for v in r) for r in found} == expected
    deposits = spark.createDataFrame(_rows(5, 10, e=0.0), SCHEMA)
    first = stream_merge(deposits).first()
    assert (first.n, first.e, first.x, first.z, first.t) == (2, 0.0, 0.0, 0.0, 0.0)  # by itself the merge has the origin


def test_batches_of_whole_showers_survive_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    _drop_in(spark, source, "a", _rows(1, 2, 3))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        query = compress_batches(stream, MergeWithinCell(), sink, checkpoint=state, once=True)
        assert query.awaitTermination(120)

    run()
    _drop_in(spark, source, "b", [(r[0], 2, *r[2:]) for r in _rows(9)])
    run()
    rows = spark.read.parquet(sink).orderBy("shower_id").collect()
    assert [(r.shower_id, r.e, r.batch) for r in rows] == [(1, 6.0, 0), (2, 2.0, 1)]
    # as after a crash between a batch's files and its commit: it is done again, not twice
    os.remove(f"{state}/commits/1")
    os.path.exists(f"{state}/commits/.1.crc") and os.remove(f"{state}/commits/.1.crc")
    run()
    assert spark.read.parquet(sink).count() == 2
