"""Arrow and numpy helpers that several text operators share.

Words are identified by a 64-bit polynomial hash of their lower-cased (A-Z)
bytes, computed for a whole buffer at once; at n distinct words the chance of
any collision is about n*n / 2**65.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy code handles at once.
SLICE_BYTES = 2_000_000
U64 = np.uint64


#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't name them.
BATCH_BYTES = 4 << 20
#: Bytes of a task's input from which it gives its memory back.
TIDY_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed, and keeps their batches small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the folder that the cluster names for checkpoints.

    Only in local mode, where one machine is all there is, may that setting be
    missing; on a cluster executors wouldn't see each other's files, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/showerlake-checkpoints-{os.getuid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, uri: str) -> None:
    path, system = _path(spark, uri)
    system.delete(path, True)


def stored(df: DataFrame, uri: str) -> DataFrame:
    """Writes df as Parquet to a folder, which goes when the driver ends, and reads it again: lineage ends there."""
    spark = df.sparkSession
    df.write.parquet(uri)
    path, system = _path(spark, uri)
    system.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(uri)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder and read from there."""
    return stored(df, shared_dir(df.sparkSession, name))


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its freed memory back at the end of a task of over TIDY_BYTES, as workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                seen += batch.nbytes
                yield batch

        yield from run(counted())
        if seen > TIDY_BYTES:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mod_crc(column: str, n: int):
    """crc32 of an integer's decimal text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


# --- 64-bit mixing -----------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift-multiply)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keyed(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(np.asarray(x, dtype=U64) + U64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = keyed(_LOWER.astype(U64), 77)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = _pow[base] = np.cumprod(steps)
    return have


# --- Arrow text columns ------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of some rows: `h` hashes, `row` their rows, `start`/`end` their bytes in `buf`."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.rows = buf, len(offsets) - 1
        n = len(buf)
        solid = ~_SPACE[buf]
        begin, finish = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1]
            finish[:-1] &= ~solid[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            begin[cuts] = solid[cuts]
            finish[cuts - 1] = solid[cuts - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.row = np.searchsorted(offsets[1:], self.start, side="right").astype(np.int64)
        self.h = np.empty(len(self.start), U64)
        lo, most = 0, SLICE_BYTES
        while lo < len(self.start):
            a = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, a + most, side="right")))
            b = self.end[hi - 1]
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(_BYTE[buf[a:b]] * _powers(_P, b - a)[: b - a], out=sums[1:])
            s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
            self.h[lo:hi] = mix((sums[e] - sums[s]) * _powers(_PINV, b - a + 1)[s] + (e - s).astype(U64))
            lo = hi
        counts = np.bincount(self.row, minlength=self.rows) if len(self.row) else np.zeros(self.rows, np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def text(self, i: int) -> str:
        return bytes(_LOWER[self.buf[self.start[i] : self.end[i]]]).decode("utf-8", "replace")


def words_of(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for slices of a text column."""
    raw, at = text_buffers(column)
    for lo, hi in row_slices(at, most):
        yield lo, hi, Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word shingle; a row of fewer words has its whole sequence as one."""
    h, row, n = words.h, words.row, len(words.h)
    sizes = np.diff(words.at)
    full = np.zeros(max(n - k + 1, 0), dtype=bool)
    if n >= k:
        full = row[: n - k + 1] == row[k - 1 :]
    first = np.flatnonzero(full)
    value = h[first].copy()
    for j in range(1, k):
        value = mix(value) + h[first + j] * U64(0x9E3779B97F4A7C15)
    value = keyed(value, k)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if not len(short):
        return row[first], value
    own = np.zeros(len(short), U64)
    for j in range(k - 1):
        has = sizes[short] > j
        own[has] = mix(own[has]) + h[words.at[short[has]] + j] * U64(0x9E3779B97F4A7C15)
    own = keyed(own + sizes[short].astype(U64), 1000 + k)
    rows, values = np.concatenate([row[first], short]), np.concatenate([value, own])
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def distinct_by_row(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row: (offsets of length n + 1, values)."""
    values = values.copy()
    at = np.searchsorted(rows, np.arange(n + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=n))]).astype(np.int64)[: n + 1], values[keep]


# --- groups ------------------------------------------------------------------


def split_groups(df: DataFrame, key: str, member: str, block: int, name: str) -> DataFrame:
    """Rows of groups of two and more, with `group` and `side`.

    A group of over `block` rows is split into blocks by the hash of `member`;
    each block (side -1) and each pair of blocks (sides 0 and 1: pairs across
    them alone count) is a group of its own, so that no task holds more than
    about two blocks of it, and every pair of rows still meets once.
    """
    sizes = materialise(df.groupBy(key).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1"), name)
    dealt = df.join(sizes, key).withColumn("blocks", F.ceil(F.col("rows_of_key") / block).cast("int")).drop("rows_of_key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("other") == F.col("own"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("group", group).withColumn("side", side).drop("blocks", "own", "other", key)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column, `group`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        group = np.asarray(batch.column(0))
        start = int(np.searchsorted(group, group[-1]))
        if start or group[0] != np.asarray(held[0].column(0))[0]:
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, start)])
            held = [batch.slice(start)]
            if done.num_rows:
                yield done
    if held:
        yield pa.Table.from_batches(held)


def group_ranges(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of two and more equal neighbours."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]]), strict=True):
        if b - a > 1:
            yield int(a), int(b)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for the components of a symmetric adjacency matrix, lonely ones left out."""
    left = linked.any(1)
    out = []
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        inside = np.zeros(len(linked), bool)
        inside[i], front = True, np.array([i])
        while len(front):
            new = linked[front].any(0) & ~inside
            inside |= new
            front = np.flatnonzero(new)
        left &= ~inside
        out += [(int(i), int(j)) for j in np.flatnonzero(inside) if j != i]
    return out


# --- connected components ----------------------------------------------------


def _is_star_forest(edges: DataFrame) -> bool:
    """No node is both leaf (a) and centre (b), and each leaf has one centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > centre and leaf > 1 or leaf > 0 and centre > 0")
    return wrong.isEmpty()


#: Edges of a file that a round of `components` writes, up to the session's number of partitions.
FILE_EDGES = 1 << 14


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps; each round's edges are written to
    the shared folder, so no lineage grows and no edge reaches the driver, and the
    round before goes; few edges go to few files. A node's smallest neighbour comes from a partial aggregate;
    it is joined under a key of its own (`at`), so that both sides of the join are
    plain exchanges and Spark can split the edges of a hub. Edges with a null end
    are ignored; nodes without a proper edge are their own component.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    folder = shared_dir(spark, "edges")
    current = stored(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder)
    own = F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("at")
    for _ in range(rounds):
        if _is_star_forest(current):
            break
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).select(own, "low")
        large = both.join(low, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(own, "low")
        linked = large.join(low, F.col("a") == F.col("at"))
        small = linked.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, folder = folder, shared_dir(spark, "edges")
        files = current.count() // FILE_EDGES + 1  # a round makes at most twice its edges
        current = stored(small.coalesce(files) if files < default_partitions(spark) else small, folder)
        remove(spark, before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = leaves.union(centres)
    return found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


# --- connecting the members of groups -----------------------------------------


def connect(rows: DataFrame, payload: list[str], find: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]], *, block: int, bytes_column: str | None = None, most_bytes: int = 32 << 20, name: str = "groups") -> DataFrame:
    """Edges (a, b) that connect what is linked inside each group of rows(key, rep, *payload).

    find(rows, side) gives pairs of places that connect the linked rows of a table;
    side is all -1 (every pair counts), or 0 and 1 (only pairs across do). A group
    of at most `block` rows and `most_bytes` bytes is one call. A larger one is
    dealt into blocks, and each block meets the group's pivots (about a quarter of
    a block, drawn by hash), which is linear work. Members that this leaves outside
    the largest part of their group meet all of the group, block by block, so that
    no link between two parts is lost; where pivots connect a group, nothing is
    left. No task holds more than about two blocks.
    """
    size = F.sum(F.length(bytes_column)) / most_bytes if bytes_column else F.lit(0)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), size.alias("big")).where("n > 1")
    sizes = materialise(sizes.select("key", "n", F.ceil(F.greatest(F.col("n") / block, "big", F.lit(1))).cast("int").alias("blocks")), f"{name}-sizes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches):
            group, side, rep = (whole[c].to_numpy() for c in ("group", "side", "rep"))
            one, two = [], []
            for a, b in group_ranges(group):
                pairs = find(whole.slice(a, b - a), side[a:b])
                one += [int(rep[a + i]) for i, _ in pairs]
                two += [int(rep[a + j]) for _, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    def met(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("group", "side", "rep", *payload)
        return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(meet), "a long, b long").distinct()

    def drawn(n, seed: int):
        return F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")

    def places(side: int, to):
        return F.transform(to, lambda x: F.struct(F.lit(side).alias("side"), x.alias("at")))

    def spread(df: DataFrame, to) -> DataFrame:
        df = df.withColumn("place", F.explode(to))
        group = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "place.at"))
        return df.withColumns({"group": group, "side": F.col("place.side")})

    blocks = F.col("blocks")
    none = F.array().cast("array<int>")
    member = places(0, F.array(drawn(blocks, 0)))
    pivot = places(1, F.when(drawn(4 * blocks, 1) == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(none))
    first = rows.join(sizes.drop("n"), "key")
    first = materialise(met(spread(first, F.when(blocks == 1, places(-1, F.array(F.lit(0)))).otherwise(F.concat(member, pivot)))), name)
    hot = sizes.where("blocks > 1")
    if hot.isEmpty():
        return first
    found = components(first)
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # connects what `first` does, and needs no further round
    part = found.select(F.col("node").alias("rep"), "component")
    parted = rows.select("key", "rep").distinct().join(hot, "key").join(part, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    parted = materialise(parted, f"{name}-parts")
    counts = parted.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("top"), (F.sum("c") - F.max("c")).alias("rest"))
    counts = materialise(counts.where("rest > 0"), f"{name}-apart")
    if counts.isEmpty():
        return stars
    left = parted.join(counts, "key").withColumn("deals", F.ceil(blocks * F.col("rest") / F.col("n")).cast("int"))
    others = places(0, F.transform(F.sequence(F.lit(0), F.col("deals") - 1), lambda x: x * blocks + drawn(blocks, 0)))
    outside = places(1, F.when(F.col("part") != F.col("top"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: drawn(F.col("deals"), 2) * blocks + y)).otherwise(none))
    second = left.select("key", "rep", "blocks", F.concat(others, outside).alias("to")).join(rows, ["key", "rep"])
    return stars.union(materialise(met(spread(second, F.col("to"))), f"{name}-rest"))


# --- keys and the members that share them ---------------------------------------

#: Members of one key that a task deals by their key; what comes beyond is dealt by key and member.
MOST_OF_KEY = 256
_CELLS = 1 << 20


class Piler:
    """Deals (key, member) pairs of a task into piles, for `shared`.

    Pairs go to the pile of their key. A key of which this task has seen over
    MOST_OF_KEY pairs (counted in cells that several keys may share) is heavy: its
    further pairs are spread by key and member, and a mark in the key's pile says so.
    """

    def __init__(self, piles: int):
        self.piles, self.seen = piles, np.zeros(_CELLS, np.uint16)

    def deal(self, key: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        cell = (key >> U64(44)).astype(np.int64)
        count = np.bincount(cell, minlength=_CELLS)
        self.seen = np.minimum(self.seen + count, 65535).astype(np.uint16)
        heavy = self.seen[cell] > MOST_OF_KEY
        marks = np.unique(key[heavy])
        parts = [(0, key[~heavy], member[~heavy], key[~heavy]), (1, key[heavy], member[heavy], mix(key[heavy] ^ mix(member[heavy].astype(U64)))), (2, marks, np.zeros(len(marks), np.int64), marks)]
        out: list[tuple[int, int, bytes, bytes]] = []
        for kind, k, m, by in parts:
            pile = (by % U64(self.piles)).astype(np.int32)
            order = np.argsort(pile, kind="stable")
            k, m, pile = k[order].astype("<u8"), m[order].astype("<i8"), pile[order]
            used, first = np.unique(pile, return_index=True)
            ends = [*first[1:].tolist(), len(pile)][: len(first)]
            out += [(int(p), kind, k[a:b].tobytes(), m[a:b].tobytes()) for p, a, b in zip(used, first.tolist(), ends, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["pile", "kind", "keys", "members"])


PILE = "pile int, kind int, keys binary, members binary"


def shared(piled: DataFrame, parts: int) -> DataFrame:
    """(key, rep) for keys of two and more members, from the piles of `Piler`; equal groups of members share one key.

    A heavy key's pairs never meet in one task; its group may have one member only.
    """

    def joined(part: pa.Table, column: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(part[column].to_pylist()), kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches):
            pile, kinds = whole["pile"].to_numpy(), whole["kind"].to_numpy()
            cuts = np.flatnonzero(np.diff(pile)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pile)]]), strict=True):
                part, kind = whole.slice(int(a), int(b - a)), kinds[a:b]
                light, heavy, marks = (part.filter(pa.array(kind == k)) for k in (0, 1, 2))
                key, rep = joined(light, "keys", "<u8"), joined(light, "members", "<i8")
                order = np.lexsort((rep, key))
                key, rep = key[order], rep[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])
                key, rep = key[new], rep[new]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
                size = np.diff(np.append(begin, len(key)))
                group = np.add.reduceat(keyed(rep.astype(U64), 400), begin) if len(begin) else np.empty(0, U64)
                hot = np.isin(key[begin], np.unique(joined(marks, "keys", "<u8")))
                group = np.where(hot, keyed(key[begin], 401), group)
                many = np.flatnonzero((size > 1) | hot)
                many = many[np.unique(group[many], return_index=True)[1]]
                pick = np.isin(np.repeat(np.arange(len(begin)), size), many)
                more, who = keyed(joined(heavy, "keys", "<u8"), 401), joined(heavy, "members", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(group, size)[pick], more]).astype(np.int64)), pa.array(np.concatenate([rep[pick], who]))], ["key", "rep"])

    return piled.repartition(parts, "pile").sortWithinPartitions("pile").mapInArrow(tidy(meet), "key long, rep long").distinct()
