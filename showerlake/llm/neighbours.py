"""Operator 9: approximate nearest neighbours by shifted space-filling curves.

Several Hilbert curves order the vectors, each by another few directions, turned
and shifted (principal directions, fitted on a bounded sample). A curve is cut
into blocks of about equal size; a query meets the rows of its own block and of
the blocks around it, a window of the curve in all, keeps its `k` nearest of each
block, and the finds of all curves are merged and ranked again. Inner products
are taken on the original vectors in double precision.

The window is a share of the curve, and holds LEAST * k rows at least. Unless it
is given, it is the smallest of WINDOWS at which the curves find RECALL of the
nearest neighbours inside the sample (`fitted_window`). Neighbours get closer as
a table grows, so the whole table's recall is the better one. Data with structure
get a narrow window; nearly isotropic data of many dimensions get about half of
each curve, as no curve tells their neighbours apart: work then grows with
queries times rows.

Queries stream past a block's rows, so that memory is that of one block. Vectors
that are null, zero or hold null or non-finite components take no part, neither do
those of another than the commonest length or without an id. Equal vectors are
ranked by id; an id that occurs twice is found once. Other columns are not read.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerlake.llm.common import keyed, prepare, tidy
from showerlake.llm.hilbert import hilbert_key
from showerlake.llm.vectors import matrix, packed, precision, unpacked, width

#: Bound of the sample that directions are fitted on; sampled keys for each block of a curve.
SAMPLE, KEYS_PER_BLOCK = 4096, 40
CURVES, DIMENSIONS, BITS, BLOCK_ROWS, MIN_BLOCKS = 4, 6, 8, 4096, 14
#: Windows to choose from; recall that the sample must show; queries of the sample; rows that a window holds at least, for each neighbour asked for.
WINDOWS, RECALL, ASKED, LEAST = (0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8), 0.96, 256, 16


class Curves:
    def __init__(self, sample: np.ndarray, curves: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0) if len(unit) else np.zeros(d)
        _, _, axes = np.linalg.svd(np.vstack([unit - self.mean, np.zeros((d, d))]), full_matrices=False)
        n = min(DIMENSIONS, d)
        self.parts = []
        for c in range(curves):
            own = axes[(np.arange(n) + c * n) % d] if d >= n * curves else axes[rng.permutation(d)[:n]]
            turn, _ = np.linalg.qr(rng.standard_normal((n, n)))
            self.parts.append((turn @ own, rng.uniform(0, 1 / 8, n)))
        across = (unit - self.mean) @ self.parts[0][0].T if len(unit) else np.zeros((1, n))
        self.scale = max(float(across.std()) * 8, 1e-12)

    def keys(self, rows: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Place on the curve, and below it 15 bits of the id's hash, by which equal vectors part."""
        axes, shift = self.parts[curve]
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        cells = np.clip((((unit - self.mean) @ axes.T) / self.scale + 0.5 + shift) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
        return (hilbert_key(cells, BITS) << np.uint64(15) | keyed(ids.astype(np.uint64), 3) >> np.uint64(49)).astype(np.int64)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k rows of other ids with the largest inner product, ties to smaller ids."""
    out = []
    for a in range(0, len(queries), 256):
        near = queries[a : a + 256] @ rows.T
        near[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        for i, own in enumerate(near):
            n = min(k, int(np.isfinite(own).sum()))
            if not n:
                continue
            least = -np.partition(-own, n - 1)[n - 1]
            picked = np.flatnonzero(own >= least - 1e-9 * max(1.0, abs(least)))
            picked = picked[np.isfinite(own[picked])]
            exact = (queries[a + i] * rows[picked]).sum(1)
            order = np.lexsort((ids[picked], -exact))[:n]
            out.append((np.full(n, query_ids[a + i]), ids[picked][order], exact[order]))
    return out


def fitted_window(made: Curves, sample: np.ndarray, curves: int, k: int, recall: float = RECALL) -> float:
    """The smallest window at which the curves find `recall` of the k nearest rows of the sample's first ASKED rows."""
    n = len(sample)
    asked, k = min(ASKED, n), min(k, n - 1)
    if k < 1:
        return 1.0
    near = sample[:asked] @ sample.T
    near[np.arange(asked), np.arange(asked)] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    places = np.empty((curves, n))
    for c in range(curves):
        places[c, np.argsort(made.keys(sample, np.arange(n), c), kind="stable")] = (np.arange(n) + 0.5) / n
    for window in WINDOWS:
        low = np.clip(places[:, :asked, None] - window / 2, 0, 1 - window)
        found = (places[:, best] >= low) & (places[:, best] <= low + window)
        if found.any(0).mean() >= recall:
            return window
    return 1.0


def search(df: DataFrame, *, k: int = 20, every: int = 20, curves: int = CURVES, window: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` its k nearest others found."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")).where("vec_id is not null")
    size, kind = width(rows, "embedding"), precision(rows, "embedding")
    chosen = rows.orderBy(F.crc32(F.concat(F.lit("curve "), F.col("vec_id").cast("string")).cast("binary")), "vec_id").limit(SAMPLE).toArrow()
    _, sample = matrix(chosen["embedding"].combine_chunks() if chosen.num_rows else pa.array([], pa.list_(pa.float64())), size)
    made = Curves(sample, curves) if len(sample) else None
    total = max(1, rows.count())
    blocks = max(MIN_BLOCKS, -(-total // BLOCK_ROWS))
    window = window or (fitted_window(made, sample, curves, k) if made else 1.0)
    reach = min(blocks, math.ceil(blocks * max(window, LEAST * k / total)))
    broadcast = spark.sparkContext.broadcast(made)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, vectors = matrix(batch.column(1), size)
            ids = np.asarray(batch.column(0))[usable]
            if not len(ids):
                continue
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(broadcast.value.keys(vectors, ids, c)), pa.array(ids), packed(vectors, kind)], ["curve", "key", "vec_id", "vector"])

    placed = rows.mapInArrow(tidy(place), "curve int, key long, vec_id long, vector binary")
    edges: dict[int, np.ndarray] = {c: np.empty(0, np.int64) for c in range(curves)}
    rate = min(1.0, KEYS_PER_BLOCK * blocks / total)
    keys = placed.where(F.crc32(F.concat(F.lit("key "), F.col("vec_id").cast("string")).cast("binary")) < int(rate * 2**32)).select("curve", "key").toPandas()
    for c, own in keys.groupby("curve")["key"]:
        edges[int(c)] = np.quantile(own.to_numpy(), np.arange(1, blocks) / blocks, method="nearest")
    bounds = spark.sparkContext.broadcast(edges)  # 8 bytes for each block of BLOCK_ROWS rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curve, ids = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            block = np.zeros(len(ids), np.int64)
            for c, own in bounds.value.items():
                block[curve == c] = np.searchsorted(own, np.asarray(batch.column(1))[curve == c], side="right")
            asks = np.flatnonzero(ids % every == 0)
            first = np.clip(block[asks] - reach // 2, 0, blocks - reach)
            at = np.concatenate([np.arange(len(ids)), np.repeat(asks, reach)])
            to = np.concatenate([block, (first[:, None] + np.arange(reach)).ravel()])
            role = np.arange(len(at)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(curve[at].astype(np.int64) * blocks + to), pa.array(role), batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))], ["group", "asks", "vec_id", "vector"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group first its rows come, then its queries, which are answered as they come."""
        held, ids, vectors = None, np.empty(0, np.int64), np.empty((0, size))
        for batch in batches:
            group, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if a == b:
                    continue
                if group[a] != held:
                    held, ids, vectors = group[a], np.empty(0, np.int64), np.empty((0, size))
                own, part = batch.column(2).to_numpy()[a:b], unpacked(batch.column(3).slice(a, b - a), kind)
                if not asks[a]:
                    ids, vectors = np.concatenate([ids, own]), np.concatenate([vectors, part])
                elif found := nearest(part, own, vectors, ids, k) if len(ids) else []:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    dealt = placed.mapInArrow(tidy(deal), "group long, asks boolean, vec_id long, vector binary")
    found = dealt.repartition("group").sortWithinPartitions("group", "asks").mapInArrow(tidy(meet), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
