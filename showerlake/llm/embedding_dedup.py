"""Operator 10: near-duplicate vectors by Euclidean p-stable hashing.

Equal vectors of a label are first folded into one class with a weight.
Normalised vectors are projected on Gaussian directions, each place is cut into
steps of width STEP, and k steps with the label make a bucket key in each of L
tables. k grows with the logarithm of the largest label's number of classes, so
that unrelated vectors meet about once in MATES tables; L follows from k, so that
two vectors at the threshold share a bucket in some table with probability
1 - MISS (`tables`). Keys alone are shuffled for all tables; vectors are joined
to the keys of two and more classes.

In a bucket all cosines are computed at once; a pair is judged only in the first
table in which it meets, so link counts are exact for the pairs found, and a
bucket reports counts and a spanning forest, never its pairs. Buckets over BLOCK
classes are split into blocks, and each pair of blocks is a bucket of its own:
counting the links of a hot group of n different vectors takes n * n / 2 products.

Vectors that are null, zero or hold null or non-finite components, or have no
label, link with nothing and are kept; vectors of different lengths don't link.
Repeated rows count as linked copies. Rows of one id share a component; each has
the links of its own vector. Rows without an id are left out, other columns are
not read, and an empty table gives no rows. Equality is that of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.common import components, forest, group_ranges, keyed, materialise, mix, prepare, split_groups, tidy, whole_groups
from showerlake.llm.vectors import lengths, matrix, packed, precision, unpacked

STEP, MISS, MATES, BLOCK = 1.5, 0.003, 0.25, 2048


def same_step(distance: float, step: float = STEP) -> float:
    """Probability that two points at a distance fall into one step of a random projection."""
    r = step / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables(threshold: float, most: int) -> tuple[int, int]:
    """(k, L) for labels of up to `most` classes: see the module's text."""
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(most, 1) / MATES) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


class Hasher:
    """Bucket keys of normalised vectors of one length in every table."""

    def __init__(self, size: int, k: int, number: int, seed: int = 10):
        rng = np.random.default_rng([seed, size])
        self.k, self.number = k, number
        self.directions = rng.standard_normal((size, number * k))  # double precision, so that no product's rounding moves a step
        self.shifts = rng.uniform(0, STEP, number * k)

    def keys(self, unit: np.ndarray, labels: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Keys in the first `upto` tables."""
        number = self.number if upto is None else upto
        n = number * self.k
        out = np.empty((len(unit), number), np.uint64)
        for a in range(0, len(unit), 1024):
            part = np.floor((unit[a : a + 1024] @ self.directions[:, :n] + self.shifts[:n]) / STEP)
            steps = part.astype(np.int64).astype(np.uint64).reshape(-1, number, self.k)
            key = keyed(labels[a : a + 1024].astype(np.int64).astype(np.uint64), 40)[:, None] + np.arange(number, dtype=np.uint64)
            key = key + np.uint64(unit.shape[1] << 20)
            for j in range(self.k):
                key = mix(key) + steps[:, :, j]
            out[a : a + 1024] = mix(key)
        return out


def links(df: DataFrame, *, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an id."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("embedding")).where("vec_id is not null")
    kind = precision(rows, "embedding")

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in np.unique(lengths(batch.column(2))):
                own = batch.filter(pa.array(lengths(batch.column(2)) == size))
                good, vectors = matrix(own.column(2), int(size))
                good &= np.asarray(own.column(1).is_valid())
                if good.any():
                    vectors = matrix(own.column(2).filter(pa.array(good)), int(size))[1] + 0.0  # no negative zeros
                    yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(good)) for c in own.columns[:2]), packed(vectors, kind)], ["vec_id", "label", "vector"])
                if not good.all():
                    rest = own.filter(pa.array(~good))
                    yield pa.RecordBatch.from_arrays([*rest.columns[:2], pa.nulls(rest.num_rows, pa.binary())], ["vec_id", "label", "vector"])

    cid = F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")).alias("cid")
    made = rows.mapInArrow(tidy(usable), "vec_id long, label long, vector binary").select("vec_id", "label", cid, "vector")
    folded = made.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    folded = materialise(folded, "vectors")
    most = folded.groupBy("label", F.length("vector")).count().agg(F.max("count")).first()[0] or 1
    k, number = tables(threshold, most)

    def unit_rows(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, vectors) of each length; those of one bucket have one length unless hashes collide."""
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        return [(at := np.flatnonzero(sizes == s), unpacked(column.take(pa.array(at)), kind)) for s in np.unique(sizes)]

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for at, vectors in by_length(batch.column(2)):
                size = vectors.shape[1]
                hasher = hashers.setdefault(size, hashers.get(size) or Hasher(size, k, number))
                keys = hasher.keys(unit_rows(vectors), np.asarray(batch.column(1))[at])
                own = np.asarray(batch.column(0))[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.tile(np.arange(number, dtype=np.int32), len(own))), pa.array(np.repeat(own, number))], ["key", "tab", "cid"])

    spread = folded.select("cid", "label", "vector").mapInArrow(tidy(bucket), "key long, tab int, cid long")
    dealt = split_groups(spread, "key", "cid", BLOCK, "buckets").join(folded, "cid").select("group", "tab", "side", "cid", "label", "rep", "weight", "vector")

    def judge(hasher: Hasher, label, weight, side, table, unit):
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if side[0] >= 0:  # two blocks of a large bucket: only pairs across
            linked &= side[:, None] != side[None, :]
        i, j = np.nonzero(linked)
        if len(i) and table:
            some, back = np.unique(i, return_inverse=True)  # links are symmetric, so these are all ends
            own, at_j = hasher.keys(unit[some], label[some], table), np.searchsorted(some, j)
            for a in range(0, len(i), 1 << 17):
                met = (own[back[a : a + (1 << 17)]] == own[at_j[a : a + (1 << 17)]]).any(1)
                linked[i[a : a + (1 << 17)][met], j[a : a + (1 << 17)][met]] = False
        return linked @ weight, forest(linked)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        names = ["group", "tab", "side", "cid", "label", "rep", "weight"]
        for whole in whole_groups(batches):
            group, tab, side, cid, label, rep, weight = (whole[n].to_numpy() for n in names)
            one, two, number_of, classes = [], [], [], []
            for a, b in group_ranges(group):
                for at, vectors in by_length(whole["vector"].slice(a, b - a).combine_chunks()):
                    if len(at) < 2:
                        continue
                    size, at = vectors.shape[1], at + a
                    hasher = hashers.setdefault(size, hashers.get(size) or Hasher(size, k, number))
                    n, pairs = judge(hasher, label[at], weight[at], side[at], int(tab[a]), unit_rows(vectors))
                    some = np.flatnonzero(n)
                    classes += [*cid[at[some]].tolist(), *[None] * len(pairs)]
                    one += [*[None] * len(some), *(int(rep[at[x]]) for x, _ in pairs)]
                    two += [*[None] * len(some), *(int(rep[at[y]]) for _, y in pairs)]
                    number_of += [*n[some].tolist(), *[None] * len(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (classes, number_of, one, two)], ["cid", "n", "a", "b"])

    # a stream of whole buckets: memory is that of the largest, which is two blocks
    met = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(meet), "cid long, n long, a long, b long")
    met = materialise(met, "links")
    # ids with vectors of several classes connect these
    member = made.where("cid is not null").select("vec_id", "cid").distinct().join(folded.select("cid", "rep"), "cid")
    several = member.groupBy("vec_id").agg(F.min("rep").alias("low"), F.count("*").alias("classes")).where("classes > 1").select("vec_id", "low")
    bridges = member.join(several, "vec_id").select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b")
    joined = components(met.where("a is not null").select("a", "b").union(bridges)).withColumnRenamed("node", "rep")
    number_of = met.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    per = folded.select("cid", "rep", "weight").join(number_of, "cid", "left").join(joined, "rep", "left")
    per = per.select("cid", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    ids = member.select("vec_id", "cid").join(per.select("cid", "part"), "cid").groupBy("vec_id").agg(F.min("part").alias("component_id"))
    out = made.select("vec_id", "cid").join(per.select("cid", "n_links"), "cid", "left").join(ids, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
