"""Operator 6: exact Jaccard self-join of word n-gram sets, reported as components.

Links are pairs of texts with 100 * |intersection| >= 85 * |union| (by default).
Equal sets are folded first. Sizes fall into bands so that linked sets lie in
the same or in neighbouring bands; a pair of neighbouring bands is a size group
with a largest possible symmetric difference H. The universe of shingle hashes
is partitioned into segments, and each segment of a group has a threshold: -1, it
is not indexed; 0, sets meet that agree on it; 1, sets meet that differ on it by
one element at most, found by indexing its part of the set (the subset) and the
subset's one-deletion neighbourhood. By the pigeonhole principle a set whose
thresholds t add up to sum(t + 1) > H over its filled segments meets every set
that it links with.

Thresholds are allocated by cost, for each size group, from key frequencies that
are measured over all sets: keys written, and pairs that would share one (second
moments, by sign sketches that tasks add up). Allocations start from two
partitions: one with spare segments, all with threshold 0, and one of H + 1
longer segments, in which some need threshold 1. In either the dearest segments
(a frequent shingle in a short segment) are left out where deletions elsewhere
cost less. As costs are estimates, an allocation must cost less than half of the
plain one to replace it.

Empty segments are never indexed. A set whose filled segments don't suffice is
indexed again under another partition, where only such sets need to meet; after
PARTITIONS of these its empty segments are indexed as well, so no link is lost.

Keys seen with one set only are dropped where they meet; a key of many sets never
meets in one task (`common.shared`). Sets that share a key are compared by size
and by a parity sketch (the number of differing bits never exceeds the symmetric
difference; sketches grow with the sets), which leaves candidate components; inside these the sets themselves
are intersected. Large groups are compared with pivots first, and only what
these leave apart meets the whole group (`common.connect`). Only spanning forests
leave a task, never the pairs of a group. Equality is that of 64-bit hashes.

Texts that are null or have no words have an empty set and link with nothing.
Repeated rows are linked copies; rows with one id and different texts share a
component. Rows without an id are left out; other columns are not read. A very
long text is one row of its own slice; a block of sets holds MOST_BYTES of
elements, or one set. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.common import PILE, U64, Piler, components, connect, default_partitions, distinct_by_row, forest, keyed, materialise, mix, prepare, shared, shingles, tidy, words_of

SKETCH_BITS, PARTITIONS, BLOCK, SET_BLOCK, MOST_BYTES = 512, 6, 2048, 512, 32 << 20
#: Bytes of text whose sets are handled at once.
SET_SLICE = 1_000_000
#: Segments of a size group are measured and allocated in so many classes; signs of a frequency sketch.
CLASSES, SIGNS = 64, 4
#: Cost of a pair that shares a key, in keys written; classes of equal sets whose copies the measure weighs down.
PAIR, COPIED = 0.02, 1 << 18


@dataclass
class Band:
    """The most that linked sets of a size group differ, and segments and thresholds (by class) of its first partition."""

    most: int
    spare: int
    segments: int
    levels: np.ndarray


class Allocation:
    """Bands of sizes and, for each size group (band g with band g + 1), how it is partitioned and indexed."""

    def __init__(self, percent: int, largest: int):
        self.percent, edges = percent, [1, 2]
        while edges[-2] <= largest + 1:
            e = edges[-1]
            edges.append(max(e + 1, (e - 1) * 100 // percent + 1))
        self.edges = np.array(edges, np.int64)
        self.low = self.edges[:-2]
        most = [differ_most(int(a) - 1, int(b) - 1, percent) for a, b in zip(self.edges[1:-1], self.edges[2:], strict=True)]
        self.bands = [Band(h, m := self.spare(h, h + 1, int(low)), m, np.zeros(CLASSES, np.int8)) for h, low in zip(most, self.low, strict=True)]
        self.arrays()

    def arrays(self) -> None:
        self.most, self.spares, self.segments = (np.array([getattr(b, n) for b in self.bands], np.int64) for n in ("most", "spare", "segments"))
        self.levels = np.array([b.levels for b in self.bands], np.int8).reshape(-1, CLASSES)

    @staticmethod
    def spare(h: int, m: int, low: int, grow: bool = True) -> int:
        """Units that sets of `low` elements need, their expected empty segments included."""
        need = h + 1
        for _ in range(8 if grow else 1):
            need = h + 2 + math.ceil(1.3 * m * math.exp(-low / m))
            m = need if grow else m
        return need

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def partitions(self, group: np.ndarray) -> list[np.ndarray]:
        """Numbers of segments of the two partitions that are measured."""
        return [self.spares[group], self.most[group] + 1]

    def allocate(self, keys: np.ndarray, pairs: np.ndarray) -> None:
        """Chooses by cost; keys and pairs: (groups, 2 partitions, CLASSES, 2 thresholds), totals over all sets."""
        cost = keys + PAIR * pairs
        for g, band in enumerate(self.bands):
            plain = cost[g, 0, :, 0].sum()
            if band.most == 0 or not plain:
                continue
            best = plain / 2
            for p, (m, need) in enumerate(((band.spare, band.spare), (band.most + 1, self.spare(band.most, band.most + 1, int(self.low[g]), False)))):
                if (found := cheapest(cost[g, p], np.bincount(np.arange(m) % CLASSES, minlength=CLASSES), need)) is not None and found[0] < best:
                    best, band.segments, band.levels = found[0], m, found[1]
        self.arrays()


def cheapest(cost: np.ndarray, segments: np.ndarray, need: int) -> tuple[float, np.ndarray] | None:
    """(cost, thresholds) of classes of segments whose units, segments * (threshold + 1), reach `need`; None if they can't.

    Steps are taken by their cost for each unit (a class's two steps at once
    where the second is the cheaper one), then the dearest ones that the sum can
    spare are taken back.
    """
    steps = []
    for j in np.flatnonzero(segments):
        zero, one = float(cost[j, 0]), float(max(cost[j].max(), cost[j, 0]))
        n = int(segments[j])
        steps += [(one / 2 / n, int(j), 2, n)] if one < 2 * zero else [(zero / n, int(j), 1, n), ((one - zero) / n, int(j), 1, n)]
    steps.sort()
    levels, units, taken = np.full(len(segments), -1, np.int8), 0, []
    for price, j, up, n in steps:
        if units >= need:
            break
        levels[j] += up
        units += up * n
        taken.append((price, j, up, n))
    if units < need:
        return None
    for _, j, up, n in reversed(taken):
        if up * n <= units - need and levels[j] >= up - 1:
            levels[j] -= up
            units -= up * n
    return sum(float(cost[j, max(levels[j], 0)]) for j in np.flatnonzero(levels >= 0)), levels


def differ_most(a, b, percent: int):
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def _sets(column: pa.Array, k: int):
    for lo, hi, words in words_of(column, SET_SLICE):
        at, values = distinct_by_row(*shingles(words, k), hi - lo)
        yield lo, hi, at, values


def _sum_by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return sums[at[1:]] - sums[at[:-1]]


def sketch_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of a set's sketch: a power of two, four times the most that it differs from a linked one, SKETCH_BITS at least."""
    most = np.maximum(differ_most(n, n * 100 // percent, percent), SKETCH_BITS // 4)
    return 1 << np.ceil(np.log2(4 * most)).astype(np.int64)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the bits of the shortest: of a power of two, halves add up by parity."""
    least, out = min(map(len, sketches)), np.empty((len(sketches), min(map(len, sketches))), np.uint8)
    for i, raw in enumerate(sketches):
        own = np.frombuffer(raw, np.uint8)
        while len(own) > least:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        out[i] = own
    return out.view("<u8")


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, sid, more, sketch): size, two hashes of the set, and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, at, values in _sets(batch.column(1), k):
                n = np.diff(at)
                sid, more = (_sum_by_row(keyed(values, s), at).astype(np.int64) for s in (1, 2))
                width, place = sketch_bits(n, percent), keyed(values, 3)
                begin = np.concatenate([[0], np.cumsum(width)])
                index = np.repeat(begin[:-1], n) + (place & np.repeat(width - 1, n).astype(U64)).astype(np.int64)
                raw = np.packbits(np.bincount(index, minlength=begin[-1]).astype(np.uint8) & 1)
                sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((begin // 8).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sid), pa.array(more), sketch], ["doc_id", "n", "sid", "more", "sketch"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, sid long, more long, sketch binary")


class Segments:
    """The segments of some sets under one partition: cells numbered set by set; sets of no segments have none."""

    def __init__(self, at: np.ndarray, values: np.ndarray, group: np.ndarray, number: np.ndarray, seed: int):
        base = np.concatenate([[0], np.cumsum(number)])
        owner = np.repeat(np.arange(len(number)), np.diff(at))
        mine = number[owner] > 0
        self.owner, v = owner[mine], values[mine]
        self.cell = base[self.owner] + ((keyed(v, 100 + seed) >> U64(32)) * number[self.owner].astype(U64) >> U64(32)).astype(np.int64)
        self.filled = np.bincount(self.cell, minlength=base[-1])
        self.value = keyed(v, 200)
        self.total = np.zeros(base[-1], U64)
        np.add.at(self.total, self.cell, self.value)
        self.row = np.repeat(np.arange(len(number)), number)
        self.within = np.arange(base[-1]) - base[self.row]
        self.salt = keyed((group[self.row] * (PARTITIONS + 1) + seed).astype(U64) << U64(32) | self.within.astype(U64), 300)

    def subsets(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, sets) of the segments `use`."""
        return mix(self.total[use] + self.salt[use] + self.filled[use].astype(U64)), self.row[use]

    def deletions(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, sets, cells) of the one-deletion neighbourhoods of the segments `use`: keys of the subsets that are left."""
        picked = use[self.cell]
        cell = self.cell[picked]
        return mix(self.total[cell] - self.value[picked] + self.salt[cell] + (self.filled[cell] - 1).astype(U64)), self.owner[picked], cell


def set_keys(at: np.ndarray, values: np.ndarray, sids: np.ndarray, alloc: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sids) under which sets are indexed.

    A segment of threshold 1 is worth two units only if it holds two elements or
    more: what differs from it by one element then has one at least, so that the
    neighbourhoods hold no empty subset.
    """
    n = np.diff(at)
    band = alloc.band(n)
    keys, who = [], []
    for lower in (0, 1):
        group = band - lower
        live = (n > 0) & (group >= 0)
        live[live] = alloc.most[group[live]] > 0  # else only equal sets link, and those are folded
        for seed in range(PARTITIONS + 1):
            if not live.any():
                break
            own = np.maximum(group, 0)
            cut = Segments(at, values, own, np.where(live, (alloc.spares if seed else alloc.segments)[own], 0), seed)
            level = np.zeros(len(cut.row), np.int8) if seed else alloc.levels[own[cut.row], cut.within % CLASSES]
            use = (cut.filled > 0) & (level >= 0)
            near = use & (level == 1) & (cut.filled > 1)
            units = np.bincount(cut.row[use], minlength=len(n)) + np.bincount(cut.row[near], minlength=len(n))
            enough = units > alloc.most[own]
            if seed == PARTITIONS:
                use |= ~enough[cut.row]
            for found in (cut.subsets(use), cut.deletions(near)[:2]):
                keys.append(found[0])
                who.append(sids[found[1]])
            live &= ~enough
    return (np.concatenate(keys), np.concatenate(who)) if keys else (np.empty(0, U64), np.empty(0, np.int64))


def measure(at: np.ndarray, values: np.ndarray, weight: np.ndarray, alloc: Allocation, into: np.ndarray) -> None:
    """Adds up, in into[cell] for cells (group, partition, class): subsets, deletions, and their sums of signs.

    Each set is measured once, in the group of which its band is the lower one.
    """
    n = np.diff(at)
    group = alloc.band(n)
    live = n > 0
    live[live] = alloc.most[group[live]] > 0
    if not live.any():
        return
    own = np.maximum(group, 0)
    for p, number in enumerate(alloc.partitions(own)):
        cut = Segments(at, values, own, np.where(live, number, 0), 0)
        place = (own[cut.row] * 2 + p) * CLASSES + cut.within % CLASSES
        keys, rows = cut.subsets(use := cut.filled > 0)
        more, owners, cells = cut.deletions(cut.filled > 1)
        for k, (key, cell, w) in enumerate(((keys, place[use], weight[rows]), (more, place[cells], weight[owners]))):
            into[:, k] += np.bincount(cell, w, len(into))
            bits = keyed(key, 600)
            for s in range(SIGNS):
                into[:, 2 + k * SIGNS + s] += np.bincount(cell, np.where(bits >> U64(s) & U64(1), w, -w), len(into))


def measured(docs: DataFrame, known: DataFrame, k: int, alloc: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pairs) for Allocation.allocate, over all sets.

    Copies count as one set: each of c copies weighs 1/c, for the COPIED most
    copied sets; copies of others weigh 1 each, which can only blur an estimate.
    """
    spark = docs.sparkSession
    copied = known.where("n > 0").groupBy("sid").count().where("count > 1").orderBy(F.desc("count"), "sid").limit(COPIED).toPandas().sort_values("sid")
    shared_copies = spark.sparkContext.broadcast((copied["sid"].to_numpy().astype(np.int64), 1.0 / copied["count"].to_numpy().astype(float)))
    cells, width = len(alloc.bands) * 2 * CLASSES, 2 + 2 * SIGNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, share = shared_copies.value
        into = np.zeros((cells, width))
        for batch in batches:
            for _, _, at, values in _sets(batch.column(0), k):
                own = _sum_by_row(keyed(values, 1), at).astype(np.int64)
                weight = np.ones(len(own))
                if len(sid):
                    place = np.minimum(np.searchsorted(sid, own), len(sid) - 1)
                    weight = np.where(sid[place] == own, share[place], 1.0)
                measure(at, values, weight, alloc, into)
        used = np.flatnonzero(into.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(into[used, i]) for i in range(width)]], ["cell", *[f"v{i}" for i in range(width)]])

    names = [f"v{i}" for i in range(width)]
    sums = docs.select("text").mapInArrow(tidy(run), "cell long, " + ", ".join(f"{n} double" for n in names)).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    rows = sums.toPandas()  # a row for each size group and class at most
    table = np.zeros((cells, width))
    table[rows["cell"].to_numpy().astype(np.int64)] = rows[names].to_numpy()
    whole = table[:, 0] + table[:, 1]
    zero = (table[:, 2 : 2 + SIGNS] ** 2).mean(1)
    one = ((table[:, 2 : 2 + SIGNS] + table[:, 2 + SIGNS :]) ** 2).mean(1)
    keys = np.stack([table[:, 0], whole], 1)
    pairs = np.maximum(np.stack([zero, one], 1) - keys, 0) / 2
    return keys.reshape(-1, 2, CLASSES, 2), pairs.reshape(-1, 2, CLASSES, 2)


def indexed(docs: DataFrame, k: int, alloc: Allocation, parts: int) -> DataFrame:
    """Piles of (key, sid) for every set."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        piler = Piler(16 * parts)
        for batch in batches:
            for _, _, at, values in _sets(batch.column(0), k):
                sids = _sum_by_row(keyed(values, 1), at).astype(np.int64)
                fresh = np.array([not (s in seen or seen.add(s)) for s in sids.tolist()], bool) & (np.diff(at) > 0)
                if len(seen) > 500_000:
                    seen.clear()
                keep = np.repeat(fresh, np.diff(at))
                own = np.concatenate([[0], np.cumsum(np.diff(at)[fresh])])
                yield piler.deal(*set_keys(own, values[keep], sids[fresh], alloc))

    return docs.select("text").mapInArrow(tidy(index), PILE)


def sketch_links(sketch: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that sizes and sketches don't rule out; with sides 0 and 1 only pairs across them."""
    out = np.zeros((len(n), len(n)), bool)
    cross = side[0] >= 0
    rows, columns = (np.flatnonzero(side == 1), np.flatnonzero(side == 0)) if cross else (np.arange(len(n)),) * 2
    for a in range(0, len(rows), 256):
        own = rows[a : a + 256]
        bits = np.zeros((len(own), len(columns)), np.int64)
        for w in range(sketch.shape[1]):
            bits += np.bitwise_count(sketch[own, w][:, None] ^ sketch[columns, w][None, :])
        x, y = n[own][:, None], n[columns][None, :]
        out[np.ix_(own, columns)] = (bits <= differ_most(x, y, percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    np.fill_diagonal(out, False)
    return out | out.T if cross else out


def set_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets that are linked, by exact intersection."""
    n = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), n)
    common = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[common]]
    rows, width = rows[common], int((count > 1).sum())
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), min(4096, width - a)), np.float32)
        part[rows[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)  # below 2**24, so exact
    out = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(out, False)
    if side[0] >= 0:
        out &= side[:, None] != side[None, :]
    return out


def components_of(df: DataFrame, *, k: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row with an id."""
    spark = df.sparkSession
    prepare(spark)
    parts = default_partitions(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null")
    known = materialise(profiles(docs, k, percent), "profiles")
    classes = known.where("n > 0").groupBy("sid", "n", "more").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    alloc = Allocation(percent, known.agg(F.max("n")).first()[0] or 1)
    alloc.allocate(*measured(docs, known, k, alloc))

    def alike(rows: pa.Table, side: np.ndarray) -> list[tuple[int, int]]:
        return forest(sketch_links(folded(rows["sketch"].to_pylist()), rows["n"].to_numpy(), side, percent))

    met = materialise(shared(indexed(docs, k, alloc, parts), parts).withColumnRenamed("rep", "sid"), "keys")
    met = met.join(classes.select("sid", "n", "rep", "sketch"), "sid").select("key", "rep", "n", "sketch")
    near = connect(met, ["n", "sketch"], alike, block=BLOCK, bytes_column="sketch", most_bytes=MOST_BYTES // 8, name="candidates")
    grouped = materialise(components(near), "candidate-components")

    # the sets of candidates, each from its representative's text
    wanted = grouped.join(classes.select(F.col("rep").alias("node"), "sid"), "node").select(F.col("node").alias("doc_id"), "component", "sid")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_sid, component = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for lo, hi, at, values in _sets(batch.column(1), k):
                same = _sum_by_row(keyed(values, 1), at).astype(np.int64) == wanted_sid[lo:hi]
                raw = [values[at[i] : at[i + 1]].astype("<u8").tobytes() for i in np.flatnonzero(same)]
                keep = pa.array(same)
                yield pa.RecordBatch.from_arrays([pa.array(component[lo:hi]).filter(keep), batch.column(0).slice(lo, hi - lo).filter(keep), pa.array(raw, pa.binary())], ["key", "rep", "elements"])

    def linked(rows: pa.Table, side: np.ndarray) -> list[tuple[int, int]]:
        return forest(set_links([np.frombuffer(x, "<u8") for x in rows["elements"].to_pylist()], side, percent))

    sets = materialise(docs.join(wanted, "doc_id").select("doc_id", "text", "sid", "component").mapInArrow(tidy(gather), "key long, rep long, elements binary"), "sets")
    final = components(connect(sets, ["elements"], linked, block=SET_BLOCK, bytes_column="elements", most_bytes=MOST_BYTES, name="links"))

    found = classes.select("sid", "n", "more", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("sid", "n", "more", F.coalesce("component", "rep").alias("component"))
    out = known.select("doc_id", "n", "sid", "more").join(found, ["sid", "n", "more"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, *, k: int = 4, percent: int = 85) -> DataFrame:
    """df's rows, with all columns, but of each component only that with the smallest doc_id; rows without an id stay."""
    found = components_of(df, k=k, percent=percent)
    kept = materialise(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    once = df.join(kept.where("copies = 1"), "doc_id", "left_semi")
    more = df.join(kept.where("copies > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(df.where("doc_id is null"))
