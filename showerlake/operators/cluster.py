"""Compression by clustering: a grouped map makes labels, native aggregates do the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerlake.functions import kernels
from showerlake.functions.cellid import field, parse_encoding, unsigned_order
from showerlake.operators.merge import Result, need, numbered, stats, weighted_merge

SCOPES = ("none", "layer", "system_layer", "cell_id", "cell_id_neighbour")


def ward_clusterer(threshold: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    return lambda points: kernels.ward(points, threshold)


@dataclass
class ClusterWithinCell:
    """Points of each cell grouped by a clusterer (points -> labels); ValueError or one point: each on its own.

    A negative label is a cluster of its own.
    """

    clusterer: Callable[[np.ndarray], np.ndarray]
    buckets: int = 4

    def labelled(self, steps: DataFrame) -> DataFrame:
        clusterer = self.clusterer

        def one_cell(points: np.ndarray) -> np.ndarray:
            n = len(points)
            try:
                label = np.asarray(clusterer(points)) if n > 1 else np.zeros(n, int)
            except ValueError:
                label = np.arange(n)
            label = np.where(label < 0, label.max(initial=0) + 1 + np.arange(n), label)
            return np.unique(label, return_inverse=True)[1].astype(np.int64)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["cell_id", "point_index"])
            points, cells = pdf[["x", "y", "z"]].to_numpy(np.float64), pdf["cell_id"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            local = np.concatenate([one_cell(p) for p in np.split(points, cuts)])
            return pdf.drop(columns="bucket").assign(local=local)

        # cells share grouped maps, as a call for each cell would cost more than its work
        columns = [c for c in ("shower_id", "cell_id", "point_index", "x", "y", "z", "e", "t") if c in steps.columns]
        schema = ", ".join(f"{c} {steps.schema[c].dataType.simpleString()}" for c in columns) + ", local bigint"
        bucket = F.pmod(F.xxhash64("cell_id"), F.lit(self.buckets)).alias("bucket")
        return steps.select(*columns, bucket).groupBy("shower_id", "bucket").applyInPandas(run, schema)

    def compress(self, steps: DataFrame) -> Result:
        need(steps, "cell_id", "cluster_within_cell")
        marked = self.labelled(steps)
        order = [unsigned_order("cell_id"), "local"]
        points = numbered(weighted_merge(marked, ["cell_id", "local"]), order).drop("local", "n_merged")
        rank = F.dense_rank().over(Window.partitionBy("shower_id").orderBy(*order)) - 1
        labels = marked.select("shower_id", "point_index", rank.cast("bigint").alias("cluster_label"))
        return Result(points, stats(steps, points), labels, "cluster_within_cell", {})


def cell_field(encoding: str | dict[int, str], *names: str):
    """The first of the fields `names` that an encoding has, without sign, as a column.

    With an encoding for each subdetector, that of the deposit's; others fail the job.
    """
    def one(text: str):
        fields = parse_encoding(text)
        return field("cell_id", fields, next((n for n in names if n in fields), names[-1]), signed=False)

    if not isinstance(encoding, dict):
        return one(encoding)
    out = None
    for k, text in encoding.items():
        own = F.col("subdetector") == k
        out = F.when(own, one(text)) if out is None else out.when(own, one(text))
    return out.otherwise(F.raise_error(F.concat(F.lit("no encoding for subdetector "), F.coalesce(F.col("subdetector").cast("string"), F.lit("null")))).cast("bigint"))


def neighbour_components(steps: DataFrame, encoding: str | dict[int, str]) -> DataFrame:
    """(shower_id, cell_id, part): occupied cells joined over their four neighbours in a (system, layer).

    Field values are read without sign, so -1 and 0 are no neighbours. `part` is
    the smallest cell, in unsigned order, that is reachable. With an encoding for
    each subdetector there are the columns `subdetector`, by which cells are told
    apart and decoded, and `plane`, which with `part` names the part.
    """
    several = isinstance(encoding, dict)
    for text in encoding.values() if several else [encoding]:
        fields = parse_encoding(text)
        for name in ("system", "layer", "x", "y" if "y" in fields else "z"):
            if name not in fields:
                raise ValueError(f"the encoding has no field {name!r}")
    keys = ["shower_id", *(["subdetector"] if several else []), "cell_id"]
    decoded = {"system": ("system",), "layer": ("layer",), "u": ("x",), "v": ("y", "z")}
    placed = steps.select(*keys).distinct().withColumns({k: cell_field(encoding, *names) for k, names in decoded.items()})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["cell_id"].to_numpy().view(np.uint64), kind="stable")
        pdf = pdf.iloc[order]
        at = {}
        for i, key in enumerate(zip(pdf["u"], pdf["v"], strict=True)):
            at.setdefault(key, i)
        first = np.arange(len(pdf))
        for i, key in enumerate(zip(pdf["u"], pdf["v"], strict=True)):
            first[i] = at[key]

        def find(i: int) -> int:
            while first[i] != i:
                first[i] = first[first[i]]
                i = first[i]
            return i

        for (u, v), i in at.items():
            for other in (at.get((u + 1, v)), at.get((u, v + 1))):
                if other is not None:
                    p, q = find(i), find(other)
                    first[max(p, q)] = min(p, q)
        top = [find(i) for i in range(len(pdf))]
        return pdf[keys].assign(part=pdf["cell_id"].to_numpy()[top], plane=(pdf["system"] * 2**32 + pdf["layer"]).to_numpy())

    # a group is the occupied cells of one layer of one shower
    made = placed.groupBy("shower_id", "system", "layer").applyInPandas(run, ", ".join(f"{k} {t}" for k, t in [*((k, placed.schema[k].dataType.simpleString()) for k in keys), ("part", "bigint"), ("plane", "bigint")]))
    return made if several else made.drop("plane")


def merge_labelled(marked: DataFrame) -> DataFrame:
    """Points of (shower_id, label): double products, the earliest time, and the cell of the member nearest the barycentre.

    The barycentre is a window over the group that is aggregated, so that deposits are exchanged once.
    """
    each = Window.partitionBy("shower_id", "label")
    e = F.col("e").cast("double")
    marked = marked.withColumn("_e", F.sum(e).over(each))
    safe = F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.lit(1.0))
    marked = marked.withColumns({f"_{c}": F.sum(F.col(c).cast("double") * e).over(each) / safe for c in "xyz"})
    near = F.struct(sum((F.col(c).cast("double") - F.col(f"_{c}")) ** 2 for c in "xyz").alias("d2"), F.col("point_index").alias("i"))
    more = [F.min("t").alias("t")] if "t" in marked.columns else []
    more += [F.min_by("cell_id", near).alias("cell_id")] if "cell_id" in marked.columns else []
    return marked.groupBy("shower_id", "label").agg(*[F.max(f"_{c}").cast("float").alias(c) for c in "xyz"], F.max("_e").cast("float").alias("e"), F.count("*").alias("n_merged"), *more)


@dataclass
class HDBSCANClustering:
    """Density clusters inside detector scopes; labels are made per (shower, scope part), the rest is native.

    Partitions below max(min_samples, 2) keep every point; noise goes to the
    nearest clustered point's cluster or stays alone. The kernel needs memory
    for its points, not their pairs; its time grows with the pairs of a part, so
    a whole shower ('none') should be small.
    """

    min_cluster_size: int = 10
    min_samples: int = 8
    epsilon: float = 0.0
    xy_scale: float = 5.0
    t_scale: float = 1.0
    use_time: bool = False
    outliers: str = "nearest_cluster"
    scope: str = "system_layer"
    encoding: str | dict[int, str] | None = None

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}")
        if self.outliers not in ("nearest_cluster", "standalone"):
            raise ValueError("outliers must be 'nearest_cluster' or 'standalone'")
        if self.scope in ("layer", "system_layer", "cell_id_neighbour") and self.encoding is None:
            raise ValueError(f"scope {self.scope} needs an encoding")
        for text in self.encoding.values() if isinstance(self.encoding, dict) else [self.encoding] if self.encoding else []:
            if not {"layer", "system"} <= set(parse_encoding(text)):
                raise ValueError("the encoding needs the fields layer and system")

    def scoped(self, steps: DataFrame) -> tuple[DataFrame, list]:
        """Deposits with the columns k1, k2 of their scope part, and these in order."""
        if self.scope != "none":
            need(steps, "cell_id", "hdbscan")
        if isinstance(self.encoding, dict):
            need(steps, "subdetector", "hdbscan")
        zero = F.lit(0).cast("bigint")
        keys = {"none": (zero, zero), "cell_id": (F.col("cell_id") if "cell_id" in steps.columns else zero, zero)}
        if self.scope in ("layer", "system_layer"):
            keys |= {"layer": (cell_field(self.encoding, "layer"), zero), "system_layer": (cell_field(self.encoding, "system"), cell_field(self.encoding, "layer"))}
        if self.scope == "cell_id_neighbour":
            several = isinstance(self.encoding, dict)
            parts = neighbour_components(steps, self.encoding).withColumnRenamed("part", "k1")
            parts = parts.withColumnRenamed("plane", "k2") if several else parts.withColumn("k2", zero)
            return steps.join(parts, ["shower_id", *(["subdetector"] if several else []), "cell_id"]), [unsigned_order("k1"), "k2"]
        k1, k2 = keys[self.scope]
        return steps.withColumns({"k1": k1, "k2": k2}), [unsigned_order("k1"), "k2"]

    def features(self, pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[["x", "y", "z"]].to_numpy(np.float32) / np.float32(self.xy_scale)
        if self.use_time:
            t = pdf["t"].to_numpy(np.float32)
            x = np.column_stack([x, (t - np.median(t)) / np.float32(self.t_scale)])
        if self.epsilon > 0 and len(x):
            spread = np.ptp(x, axis=0)
            wide = spread > max(1e-6, 0.05 * spread.max())
            x = x[:, wide] if wide.any() else x[:, :1]
        return x

    def local_labels(self, pdf: pd.DataFrame) -> np.ndarray:
        n = len(pdf)
        if n < max(self.min_samples, 2):
            return np.arange(n)
        x = self.features(pdf)
        label = kernels.hdbscan(x, self.min_cluster_size, self.min_samples, self.epsilon)
        noise, good = np.flatnonzero(label < 0), np.flatnonzero(label >= 0)
        if not len(good):
            return np.zeros(n, int) if self.outliers == "nearest_cluster" else np.arange(n)
        if self.outliers == "nearest_cluster":
            for a in range(0, len(noise), 512):
                d = ((x[noise[a : a + 512], None, :] - x[None, good, :]) ** 2).sum(2)
                label[noise[a : a + 512]] = label[good[d.argmin(1)]]
        else:
            label[noise] = label.max() + 1 + np.arange(len(noise))
        return label

    def compress(self, steps: DataFrame) -> Result:
        if self.use_time:
            need(steps, "t", "hdbscan with time")
        placed, order = self.scoped(steps)
        own = self

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("point_index")
            if not np.isfinite(pdf[["x", "y", "z"] + (["t"] if own.use_time else [])].to_numpy(float)).all():
                raise ValueError("hdbscan needs finite coordinates")
            return pdf.assign(local=own.local_labels(pdf).astype(np.int64))

        # the map returns its deposits, so that nothing is joined back
        columns = [c for c in ("shower_id", "k1", "k2", "point_index", "x", "y", "z", "e", "t", "cell_id") if c in placed.columns]
        schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns) + ", local bigint"
        made = placed.select(*columns).groupBy("shower_id", "k1", "k2").applyInPandas(run, schema)
        rank = F.dense_rank().over(Window.partitionBy("shower_id").orderBy(*order, "local")) - 1
        marked = made.withColumn("label", rank.cast("bigint"))
        points = merge_labelled(marked).drop("n_merged").withColumnRenamed("label", "point_index")
        labels = marked.select("shower_id", "point_index", F.col("label").alias("cluster_label"))
        return Result(points, stats(steps, points), labels, "hdbscan", {k: v for k, v in vars(self).items() if k != "encoding"})
