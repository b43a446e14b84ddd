"""Compression as grouping: attach key columns, then one weighted-merge aggregate.

Energies add up; positions and times are energy-weighted means, a group without
energy lands at the origin. All sums are partial aggregates below the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerlake.functions.cellid import unsigned_order


@dataclass
class Result:
    """points: the compressed showers; stats: a row for each shower; labels: the group of each deposit."""

    points: DataFrame
    stats: DataFrame
    labels: DataFrame
    algorithm: str
    parameters: dict


def need(df: DataFrame, column: str, who: str) -> None:
    if column not in df.columns:
        raise ValueError(f"{who} needs the column {column}")


def weighted_merge(df: DataFrame, keys: list[str], *, product: str = "float", time: str = "weighted", extra: dict | None = None, final: str = "float") -> DataFrame:
    """One row for each shower and key: e, x, y, z, (t) and `extra` aggregates.

    product: the type in which coordinate and energy are multiplied before they
    are summed in DOUBLE; time: 'weighted' or 'min'.
    """
    coordinates = ["x", "y", "z"] + (["t"] if "t" in df.columns and time == "weighted" else [])
    sums = [F.sum(F.col(c).cast(product) * F.col("e").cast(product)).alias(f"_{c}") for c in coordinates]
    more = [F.min("t").alias("t")] if "t" in df.columns and time == "min" else []
    grouped = df.groupBy("shower_id", *keys).agg(F.sum("e").alias("_e"), F.count("*").alias("n_merged"), *sums, *more, *[v.alias(k) for k, v in (extra or {}).items()])
    safe = F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.lit(1.0))
    means = [(F.col(f"_{c}") / safe).cast(final).alias(c) for c in coordinates]
    return grouped.select("shower_id", *keys, *means, F.col("_e").cast(final).alias("e"), "n_merged", *(["t"] if more else []), *(extra or {}))


def numbered(points: DataFrame, order: list) -> DataFrame:
    """Adds point_index, the 0-based place in the shower under an order."""
    return points.withColumn("point_index", (F.row_number().over(Window.partitionBy("shower_id").orderBy(*order)) - 1).cast("bigint"))


def group_labels(df: DataFrame, order: list) -> DataFrame:
    """(shower_id, point_index, cluster_label): dense 0-based numbers of groups in key order."""
    rank = F.dense_rank().over(Window.partitionBy("shower_id").orderBy(*order)) - 1
    return df.select("shower_id", "point_index", rank.cast("bigint").alias("cluster_label"))


def stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Points and energies before and after, for every shower of either."""
    count = lambda df, tag: df.groupBy("shower_id").agg(F.count("*").alias(f"n_points_{tag}"), F.sum(F.col("e").cast("double")).alias(f"energy_{tag}"))
    both = count(before, "before").join(count(after, "after"), "shower_id", "full_outer").fillna(0)
    return both.withColumn("compression_ratio", F.col("n_points_after") / F.greatest(F.col("n_points_before"), F.lit(1)))


def merge_stats(merged: DataFrame) -> DataFrame:
    """As `stats`, from a merge in double precision with n_merged: deposits aren't read or counted again."""
    out = merged.groupBy("shower_id").agg(F.sum("n_merged").alias("n_points_before"), F.sum("e").alias("energy_before"), F.count("*").alias("n_points_after"), F.sum(F.col("e").cast("float").cast("double")).alias("energy_after"))
    return out.withColumn("compression_ratio", F.col("n_points_after") / F.greatest(F.col("n_points_before"), F.lit(1)))


def as_floats(merged: DataFrame) -> DataFrame:
    return merged.withColumns({c: F.col(c).cast("float") for c in ("x", "y", "z", "e", "t") if c in merged.columns})


def summary(stats_df: DataFrame) -> DataFrame:
    """One row: means of points, the mean of ratios and the ratio of totals; zeros without showers."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return stats_df.agg(
        F.count("*").alias("showers"), F.coalesce(F.sum("n_points_before"), F.lit(0)).alias("points_before"), F.coalesce(F.sum("n_points_after"), F.lit(0)).alias("points_after"),
        zero(F.avg("n_points_before")).alias("mean_points_before"), zero(F.avg("n_points_after")).alias("mean_points_after"),
        zero(F.avg("compression_ratio")).alias("mean_ratio"), zero(F.try_divide(F.sum("n_points_after"), F.sum("n_points_before"))).alias("total_ratio"),
    )


def summary_text(row) -> str:
    """The summary as key=value lines."""
    return "".join(f"{k}={row[k]:.6f}\n" if isinstance(row[k], float) else f"{k}={row[k]}\n" for k in row.asDict())


class Identity:
    """Keeps every deposit."""

    def compress(self, steps: DataFrame) -> Result:
        labels = steps.select("shower_id", "point_index", F.col("point_index").alias("cluster_label"))
        return Result(steps, stats(steps, steps), labels, "identity", {})


@dataclass
class MergeWithinCell:
    """A point for each shower and cell, in unsigned cell order; product='double' multiplies in double precision."""

    product: str = "float"

    def compress(self, steps: DataFrame) -> Result:
        need(steps, "cell_id", "merge_within_cell")
        order = [unsigned_order("cell_id")]
        merged = weighted_merge(steps, ["cell_id"], product=self.product, final="double")
        points = numbered(as_floats(merged).drop("n_merged"), order)
        return Result(points, merge_stats(merged), group_labels(steps, order), "merge_within_cell", {"product": self.product})


def subcell_index(offset, pitch, bins: int):
    """Bin of an offset from a cell's centre, clipped to the cell."""
    raw = F.floor((offset + pitch / 2) / (pitch / bins))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))


def subcell_center(parent, sub, pitch, bins: int):
    return parent * pitch - pitch / 2 + (sub + 0.5) * pitch / bins


@dataclass
class MergeWithinRegularSubcell:
    """Cells cut into x_bins by y_bins, in the local frame of their module and layer.

    geometry: (module, layer, center_x, center_y, tan_x, tan_y, pitch_t,
    pitch_z), one row for each sensitive plane. Module or layer 0 stands for the
    last one; a deposit without geometry fails the job, it is never dropped.
    """

    geometry: DataFrame
    encoding: str
    x_bins: int = 2
    y_bins: int = 2
    position: str = "weighted"

    def __post_init__(self):
        if self.x_bins <= 0 or self.y_bins <= 0:
            raise ValueError("x_bins and y_bins must be positive")
        if self.position not in ("weighted", "center"):
            raise ValueError("position must be 'weighted' or 'center'")

    def keyed(self, steps: DataFrame) -> DataFrame:
        from showerlake.functions.cellid import field

        dim = self.geometry
        last = dim.agg(F.max("module").alias("last_module"), F.max("layer").alias("last_layer")).first()
        module, layer = field("cell_id", self.encoding, "module"), field("cell_id", self.encoding, "layer")
        placed = steps.withColumns({"module": F.when(module == 0, last[0]).otherwise(module), "layer": F.when(layer == 0, last[1]).otherwise(layer), "cell_x": field("cell_id", self.encoding, "x"), "cell_y": field("cell_id", self.encoding, "y")})
        # a row for each sensitive plane of the detector: Spark broadcasts it while it is below its threshold
        joined = placed.join(dim.withColumn("known", F.lit(True)), ["module", "layer"], "left")
        unknown = F.raise_error(F.concat(F.lit("no geometry for cell "), F.col("cell_id").cast("string"))).cast("double")
        along = F.when(F.col("known").isNull(), unknown).otherwise((F.col("x") - F.col("center_x")) * F.col("tan_x") + (F.col("y") - F.col("center_y")) * F.col("tan_y"))
        sub_x = subcell_index(along - F.col("cell_x") * F.col("pitch_t"), F.col("pitch_t"), self.x_bins)
        sub_y = subcell_index(F.col("z").cast("double") - F.col("cell_y") * F.col("pitch_z"), F.col("pitch_z"), self.y_bins)
        return joined.withColumns({"sub_x": sub_x, "sub_y": sub_y})

    def compress(self, steps: DataFrame) -> Result:
        need(steps, "cell_id", "merge_within_regular_subcell")
        placed = self.keyed(steps)
        order = [unsigned_order("cell_id"), "sub_x", "sub_y"]
        extra = {}
        if self.position == "center":  # functions of the key, so any member's value is the group's
            t = subcell_center(F.col("cell_x"), F.col("sub_x"), F.col("pitch_t"), self.x_bins)
            extra = {"c_x": F.min(F.col("center_x") + t * F.col("tan_x")), "c_y": F.min(F.col("center_y") + t * F.col("tan_y")), "c_z": F.min(subcell_center(F.col("cell_y"), F.col("sub_y"), F.col("pitch_z"), self.y_bins))}
        merged = weighted_merge(placed, ["cell_id", "sub_x", "sub_y"], extra=extra, final="double")
        points = as_floats(merged)
        if extra:
            points = points.withColumns({c: F.col(f"c_{c}").cast("float") for c in "xyz"}).drop(*extra)
        points = numbered(points, order).drop("sub_x", "sub_y", "n_merged")
        return Result(points, merge_stats(merged), group_labels(placed, order), "merge_within_regular_subcell", {"x_bins": self.x_bins, "y_bins": self.y_bins, "position": self.position})


def cell_energy(steps: DataFrame) -> DataFrame:
    need(steps, "cell_id", "cell_energy")
    return steps.groupBy("shower_id", "cell_id").agg(F.sum("e").alias("energy"))
