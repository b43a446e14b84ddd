"""Validators: what compression kept, one row for each shower."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.functions import metrics


class Validator(Protocol):
    name: str

    def run(self, before: DataFrame, after: DataFrame) -> DataFrame: ...


class EnergyConservation:
    name = "energy_conservation"

    def __init__(self, tolerance: float = 1e-9):
        self.tolerance = tolerance

    def run(self, before: DataFrame, after: DataFrame) -> DataFrame:
        total = lambda df, n: df.groupBy("shower_id").agg(F.sum(F.col("e").cast("double")).alias(n))
        both = total(before, "energy_before").join(total(after, "energy_after"), "shower_id")
        ratio = metrics.energy_ratio(F.col("energy_before"), F.col("energy_after"))
        return both.withColumn("energy_ratio", ratio).withColumn("passed", F.coalesce(F.abs(F.col("energy_ratio") - 1) < self.tolerance, F.lit(False)) & ~F.isnan("energy_ratio"))


class CellCountRatio:
    name = "cell_count_ratio"

    def run(self, before: DataFrame, after: DataFrame) -> DataFrame:
        if "cell_id" not in before.columns or "cell_id" not in after.columns:
            ids = before.select("shower_id").distinct()
            return ids.withColumn("cell_ratio", F.lit(metrics.NAN))
        count = lambda df, n: df.groupBy("shower_id").agg(F.countDistinct("cell_id").alias(n))
        both = count(before, "cells_before").join(count(after, "cells_after"), "shower_id")
        return both.withColumn("cell_ratio", F.when(F.col("cells_before") > 0, F.col("cells_after") / F.col("cells_before")).otherwise(F.lit(metrics.NAN)))


class ShowerMoments:
    """Differences after - before; each side on its own axis unless one is given."""

    name = "shower_moments"

    def __init__(self, axis: tuple | None = None):
        self.axis = axis

    def moments(self, df: DataFrame) -> DataFrame:
        coords = metrics.shower_coordinates(df, self.axis if self.axis else metrics.pca_axes(df))
        e = F.col("e").cast("double")
        return coords.groupBy("shower_id").agg(*[metrics.weighted_moment(F.col(v), e, k).alias(f"{v}_m{k}") for v in ("long", "radial") for k in (1, 2)])

    def run(self, before: DataFrame, after: DataFrame) -> DataFrame:
        names = [f"{v}_m{k}" for v in ("long", "radial") for k in (1, 2)]
        a, b = self.moments(before).alias("a"), self.moments(after).alias("b")
        return a.join(b, "shower_id").select("shower_id", *[(F.col(f"b.{n}") - F.col(f"a.{n}")).alias(f"d_{n}") for n in names])


class Sanity:
    """Finite numbers, no negative energy, at least one point, cells given where the input has them."""

    name = "sanity"

    def run(self, before: DataFrame, after: DataFrame) -> DataFrame:
        finite = F.lit(True)
        for c in ("x", "y", "z", "e"):
            v = F.col(c)
            finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        cells = F.bool_and(F.col("cell_id").isNotNull()) if "cell_id" in after.columns else F.lit(True)
        checked = after.groupBy("shower_id").agg(F.bool_and(finite).alias("finite"), F.bool_and(F.col("e") >= 0).alias("non_negative"), cells.alias("has_cells"), F.count("*").alias("n"))
        joined = before.select("shower_id").distinct().join(checked, "shower_id", "left")
        out = joined.select("shower_id", *[F.coalesce(c, F.lit(True)).alias(c) for c in ("finite", "non_negative", "has_cells")], (F.coalesce("n", F.lit(0)) > 0).alias("has_points"))
        return out.withColumn("passed", F.col("finite") & F.col("non_negative") & F.col("has_cells") & F.col("has_points"))


def long_form(results: dict[str, DataFrame]) -> DataFrame:
    """(validator, shower_id, metric, value) of several validators."""
    out = None
    for name, df in results.items():
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "shower_id"]
        one = df.select(F.lit(name).alias("validator"), "shower_id", F.explode(F.array(*pairs)).alias("m")).select("validator", "shower_id", "m.metric", "m.value")
        out = one if out is None else out.unionByName(one)
    return out
