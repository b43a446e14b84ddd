"""Selections: world bounds, crops and pairing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WorldBounds:
    """Closed intervals; None is unbounded."""

    x: tuple[float, float] | None = None
    y: tuple[float, float] | None = None
    z: tuple[float, float] | None = None

    def mask(self) -> Column:
        out = F.lit(True)
        for axis, limits in (("x", self.x), ("y", self.y), ("z", self.z)):
            if limits is not None:
                out = out & F.col(axis).cast("double").between(*map(float, limits))
        return out

    def resolved(self, fallback: WorldBounds) -> WorldBounds:
        return WorldBounds(*[a if a is not None else b for a, b in ((self.x, fallback.x), (self.y, fallback.y), (self.z, fallback.z))])


def energy_crop(coords: DataFrame, percent: float, *, radial: str = "radial") -> DataFrame:
    """Deposits inside the radius that holds `percent` of a shower's energy; a crop to fewer than two, or one of a shower without energy, keeps all."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    each = Window.partitionBy("shower_id")
    e = F.col("e").cast("double")
    run = F.sum(e).over(each.orderBy(radial, "point_index").rowsBetween(Window.unboundedPreceding, 0))
    marked = coords.withColumns({"_run": run, "_all": F.sum(e).over(each)})
    marked = marked.withColumn("_cut", F.min(F.when(F.col("_run") >= F.col("_all") * (percent / 100), F.col(radial))).over(each))
    inside = F.col(radial) <= F.col("_cut")
    marked = marked.withColumns({"_in": inside, "_n": F.sum(F.when(inside, 1).otherwise(0)).over(each)})
    return marked.where(F.col("_in") | (F.col("_n") < 2) | ~(F.col("_all") > 0)).drop("_run", "_all", "_cut", "_in", "_n")


def axis_crop(df: DataFrame, axis: str, lo: float, hi: float) -> DataFrame:
    """Deposits with lo <= axis <= hi; skipped for showers in which fewer than two would stay."""
    if not lo < hi:
        raise ValueError("lo must be below hi")
    inside = F.col(axis).cast("double").between(float(lo), float(hi))
    marked = df.withColumn("_n", F.sum(F.when(inside, 1).otherwise(0)).over(Window.partitionBy("shower_id")))
    return marked.where(inside | (F.col("_n") < 2)).drop("_n")


def pair_showers(reference: DataFrame, compared: DataFrame) -> DataFrame:
    """Ids that both sides have; an id that only one side has fails the job."""
    a, b = reference.select("shower_id").distinct().withColumn("l", F.lit(1)), compared.select("shower_id").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "shower_id", "full_outer")
    wrong = F.raise_error(F.concat(F.lit("shower without a partner: "), F.col("shower_id").cast("string"))).cast("int")
    return both.select(F.when(F.col("l").isNull() | F.col("r").isNull(), wrong).otherwise(F.col("shower_id")).alias("shower_id"))
