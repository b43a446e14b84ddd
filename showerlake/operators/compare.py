"""Tables that compare showers before and after compression, also for several results at once.

Both sides are one DataFrame with a `side` ('before' or 'after'), so that every
table is one aggregate over one plan. Coordinates of both sides are taken along
the axis of the side before, from its centroid and its lowest projection, or
from a given origin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerlake.functions import metrics

#: Ranges and numbers of bins of profiles.
PROFILES = {"long": (-200.0, 200.0, 40), "radial": (0.0, 200.0, 40), "phi": (-math.pi, math.pi, 40)}
SIDES = ("before", "after")


class Comparison:
    """Compares deposits with the points made of them; `check` fails the job where ids differ."""

    def __init__(self, before: DataFrame, after: DataFrame, *, axis: tuple | None = None, origin: tuple | None = None):
        if origin is not None and len(origin) != 3:
            raise ValueError("an origin needs three components")
        self.before, self.axis, self.origin = before, axis, origin
        cells = "cell_id" in before.columns and "cell_id" in after.columns

        def one(df: DataFrame, side: str) -> DataFrame:
            numbers = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "e")]
            return df.select(F.lit(side).alias("side"), "shower_id", *numbers, (F.col("cell_id") if cells else F.lit(None)).cast("bigint").alias("cell_id"))

        self.sides = one(before, SIDES[0]).unionByName(one(after, SIDES[1]))

    def ratios(self) -> DataFrame:
        """(shower_id, energy_ratio, point_ratio, cell_ratio): after to before; NaN where there is nothing to divide by."""
        per = self.sides.groupBy("shower_id", "side").agg(F.sum("e").alias("e"), F.count("*").alias("n"), F.countDistinct("cell_id").alias("cells"))
        at = lambda column, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(column))), F.lit(0))
        both = per.groupBy("shower_id").agg(*[at(c, s).alias(f"{c}_{s}") for c in ("e", "n", "cells") for s in SIDES])
        ratio = lambda c: metrics.energy_ratio(F.col(f"{c}_before"), F.col(f"{c}_after"))
        return both.select("shower_id", ratio("e").alias("energy_ratio"), ratio("n").alias("point_ratio"), ratio("cells").alias("cell_ratio"))

    def frame(self) -> DataFrame:
        """(shower_id, cx, cy, cz, ax, ay, az, start): where each shower's coordinates begin and point to."""
        names = ("ax", "ay", "az")
        if self.origin is not None:
            made = self.before.select("shower_id").distinct().withColumns({k: F.lit(float(v)) for k, v in zip(("cx", "cy", "cz"), self.origin, strict=True)})
        else:
            made = metrics.centroid(self.before).drop("total_e")
        if self.axis is not None:
            made = made.withColumns({k: F.lit(v) for k, v in zip(names, metrics.normalized(self.axis), strict=True)})
        else:
            made = made.join(metrics.pca_axes(self.before), "shower_id")
        if self.origin is not None:
            return made.withColumn("start", F.lit(0.0))
        placed = metrics.in_frame(self.before.join(made, "shower_id"))
        return made.join(placed.groupBy("shower_id").agg(F.min("long").alias("start")), "shower_id")

    def coordinates(self) -> DataFrame:
        """Both sides with long, radial and phi."""
        placed = metrics.in_frame(self.sides.join(self.frame(), "shower_id"))
        return placed.withColumn("long", F.col("long") - F.col("start")).select("side", "shower_id", "e", "long", "radial", "phi")

    def moments(self) -> DataFrame:
        """(shower_id, side, long_m1, long_m2, radial_m1, radial_m2)."""
        made = [metrics.weighted_moment(F.col(v), F.col("e"), k).alias(f"{v}_m{k}") for v in ("long", "radial") for k in (1, 2)]
        return self.coordinates().groupBy("shower_id", "side").agg(*made)

    def profiles(self) -> DataFrame:
        """(shower_id, side, variable, bin, fraction) with all bins of PROFILES, in one pass over the coordinates."""
        values = [F.struct(F.lit(v).alias("variable"), metrics.histogram_bin(F.col(v), *PROFILES[v]).alias("bin")) for v in PROFILES]
        keys = ["shower_id", "side", "variable"]
        sums = self.coordinates().select("shower_id", "side", "e", F.explode(F.array(*values)).alias("v")).groupBy("shower_id", "side", "v.variable", "v.bin").agg(F.sum("e").alias("s"))
        total = sums.groupBy(*keys).agg(F.sum("s").alias("total"))  # at most a row for each bin from here on
        bins = F.create_map(*[x for v, (_, _, n) in PROFILES.items() for x in (F.lit(v), F.lit(n))])
        grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), bins[F.col("variable")] - 1)))
        share = F.when(F.col("total") > 0, F.coalesce("s", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
        return grid.join(sums.where("bin is not null"), [*keys, "bin"], "left").select(*keys, "bin", share.alias("fraction"))

    def mean_profiles(self) -> DataFrame:
        return self.profiles().groupBy("side", "variable", "bin").agg(F.avg("fraction").alias("fraction"))

    def spectra(self, bins: int = 40) -> DataFrame:
        """(kind, side, bin, lo, hi, n): spectra of the log energies of points and of cells, each over its side's range."""
        logged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "side", metrics.log_energy(F.col("e")).alias("v"))
        cells = self.sides.where("cell_id is not null").groupBy("side", "shower_id", "cell_id").agg(F.sum("e").alias("e"))
        return ranged_histogram(logged(self.sides, "point").unionByName(logged(cells, "cell")), ["kind", "side"], "v", bins)

    def tables(self) -> dict[str, DataFrame]:
        return {"ratios": self.ratios(), "moments": self.moments(), "profiles": self.profiles(), "mean_profiles": self.mean_profiles(), "spectra": self.spectra()}


def ranged_histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(*keys, bin, lo, hi, n) over each key's own range, all bins; a range of one value is widened by 0.5 on both sides.

    For a handful of keys: their ranges are broadcast, and counts are partial before the shuffle.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    more = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    ends = ends.select(*keys, (F.col("a") - more).alias("lo"), (F.col("b") + more).alias("hi"))
    marked = df.join(F.broadcast(ends), keys).withColumn("bin", metrics.histogram_bin(F.col(value), F.col("lo"), F.col("hi"), bins))
    counts = marked.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def checked(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after`, whose job fails where one side has a shower that the other lacks."""
    ids = lambda df, n: df.select("shower_id").distinct().withColumn(n, F.lit(1))
    both = ids(before, "_l").join(ids(after, "_r"), "shower_id", "full_outer")
    known = both.select("shower_id", F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("shower without a partner: "), F.col("shower_id").cast("string"))).cast("int")).alias("_ok"))
    return after.join(known, "shower_id", "right").where(F.col("_ok").isNull()).drop("_ok")


def series(comparisons: dict[str, Comparison], table: str) -> DataFrame:
    """One table of several comparisons, with their names as `series`."""
    if not comparisons:
        raise ValueError("there is nothing to compare")
    out = None
    for name, own in comparisons.items():
        one = own.tables()[table].withColumn("series", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def observables_bins(coords: DataFrame) -> DataFrame:
    """One row with limits over all showers: long_hi (15 bins from 0), radial_hi (50 from 0), log_lo and log_hi (50)."""
    e = metrics.log_energy(F.col("e"))
    rest = coords.agg(F.max("radial").alias("radial_hi"), F.min(e).alias("log_lo"), F.max(e).alias("log_hi"))
    return metrics.upper_limit(coords, "long").withColumnRenamed("limit", "long_hi").join(F.broadcast(rest))  # one row each


def observables_histogram(coords: DataFrame) -> DataFrame:
    """(shower_id, variable, bin, weight): energy by long, radial and phi and deposits by log energy, on bins shared by all showers."""
    limits = F.broadcast(observables_bins(coords))  # one row
    placed = coords.crossJoin(limits)
    e = F.col("e").cast("double")

    def entry(name: str, value: Column, lo: Column, hi: Column, bins: int, weight: Column) -> Column:
        return F.struct(F.lit(name).alias("variable"), metrics.histogram_bin(value, lo, hi, bins).alias("bin"), weight.alias("w"))

    zero, one = F.lit(0.0), F.lit(1.0)
    entries = F.array(
        entry("long", F.col("long"), zero, F.col("long_hi"), 15, e), entry("radial", F.col("radial"), zero, F.col("radial_hi"), 50, e),
        entry("phi", F.col("phi"), F.lit(-math.pi), F.lit(math.pi), 50, e), entry("log_energy", metrics.log_energy(F.col("e")), F.col("log_lo"), F.col("log_hi"), 50, one),
    )
    return placed.select("shower_id", F.explode(entries).alias("v")).where("v.bin is not null").groupBy("shower_id", "v.variable", "v.bin").agg(F.sum("v.w").alias("weight"))
