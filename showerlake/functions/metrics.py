"""Observables of showers as column expressions and aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def energy_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, after / before).otherwise(F.lit(NAN))


def log_energy(e: Column, floor: float = 1e-12) -> Column:
    return F.log10(F.greatest(e.cast("double"), F.lit(floor)))


def weighted_moment(value: Column, weight: Column, k: int) -> Column:
    """Aggregate: NaN without positive total weight."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.pow(value, F.lit(k)) * weight) / total).otherwise(F.lit(NAN))


def centroid(steps: DataFrame) -> DataFrame:
    """Energy-weighted centre of each shower; null without energy."""
    e = F.col("e").cast("double")
    return steps.groupBy("shower_id").agg(F.sum(e).alias("total_e"), *[F.try_divide(F.sum(F.col(c).cast("double") * e), F.sum(e)).alias(f"c{c}") for c in "xyz"])


def normalized(axis) -> tuple[float, float, float]:
    v = [float(a) for a in axis]
    n = math.sqrt(sum(a * a for a in v)) if len(v) == 3 else NAN
    if len(v) != 3 or not math.isfinite(n) or n == 0:
        raise ValueError("an axis needs three finite components that are not all zero")
    return tuple(a / n for a in v)


def transverse_basis(ax, ay, az):
    """(e1, e2) across the axis, as columns: e1 from the x direction, or y's where the axis is near x."""
    near = F.abs(ax) > 0.9
    r = [F.when(near, F.lit(0.0)).otherwise(F.lit(1.0)), F.when(near, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(0.0)]
    dot = r[0] * ax + r[1] * ay
    raw = [r[0] - dot * ax, r[1] - dot * ay, r[2] - dot * az]
    n = F.sqrt(raw[0] ** 2 + raw[1] ** 2 + raw[2] ** 2)
    e1 = [c / n for c in raw]
    e2 = [ay * e1[2] - az * e1[1], az * e1[0] - ax * e1[2], ax * e1[1] - ay * e1[0]]
    return e1, e2


def in_frame(placed: DataFrame) -> DataFrame:
    """Adds long, radial and phi to deposits that carry a centre (cx, cy, cz) and an axis (ax, ay, az)."""
    a = [F.col(k) for k in ("ax", "ay", "az")]
    rel = [F.col(c).cast("double") - F.col(f"c{c}") for c in "xyz"]
    along = sum(r * k for r, k in zip(rel, a, strict=True))
    placed = placed.withColumn("long", along)
    across = [r - F.col("long") * k for r, k in zip(rel, a, strict=True)]
    e1, e2 = transverse_basis(*a)
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
    placed = placed.withColumns({"radial": F.sqrt(dot(across, across)), "phi": F.atan2(dot(across, e2), dot(across, e1))})
    return placed


def shower_coordinates(steps: DataFrame, axes: DataFrame | tuple, *, origin: str = "centroid", shift_to_min: bool = False) -> DataFrame:
    """Adds long, radial and phi to deposits.

    axes: one axis, or (shower_id, ax, ay, az). Origin of the axis coordinate:
    'centroid', 'first_deposit' (by point_index) or 'min_projection'.
    """
    if origin not in ("centroid", "first_deposit", "min_projection"):
        raise ValueError(f"unknown origin {origin!r}")
    placed = steps.join(centroid(steps).drop("total_e"), "shower_id")
    if isinstance(axes, DataFrame):
        placed = placed.join(axes.select("shower_id", "ax", "ay", "az"), "shower_id")
    else:
        placed = placed.withColumns({k: F.lit(v) for k, v in zip(("ax", "ay", "az"), normalized(axes), strict=True)})
    placed = in_frame(placed)
    each = Window.partitionBy("shower_id")
    if origin == "first_deposit":
        placed = placed.withColumn("long", F.col("long") - F.min_by("long", "point_index").over(each))
    if origin == "min_projection" or shift_to_min:
        placed = placed.withColumn("long", F.col("long") - F.min("long").over(each))
    return placed.drop("cx", "cy", "cz", "ax", "ay", "az")


def _moments(rows: DataFrame, shift: dict[str, Column] | None = None) -> DataFrame:
    """(shower_id, n, total, m*, c**): energy-weighted mean of x - shift and covariances, in one partial aggregate."""
    e = F.col("e").cast("double")
    d = {c: F.col(c).cast("double") - (shift[c] if shift else F.lit(0.0)) for c in "xyz"}
    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = rows.groupBy("shower_id").agg(F.count("*").alias("n"), F.sum(e).alias("total"), *[F.sum(d[c] * e).alias(f"_{c}") for c in "xyz"], *[F.sum(d[p[0]] * d[p[1]] * e).alias(f"_{p}") for p in pairs])
    means = {c: F.try_divide(F.col(f"_{c}"), F.col("total")) for c in "xyz"}
    return sums.select("shower_id", "n", "total", *[means[c].alias(f"m{c}") for c in "xyz"], *[(F.try_divide(F.col(f"_{p}"), F.col("total")) - means[p[0]] * means[p[1]]).alias(f"c{p}") for p in pairs])


def _dominant(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Eigenvectors of the largest eigenvalues of 3 x 3 covariances, a batch at once; NaN without spread."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).astype(float).reshape(-1, 3, 3)
    ok = np.isfinite(m).all((1, 2)) & (np.trace(m, axis1=1, axis2=2) > 0)
    out = np.full((len(m), 3), np.nan)
    if ok.any():
        out[ok] = np.linalg.eigh(m[ok])[1][:, :, 2]
    return pd.DataFrame(out, columns=["ax", "ay", "az"])


def _axes_of(moments: DataFrame, prefix: str = "a") -> DataFrame:
    found = moments.withColumn("v", F.pandas_udf(_dominant, "ax double, ay double, az double")(*[f"c{a + b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]))
    return found.withColumns({f"{prefix}{c}": F.when(F.isnan(f"v.a{c}"), None).otherwise(F.col(f"v.a{c}")) for c in "xyz"}).drop("v")


def pca_axes(steps: DataFrame, primaries: DataFrame | None = None, *, refine: bool = True, trim: tuple[float, float] = (10, 99)) -> DataFrame:
    """(shower_id, ax, ay, az): dominant direction of the energy-weighted spread.

    One aggregate gives centre and spread; the 3 x 3 eigenvectors of a batch of
    showers are taken at once. Refined once more, where three are left, on the
    deposits between two percentiles of the projection, whose spread is summed up
    around the first centre. Turned, before the percentiles are taken, towards the
    primary's momentum, or (1, 1, 1); of several primaries of a shower one counts (see sources.steps.last_primary for
    the last). Showers without energy or spread have null axes; two deposits give
    the line through them.
    """
    toward = [F.lit(1.0)] * 3
    first = _axes_of(_moments(steps))
    if primaries is not None:
        first = first.join(primaries.groupBy("shower_id").agg(F.max("momentum").alias("toward")), "shower_id", "left")
        toward = [F.coalesce(F.get("toward", F.lit(i)).cast("double"), F.lit(1.0)) for i in range(3)]
    else:
        first = first.withColumn("toward", F.lit(None).cast("array<float>"))

    def turned(prefix: str) -> dict[str, Column]:
        flip = F.when(sum(F.col(f"{prefix}{c}") * t for c, t in zip("xyz", toward, strict=True)) < 0, -1.0).otherwise(1.0)
        return {f"{prefix}{c}": F.col(f"{prefix}{c}") * flip for c in "xyz"}

    first = first.withColumns(turned("a")).select("shower_id", "mx", "my", "mz", "ax", "ay", "az", "toward")
    if not refine:
        return first.select("shower_id", "ax", "ay", "az")
    placed = steps.join(first.drop("toward"), "shower_id")
    placed = placed.withColumn("long", sum((F.col(c).cast("double") - F.col(f"m{c}")) * F.col(f"a{c}") for c in "xyz"))
    cut = placed.groupBy("shower_id").agg(F.percentile("long", F.array(F.lit(trim[0] / 100), F.lit(trim[1] / 100))).alias("q"))
    kept = placed.join(cut, "shower_id").where(F.col("long").between(F.col("q")[0], F.col("q")[1]))
    again = _axes_of(_moments(kept, {c: F.col(f"m{c}") for c in "xyz"}), "r").where("n >= 3").select("shower_id", "rx", "ry", "rz")
    both = first.join(again, "shower_id", "left").withColumns(turned("r"))
    return both.select("shower_id", *[F.coalesce(f"r{c}", f"a{c}").alias(f"a{c}") for c in "xyz"])


# --- histograms and quantiles ---


def histogram_bin(value: Column, lo, hi, bins: int) -> Column:
    """Bin of a value, the last one closed on the right; null outside."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    raw = F.floor((value - lo) / ((hi - lo) / bins)).cast("int")
    return F.when((value >= lo) & (value <= hi), F.least(raw, F.lit(bins - 1)))


def profile(coords: DataFrame, value: str, lo: float, hi: float, bins: int, *, weight: str = "e") -> DataFrame:
    """(shower_id, bin, fraction) with all bins; weight outside the range counts in the total."""
    w = F.col(weight).cast("double")
    marked = coords.withColumn("bin", histogram_bin(F.col(value), lo, hi, bins))
    sums = marked.groupBy("shower_id", "bin").agg(F.sum(w).alias("s"))
    # rows are at most bins + 1 for each shower from here on
    total = sums.groupBy("shower_id").agg(F.sum("s").alias("total"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = grid.join(sums.where("bin is not null"), ["shower_id", "bin"], "left")
    share = F.when(F.col("total") > 0, F.coalesce("s", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
    return joined.select("shower_id", "bin", share.alias("fraction"))


def mean_profile(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("bin").agg(F.avg("fraction").alias("fraction"))


def auto_histogram(df: DataFrame, value: str, bins: int, *, weight: str | None = None) -> DataFrame:
    """(shower_id, bin, lo, hi, n) over each shower's own range; a range of one value is widened by 0.5."""
    ends = df.groupBy("shower_id").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    same = F.col("a") == F.col("b")
    ends = ends.select("shower_id", F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    marked = df.join(ends, "shower_id").withColumn("bin", histogram_bin(F.col(value), F.col("lo"), F.col("hi"), bins))
    sums = marked.groupBy("shower_id", "bin").agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("double").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(sums, ["shower_id", "bin"], "left").fillna(0.0, ["n"])


def upper_limit(df: DataFrame, value: str) -> DataFrame:
    """One row `limit`: max(99th percentile * 1.05, 1), 1 without rows."""
    return bracketed_percentiles(df, value, (0.99,)).select(F.coalesce(F.greatest(F.col("q0") * 1.05, F.lit(1.0)), F.lit(1.0)).alias("limit"))


def auto_limits(df: DataFrame, value: str) -> DataFrame:
    """One row (lo, hi): 1st and 99th percentile, widened by a tenth of their distance (of 1 at least)."""
    p = bracketed_percentiles(df, value, (0.01, 0.99)).toDF("a", "b")
    pad = 0.1 * F.greatest(F.col("b") - F.col("a"), F.lit(1.0))
    return p.select((F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """(shower_id, quantile): the first value at which the cumulative weight reaches q; plain quantile without weight."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    each = Window.partitionBy("shower_id")
    run = each.orderBy(value, "point_index").rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumns({"_run": F.sum(w).over(run), "_all": F.sum(w).over(each)})
    hit = F.min(F.when(F.col("_run") >= q * F.col("_all"), F.col(value)))
    out = marked.groupBy("shower_id").agg(hit.alias("a"), F.max("_all").alias("total"), F.percentile(value, F.lit(q)).alias("plain"))
    return out.select("shower_id", F.when(F.col("total") > 0, F.col("a")).otherwise(F.col("plain")).cast("double").alias("quantile"))


def profile_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shower_id, l1): summed bin differences over the larger of a's sum and 1."""
    both = a.join(b.withColumnRenamed("fraction", "other"), ["shower_id", "bin"], "full_outer").fillna(0.0)
    return both.groupBy("shower_id").agg((F.sum(F.abs(F.col("fraction") - F.col("other"))) / F.greatest(F.sum(F.abs("fraction")), F.lit(1.0))).alias("l1"))


def observables(steps: DataFrame, axes: DataFrame | tuple) -> DataFrame:
    """Number of steps, energy, mean and variance of the axis and radial coordinates, axis and centroid, per shower."""
    c = shower_coordinates(steps, axes, origin="first_deposit")
    e = F.col("e").cast("double")
    m = c.groupBy("shower_id").agg(F.count("*").alias("num_steps"), F.sum(e).alias("total_energy"), *[weighted_moment(F.col(v), e, k).alias(f"{v}{k}") for v in ("long", "radial") for k in (1, 2)])
    out = m.select("shower_id", "num_steps", "total_energy", F.col("long1").alias("mean_long"), (F.col("long2") - F.col("long1") ** 2).alias("var_long"), F.col("radial1").alias("mean_radial"), (F.col("radial2") - F.col("radial1") ** 2).alias("var_radial"))
    out = out.join(centroid(steps).drop("total_e"), "shower_id")
    if isinstance(axes, DataFrame):
        return out.join(axes.select("shower_id", "ax", "ay", "az"), "shower_id")
    return out.withColumns({k: F.lit(v) for k, v in zip(("ax", "ay", "az"), normalized(axes), strict=True)})


#: Numbers of bins of a shower's own histograms.
OWN_BINS = {"long": 30, "radial": 50, "phi": 50, "log_energy": 50}


def own_histograms(steps: DataFrame, axes: DataFrame | tuple) -> DataFrame:
    """(shower_id, variable, bin, lo, hi, weight): each shower's histograms of OWN_BINS, all bins.

    long, radial and log_energy over the shower's own range (one value is widened
    by 0.5), phi over the circle; energies are weights, of log_energy counts.
    """
    c = shower_coordinates(steps, axes, origin="first_deposit").withColumn("log_energy", log_energy(F.col("e")))
    entry = lambda v: F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"), (F.lit(1.0) if v == "log_energy" else F.col("e").cast("double")).alias("w"))
    rows = c.select("shower_id", F.explode(F.array(*[entry(v) for v in OWN_BINS])).alias("v")).select("shower_id", "v.*")
    ends = rows.groupBy("shower_id", "variable").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    more, phi = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0), F.col("variable") == "phi"
    bins = F.create_map(*[F.lit(x) for pair in OWN_BINS.items() for x in pair])[F.col("variable")]
    ends = ends.select("shower_id", "variable", F.when(phi, -math.pi).otherwise(F.col("a") - more).alias("lo"), F.when(phi, math.pi).otherwise(F.col("b") + more).alias("hi"), bins.alias("bins"))
    raw = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))).cast("int")
    marked = rows.join(ends, ["shower_id", "variable"]).withColumn("bin", F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.least(raw, F.col("bins") - 1)))
    sums = marked.groupBy("shower_id", "variable", "bin").agg(F.sum("w").alias("weight"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).drop("bins")
    return grid.join(sums, ["shower_id", "variable", "bin"], "left").fillna(0.0, ["weight"])


def bracketed_percentiles(df: DataFrame, value: str, shares: tuple[float, ...], *, accuracy: int = 100_000) -> DataFrame:
    """One row of exact percentiles q0, q1, ... of a whole table, without its values in one task.

    Approximate percentiles bracket each exact one; counts below the bracket give
    its place among the values inside, at most a few in `accuracy`, which alone are sorted.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null")
    wide = 2.0 / accuracy
    asked = [min(1.0, max(0.0, q + s)) for q in shares for s in (-wide, wide)]
    about = rows.agg(F.count("*").alias("n"), F.percentile_approx("v", asked, accuracy).alias("p")).first()
    if not about.n:
        return df.sparkSession.createDataFrame([(None,) * len(shares)], ", ".join(f"q{i} double" for i in range(len(shares))))
    columns = []
    for i, q in enumerate(shares):
        lo, hi = about.p[2 * i], about.p[2 * i + 1]
        lo, hi = (None if asked[2 * i] == 0 else lo), (None if asked[2 * i + 1] == 1 else hi)
        below = F.lit(False) if lo is None else F.col("v") < lo
        inside = F.lit(True) & (F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") <= hi)
        columns += [F.count(F.when(below, 1)).alias(f"n{i}"), F.sort_array(F.collect_list(F.when(inside, F.col("v")))).alias(f"v{i}")]
    found = rows.agg(*columns)
    out = []
    for i, q in enumerate(shares):
        at = (about.n - 1) * q
        place = F.lit(math.floor(at)) - F.col(f"n{i}")
        a, b = F.get(f"v{i}", place.cast("int")), F.get(f"v{i}", (place + 1).cast("int"))
        out.append((a + F.coalesce((b - a) * (at - math.floor(at)), F.lit(0.0))).alias(f"q{i}"))
    return found.select(*out)
