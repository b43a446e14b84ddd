"""What a picture of a shower needs, as columns and tables: names of particles, the incoming line, sizes of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showerlake.functions import metrics
from showerlake.operators import select

#: Names of particles by PDG code, and masses in GeV by its absolute value.
NAMES = {11: "e-", -11: "e+", 13: "mu-", -13: "mu+", 22: r"$\gamma$", 111: "pi0", 211: "pi+", -211: "pi-", 321: "K+", -321: "K-", 2112: "n", 2212: "p"}
MASSES = {11: 0.00051099895, 13: 0.1056583755, 22: 0.0, 111: 0.1349768, 211: 0.13957039, 321: 0.493677, 2112: 0.93956542, 2212: 0.93827209}


def _looked_up(table: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key.cast("int")], other)


def particle_name(pdg: Column) -> Column:
    """A code without a name is written out."""
    return _looked_up(NAMES, pdg, F.concat(F.lit("PDG "), pdg.cast("string")))


def particle_mass(pdg: Column) -> Column:
    return F.coalesce(_looked_up(MASSES, F.abs(pdg), F.lit(0.0)), F.lit(0.0))


def particle_energy(pdg: Column, momentum: Column) -> Column:
    """From mass and momentum (an array of three); null where a component is missing or not finite."""
    parts = [F.get(momentum, F.lit(i)).cast("double") for i in range(3)]
    square = sum(p * p for p in parts) + particle_mass(pdg) ** 2
    return F.when((F.size(momentum) == 3) & (square < float("inf")), F.sqrt(square))


def incident_label(pdg: Column, momentum: Column) -> Column:
    """As `10 GeV e-`, halves rounded to the even number; without a momentum the name alone, without a code `incident particle`."""
    energy = F.coalesce(F.concat(F.bround(particle_energy(pdg, momentum)).cast("bigint").cast("string"), F.lit(" GeV")), F.lit(""))
    return F.trim(F.concat_ws(" ", energy, F.coalesce(particle_name(pdg), F.lit("incident particle"))))


def marker_size(df: DataFrame, most: float = 1.0, *, least: float = 0.0, together: bool = False) -> DataFrame:
    """Adds `size`, between least and most: by the root of the share of the largest energy, of the shower or of all that are shown `together`."""
    e = F.greatest(F.col("e").cast("double"), F.lit(0.0))
    if together:
        df = df.join(F.broadcast(df.agg(F.max(e).alias("_top"))))  # one row
    else:
        df = df.withColumn("_top", F.max(e).over(Window.partitionBy("shower_id")))
    return df.withColumn("size", least + (most - least) * F.sqrt(e / F.greatest(F.col("_top"), F.lit(1e-12)))).drop("_top")


def color_values(df: DataFrame, by: str = "energy") -> DataFrame:
    """Adds `color`, `color_lo` and `color_hi`.

    energy: the log energy, from its 1st to its 99th percentile; pdg, subdetector,
    cluster_label: the 0-based place of the value among those that occur.
    """
    if by == "energy":
        df = df.withColumn("color", metrics.log_energy(F.col("e")))
        ends = df.agg(F.percentile("color", F.lit(0.01)).alias("color_lo"), F.percentile("color", F.lit(0.99)).alias("color_hi"))
        return df.join(F.broadcast(ends))  # one row
    if by not in ("pdg", "subdetector", "cluster_label"):
        raise ValueError(f"unknown colour {by!r}")
    if by not in df.columns:
        raise ValueError(f"colour by {by} needs that column")
    found = df.select(by).distinct()
    places = found.select(F.col(by).alias("_kind"), (F.row_number().over(Window.orderBy(by)) - 1).cast("double").alias("color"))  # the values that occur: a few kinds, or a picture's clusters
    ends = found.agg(F.lit(-0.5).alias("color_lo"), (F.count("*") - 0.5).alias("color_hi"))
    return df.join(places, F.col(by).eqNullSafe(F.col("_kind")), "left").drop("_kind").join(F.broadcast(ends))


def display_points(inputs: dict[str, DataFrame], *, axes: DataFrame | None = None, percent: float | None = None, limits: dict[str, tuple[float, float]] | None = None, color: str = "energy", least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Points of one to three inputs, named by `series`, with sizes and colours that they share.

    percent: crops each shower to the radius around its axis (of `axes`) that holds
    so much of its energy; limits: of x, y and z.
    """
    if not 1 <= len(inputs) <= 3:
        raise ValueError("one to three inputs can be shown")
    out = None
    for name, steps in inputs.items():
        if percent is not None:
            if axes is None:
                raise ValueError("a crop needs axes")
            columns = steps.columns
            steps = select.energy_crop(metrics.in_frame(steps.join(axes, "shower_id")), percent).select(*columns)
        for axis, (lo, hi) in (limits or {}).items():
            steps = select.axis_crop(steps, axis, lo, hi)
        own = steps.withColumn("series", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return color_values(marker_size(out, most, least=least, together=True), color)


def overlay_colors(df: DataFrame) -> DataFrame:
    """Colours of deposits drawn over a detector: their cluster where they have one, else their energy."""
    return color_values(df, "cluster_label" if "cluster_label" in df.columns else "energy")


def display_axes(steps: DataFrame, primaries: DataFrame) -> DataFrame:
    """(shower_id, ax, ay, az, cx, cy, cz): the momentum's direction, else the main axis; the vertex, else the centroid."""
    main = metrics.pca_axes(steps, primaries)
    found = metrics.centroid(steps).drop("total_e").join(main, "shower_id", "left").join(primaries.select("shower_id", "momentum", "vertex"), "shower_id", "left")
    parts = [F.get("momentum", F.lit(i)).cast("double") for i in range(3)]
    length = F.sqrt(sum(p * p for p in parts))
    moves = (length > 0) & (length < float("inf"))
    at = [F.get("vertex", F.lit(i)).cast("double") for i in range(3)]
    whole = sum(F.abs(a) for a in at) < float("inf")
    return found.select(
        "shower_id", *[F.when(moves, p / length).otherwise(F.col(k)).alias(k) for k, p in zip(("ax", "ay", "az"), parts, strict=True)],
        *[F.when(whole, a).otherwise(F.col(k)).alias(k) for k, a in zip(("cx", "cy", "cz"), at, strict=True)],
    )


def incident_lines(steps: DataFrame, axes: DataFrame, *, length: float = 90.0, gap: float = 10.0, front: float = 0.01) -> DataFrame:
    """(shower_id, x0..z1): a line along the axis that ends `gap` before the place where `front` of the energy is reached."""
    placed = metrics.in_frame(steps.join(axes, "shower_id"))
    start = metrics.weighted_quantile(placed, "long", "e", front).withColumnRenamed("quantile", "at")
    ends = {"0": F.col("at") - gap - length, "1": F.col("at") - gap}
    return axes.join(start, "shower_id").select("shower_id", *[(F.col(f"c{c}") + d * F.col(f"a{c}")).alias(f"{c}{n}") for n, d in ends.items() for c in "xyz"])
