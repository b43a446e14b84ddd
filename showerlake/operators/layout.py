"""Tables of detector cells and outlines, made from planes (see sources.compact.PLANES)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_center(cell_x: Column, cell_y: Column) -> list[Column]:
    """x, y and z of a cell's centre, in terms of its plane's columns."""
    along = cell_x * F.col("pitch_t")
    return [(F.col("center_x") + along * F.col("tan_x")).alias("x"), (F.col("center_y") + along * F.col("tan_y")).alias("y"), (cell_y * F.col("pitch_z")).alias("z")]


def strips(planes: DataFrame, axis: str) -> DataFrame:
    """The cells along `t` or `z` of each plane, clipped to it: columns cell_<axis>, <axis>0 and <axis>1."""
    half, pitch = F.col(f"half_{axis}"), F.col(f"pitch_{axis}")
    most = F.ceil(half / pitch - 0.5).cast("int")
    cells = planes.withColumn("cell", F.explode(F.sequence(-most, most)))
    low, high = F.greatest((F.col("cell") - 0.5) * pitch, -half), F.least((F.col("cell") + 0.5) * pitch, half)
    return cells.withColumn(f"{axis}0", low).withColumn(f"{axis}1", high).where(F.col(f"{axis}1") > F.col(f"{axis}0")).withColumnRenamed("cell", f"cell_{axis}")


def cells(planes: DataFrame) -> DataFrame:
    """Every cell of every plane with its borders; one row makes the next, nothing is joined."""
    return strips(strips(planes, "t"), "z")


def outlines(planes: DataFrame) -> DataFrame:
    """The twelve edges of each box: (module, layer, x0, y0, z0, x1, y1, z1).

    Of planes, Barrel.boxes (whole layers) or Barrel.envelopes (whole modules,
    whose outer face has its own half width, half_t_outer).
    """
    wide = F.col("half_t_outer" if "half_t_outer" in planes.columns else "half_t")
    corners = [(t, r, z) for t in (-1, 1) for r in (-1, 1) for z in (-1, 1)]
    edges = [(a, b) for a in corners for b in corners if a < b and sum(p != q for p, q in zip(a, b, strict=True)) == 1]

    def point(corner: tuple[int, int, int], n: int) -> list[Column]:
        t, r, z = corner
        along, out = t * (wide if r > 0 else F.col("half_t")), r * F.col("half_thickness")
        # the radial direction is the tangent turned back by a quarter
        return [
            (F.col("center_x") + along * F.col("tan_x") + out * F.col("tan_y")).alias(f"x{n}"),
            (F.col("center_y") + along * F.col("tan_y") - out * F.col("tan_x")).alias(f"y{n}"),
            (z * F.col("half_z")).alias(f"z{n}"),
        ]

    made = F.explode(F.array(*[F.struct(*point(a, 0), *point(b, 1)) for a, b in edges]))
    return planes.select("module", "layer", made.alias("edge")).select("module", "layer", "edge.*")


def bounds(edges: DataFrame, pad: float = 0.05, least: float = 2.0) -> DataFrame:
    """One row with the padded limits of all edges on each axis: the larger of a share and `least` mm."""
    limits = edges.agg(*[f(g(f"{a}0", f"{a}1")).alias(f"{a}_{n}") for a in "xyz" for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))])
    out = []
    for a in "xyz":
        more = F.greatest(pad * (F.col(f"{a}_high") - F.col(f"{a}_low")), F.lit(least))
        out += [(F.col(f"{a}_low") - more).alias(f"{a}_low"), (F.col(f"{a}_high") + more).alias(f"{a}_high")]
    return limits.select(*out)


def crossing(edges: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Edges whose box overlaps the limits of x, y and z; touching isn't overlapping, None is no limit.

    An edge that doesn't extend along an axis counts where it lies strictly inside.
    """
    for axis, (low, high) in limits.items():
        if low is not None:
            edges = edges.where(F.greatest(f"{axis}0", f"{axis}1") > low)
        if high is not None:
            edges = edges.where(F.least(f"{axis}0", f"{axis}1") < high)
    return edges


# --- projections: corners and ends as (u, v) pairs of a view ---

VIEWS = ("xy", "zy", "xz")


def _at(t, r) -> dict[str, Column]:
    """x and y of a place on a plane: t along its tangent and r out from its centre."""
    return {"x": F.col("center_x") + t * F.col("tan_x") + r * F.col("tan_y"), "y": F.col("center_y") + t * F.col("tan_y") - r * F.col("tan_x")}


def _pair(u: Column, v: Column) -> Column:
    return F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))


def cell_polygons(planes: DataFrame, view: str) -> DataFrame:
    """The cells as seen in a view: (module, layer, cell_t and/or cell_z, corners array<struct<u, v>>).

    In xy a strip of cells along z is one polygon, in zy one along the tangent;
    in zy its height is that of the whole tilted box.
    """
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    thick, half = F.col("half_thickness"), F.col("half_t")
    t0, t1, z0, z1 = (F.col(c) for c in ("t0", "t1", "z0", "z1"))
    if view == "zy":
        ys = [_at(t, r)["y"] for t in (-half, half) for r in (-thick, thick)]
        low, high = F.least(*ys), F.greatest(*ys)
        made = strips(planes, "z")
        return made.select("module", "layer", "cell_z", F.array(_pair(z0, low), _pair(z1, low), _pair(z1, high), _pair(z0, high)).alias("corners"))
    ring = [_at(t0, -thick), _at(t1, -thick), _at(t1, thick), _at(t0, thick)]
    if view == "xy":
        return strips(planes, "t").select("module", "layer", "cell_t", F.array(*[_pair(p["x"], p["y"]) for p in ring]).alias("corners"))
    corners = F.array(*[_pair(p["x"], z) for p, z in zip(ring, (z0, z0, z1, z1), strict=True)])
    return cells(planes).select("module", "layer", "cell_t", "cell_z", corners.alias("corners"))


def grid_lines(planes: DataFrame, view: str) -> DataFrame:
    """Lines a pitch apart from the lower border on, as (module, layer, line, corners) of two ends; views xy and zy."""
    if view not in ("xy", "zy"):
        raise ValueError(f"no grid lines in the view {view!r}")
    axis = "t" if view == "xy" else "z"
    half, pitch = F.col(f"half_{axis}"), F.col(f"pitch_{axis}")
    # the last line is less than half a pitch beyond the upper border
    last = F.ceil((2 * half + 0.5 * pitch) / pitch).cast("int") - 1
    lined = planes.withColumn("line", F.explode(F.sequence(F.lit(0), last)))
    place = F.col("line") * pitch - half
    if view == "xy":
        ends = [_at(place, r * F.col("half_thickness")) for r in (-1, 1)]
        pairs = [_pair(p["x"], p["y"]) for p in ends]
    else:
        pairs = [_pair(place, _at(t * F.col("half_t"), F.lit(0.0))["y"]) for t in (-1, 1)]
    return lined.select("module", "layer", "line", F.array(*pairs).alias("corners"))


def overlapping(shapes: DataFrame, u: tuple[float | None, float | None] = (None, None), v: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Polygons or lines whose box overlaps the limits; touching isn't overlapping, None is no limit."""
    for axis, (low, high) in (("u", u), ("v", v)):
        places = F.col("corners")[axis]
        if low is not None:
            shapes = shapes.where(F.array_max(places) > low)
        if high is not None:
            shapes = shapes.where(F.array_min(places) < high)
    return shapes


def layers_in_view(shapes: DataFrame, u=(None, None), v=(None, None)) -> DataFrame:
    """(module, layer) of those that have a shape within the limits."""
    return overlapping(shapes, u, v).select("module", "layer").distinct()
