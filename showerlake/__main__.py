"""Command line: `python -m showerlake` reads showers, compresses, validates and writes them.

`python -m showerlake compare` writes the tables that compare written showers
with one another or, where there is one input alone, with its compressed form;
`inspect` those that describe one input, `cells` a detector's outlines and cells,
with deposits over them, and `display` the points of up to three inputs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerlake.functions import metrics
from showerlake.operators.cluster import SCOPES, ClusterWithinCell, HDBSCANClustering, ward_clusterer
from showerlake.operators import layout
from showerlake.operators.compare import Comparison, checked, observables_histogram, series
from showerlake.operators.display import color_values, display_points, overlay_colors
from showerlake.operators.merge import Identity, MergeWithinCell, MergeWithinRegularSubcell, Result, stats, summary, summary_text
from showerlake.operators.select import WorldBounds
from showerlake.operators.validate import CellCountRatio, EnergyConservation, ShowerMoments, long_form
from showerlake.sources.compact import Compact, read_barrel
from showerlake.sources.steps import pick_showers, read_steps, write_debug_steps, write_steps

#: Names of algorithms, options and their defaults.
ALGORITHMS = ("identity", "merge_within_cell", "merge_within_regular_subcell", "hdbscan", "cluster_within_cell_agglomerative")


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="showerlake", description=__doc__)
    p.add_argument("--input", required=True, help="file or folder; its suffix names the format")
    return common(p).parse_args(argv)


def compare_options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="showerlake compare", description=__doc__)
    p.add_argument("--input", required=True, nargs="+", help="the reference, then what is compared with it")
    p.add_argument("--label", nargs="+", help="names of the inputs, required for three and more")
    p.add_argument("--axis", nargs=3, type=float, help="axis of all showers instead of each one's own")
    p.add_argument("--origin", nargs=3, type=float)
    return common(p).parse_args(argv)


def common(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    p.add_argument("--output", required=True, help="folder that the results are written to")
    p.add_argument("--algorithm", choices=ALGORITHMS, default="identity")
    p.add_argument("--shower-limit", type=int)
    p.add_argument("--collections", nargs="+", help="collections that are read of ROOT event files")
    p.add_argument("--compact-xml", help="detector description that geometry and encodings are read from")
    p.add_argument("--collection-name", nargs="+", help="readouts in it, in the order of subdetector indexes")
    p.add_argument("--grid-x", type=int, default=2)
    p.add_argument("--grid-y", type=int, default=2)
    p.add_argument("--position-mode", choices=("weighted", "center"), default="weighted")
    p.add_argument("--distance-threshold", type=float, default=1.0)
    p.add_argument("--min-cluster-size", type=int, default=5)
    p.add_argument("--min-samples", type=int, default=3)
    p.add_argument("--epsilon", type=float, default=0.0)
    p.add_argument("--use-time", action="store_true")
    p.add_argument("--outlier-policy", choices=("nearest_cluster", "standalone"), default="nearest_cluster")
    p.add_argument("--merge-scope", choices=SCOPES, default="system_layer")
    p.add_argument("--hdbscan-cell-id-encoding")
    p.add_argument("--debug-events", nargs="+", type=int, help="0-based showers whose labelled deposits are written too")
    p.add_argument("--debug-output")
    return p


def algorithm(spark: SparkSession, o: argparse.Namespace):
    """The algorithm that the options name; options it lacks raise ValueError."""
    if o.algorithm == "identity":
        return Identity()
    if o.algorithm == "merge_within_cell":
        return MergeWithinCell()
    if o.algorithm == "cluster_within_cell_agglomerative":
        return ClusterWithinCell(ward_clusterer(o.distance_threshold))
    if o.algorithm == "merge_within_regular_subcell":
        if not o.compact_xml or len(o.collection_name or ()) != 1:
            raise ValueError("merge_within_regular_subcell needs --compact-xml and one --collection-name")
        barrel = read_barrel(o.compact_xml, o.collection_name[0])
        return MergeWithinRegularSubcell(geometry=barrel.planes(spark), encoding=barrel.encoding, x_bins=o.grid_x, y_bins=o.grid_y, position=o.position_mode)
    encoding = o.hdbscan_cell_id_encoding
    if encoding is None and o.compact_xml and o.collection_name:
        files = Compact(o.compact_xml)
        found = {k: files.encoding(name) for k, name in enumerate(o.collection_name)}
        encoding = found if len(found) > 1 else found[0]
    return HDBSCANClustering(
        min_cluster_size=o.min_cluster_size, min_samples=o.min_samples, epsilon=o.epsilon, use_time=o.use_time,
        outliers=o.outlier_policy, scope=o.merge_scope, encoding=encoding,
    )


def written(steps: DataFrame, result: Result, o: argparse.Namespace) -> DataFrame:
    """Writes the points and reads them again, so that what follows doesn't cluster anew."""
    path = write_steps(result.points, f"{o.output}/compressed", algorithm=result.algorithm, source_input=o.input)
    return steps.sparkSession.read.parquet(f"{path}/steps.parquet")


def compare(argv: list[str], spark: SparkSession | None = None) -> str:
    """Writes the tables of Comparison, with a column `series` that names what is compared."""
    o = compare_options(argv)
    labels = o.label or (["reference", "compared"][: len(o.input)] if len(o.input) < 3 else [])
    if len(labels) != len(o.input) or len(set(labels)) < len(labels):
        raise ValueError("each input needs a --label of its own")
    spark = spark or SparkSession.builder.appName("showerlake").getOrCreate()
    inputs = [read_steps(spark, path, shower_limit=o.shower_limit, collections=o.collections) for path in o.input]
    if len(inputs) == 1:
        inputs, labels = [inputs[0], algorithm(spark, o).compress(inputs[0]).points], [*labels, o.algorithm]
    frame = {"axis": tuple(o.axis) if o.axis else None, "origin": tuple(o.origin) if o.origin else None}
    made = {name: Comparison(inputs[0], checked(inputs[0], own), **frame) for name, own in zip(labels[1:], inputs[1:], strict=True)}
    names = list(next(iter(made.values())).tables())
    for name in names:
        series(made, name).write.mode("overwrite").parquet(f"{o.output}/{name}.parquet")
    return "".join(f"{o.output}/{name}.parquet\n" for name in names)


def _written(tables: dict[str, DataFrame], output: str) -> str:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{output}/{name}.parquet")
    return "".join(f"{output}/{name}.parquet\n" for name in tables)


def inspect(argv: list[str], spark: SparkSession) -> str:
    """Tables of one input: observables, histograms on shared bins and on each shower's own, and one shower's coordinates."""
    p = argparse.ArgumentParser(prog="showerlake inspect", description=inspect.__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--collections", nargs="+")
    p.add_argument("--shower-index", type=int, help="0-based shower whose deposits are written with their coordinates")
    p.add_argument("--axis", nargs=3, type=float, help="axis of all showers instead of each one's own")
    o = p.parse_args(argv)
    steps = read_steps(spark, o.input, collections=o.collections)
    axes = tuple(o.axis) if o.axis else metrics.pca_axes(steps)
    tables = {
        "observables": metrics.observables(steps, axes), "histograms": metrics.own_histograms(steps, axes),
        "matrix": observables_histogram(metrics.shower_coordinates(steps, axes, origin="first_deposit")),
    }
    text = ""
    if o.shower_index is not None:
        one = pick_showers(steps, [o.shower_index])
        placed = metrics.shower_coordinates(one, axes).withColumnRenamed("long", "long_centroid").select("shower_id", "point_index", "x", "y", "z", "e", "long_centroid", "radial", "phi")
        first = metrics.shower_coordinates(one, axes, origin="first_deposit").select("shower_id", "point_index", F.col("long").alias("long_first"))
        tables["shower"] = color_values(placed.join(first, ["shower_id", "point_index"]))
        r = tables["shower"].orderBy("point_index").first()
        text = f"shower_id={r.shower_id} first_long_centroid={r.long_centroid:.3f} first_long={r.long_first:.3f} first_xyz=({r.x:.3f}, {r.y:.3f}, {r.z:.3f})\n"
    return text + _written(tables, o.output)


def _limits(p: argparse.ArgumentParser) -> None:
    for axis in "xyz":
        p.add_argument(f"--{axis}lim", nargs=2, type=float)


def cells(argv: list[str], spark: SparkSession) -> str:
    """Tables of a detector's modules, layers or cells, and of deposits drawn over them."""
    p = argparse.ArgumentParser(prog="showerlake cells", description=cells.__doc__)
    p.add_argument("--compact-xml", required=True)
    p.add_argument("--collection", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--show", choices=("modules", "layers", "cells"), default="modules")
    p.add_argument("--module", type=int, help="1-based; needed for cells")
    p.add_argument("--layer", type=int, help="1-based")
    p.add_argument("--overlay-input")
    p.add_argument("--overlay-shower-index", type=int, default=0)
    p.add_argument("--overlay-collections", nargs="+")
    _limits(p)
    o = p.parse_args(argv)
    barrel = read_barrel(o.compact_xml, o.collection)
    if o.module is not None and not 1 <= o.module <= barrel.sides:
        raise ValueError(f"--module must lie in 1 to {barrel.sides}")
    if o.show == "modules" and (o.module is not None or o.layer is not None):
        raise ValueError("modules are shown whole: no --module or --layer")
    if o.show == "cells" and o.module is None:
        raise ValueError("cells need --module")

    def chosen(df: DataFrame) -> DataFrame:
        for name in ("module", "layer"):
            if getattr(o, name) is not None:
                df = df.where(F.col(name) == getattr(o, name))
        return df

    window = {a: tuple(getattr(o, f"{a}lim") or (None, None)) for a in "xyz"}
    boxes = barrel.envelopes(spark) if o.show == "modules" else chosen(barrel.boxes(spark))
    edges = layout.crossing(layout.outlines(boxes), window)
    tables = {"outlines": edges, "bounds": layout.bounds(edges)}
    if o.show == "cells":
        planes = chosen(barrel.planes(spark))
        for view in layout.VIEWS:
            tables[f"cells_{view}"] = layout.overlapping(layout.cell_polygons(planes, view), window[view[0]], window[view[1]])
    if o.overlay_input:
        steps = pick_showers(read_steps(spark, o.overlay_input, collections=o.overlay_collections), [o.overlay_shower_index])
        bounds = WorldBounds(*[w if None not in w else None for w in window.values()])
        tables["overlay"] = overlay_colors(steps.where(bounds.mask()))
    return barrel.report() + "\n" + _written(tables, o.output)


def display(argv: list[str], spark: SparkSession) -> str:
    """The table of points, sizes and colours of one to three inputs."""
    p = argparse.ArgumentParser(prog="showerlake display", description=display.__doc__)
    p.add_argument("--input", required=True, nargs="+")
    p.add_argument("--label", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--collections", nargs="+")
    p.add_argument("--shower-index", type=int, default=0)
    p.add_argument("--color", choices=("energy", "pdg", "subdetector", "cluster_label"), default="energy")
    p.add_argument("--percent", type=float, help="share of the energy that is shown, by radius")
    p.add_argument("--sizes", nargs=2, type=float, default=(0.0, 1.0))
    _limits(p)
    o = p.parse_args(argv)
    labels = o.label or [str(i) for i in range(len(o.input))]
    if len(set(labels)) != len(o.input):
        raise ValueError("each input needs a --label of its own")
    inputs = {name: pick_showers(read_steps(spark, path, collections=o.collections), [o.shower_index]) for name, path in zip(labels, o.input, strict=True)}
    first = next(iter(inputs.values()))
    axes = metrics.centroid(first).drop("total_e").join(metrics.pca_axes(first), "shower_id")
    limits = {a: tuple(getattr(o, f"{a}lim")) for a in "xyz" if getattr(o, f"{a}lim")}
    return _written({"points": display_points(inputs, axes=axes, percent=o.percent, limits=limits, color=o.color, least=o.sizes[0], most=o.sizes[1])}, o.output)


COMMANDS = {"inspect": inspect, "cells": cells, "display": display}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs the command and returns what it prints: the summary, or the tables written."""
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["compare"]:
        return compare(argv[1:], spark)
    if argv[:1] and argv[0] in COMMANDS:
        return COMMANDS[argv[0]](argv[1:], spark or SparkSession.builder.appName("showerlake").getOrCreate())
    o = options(argv)
    spark = spark or SparkSession.builder.appName("showerlake").getOrCreate()
    steps = read_steps(spark, o.input, shower_limit=o.shower_limit, collections=o.collections)
    result = algorithm(spark, o).compress(steps)
    points = written(steps, result, o)
    checks = [EnergyConservation(), ShowerMoments()] + ([CellCountRatio()] if "cell_id" in steps.columns else [])
    long_form({v.name: v.run(steps, points) for v in checks}).write.mode("overwrite").parquet(f"{o.output}/validation.parquet")
    if o.debug_events:
        write_debug_steps(steps, result.labels, o.debug_output or f"{o.output}/debug_{o.algorithm}", algorithm=o.algorithm, source_input=o.input, ordinals=o.debug_events)
    text = f"algorithm={result.algorithm}\ninput={o.input}\n" + summary_text(summary(stats(steps, points)).first())
    spark.createDataFrame([(text.rstrip(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.output}/summary.txt")
    return text


if __name__ == "__main__":
    print(main(), end="")
