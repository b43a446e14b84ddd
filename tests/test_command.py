import pytest

from showerlake.__main__ import main
from showerlake.sources.steps import read_meta, write_steps
from tests.test_geometry import compact  # noqa: F401


@pytest.fixture
def source(spark, tmp_path):
    rows = [(s, i, float(i % 3), 1245.0, float(i % 5), 1.0 + i, float(i), 1 | 1 << 4 | (i % 2) << 8) for s in (3, 8) for i in range(12)]
    steps = spark.createDataFrame(rows, "shower_id int, point_index bigint, x float, y float, z float, e float, t float, cell_id bigint")
    return write_steps(steps, str(tmp_path / "in"), algorithm="none", source_input="test") + "/steps.parquet"


def test_merge_command(spark, source, tmp_path):
    out = str(tmp_path / "out")
    text = main(["--input", source, "--output", out, "--algorithm", "merge_within_cell", "--debug-events", "1"], spark)
    assert "points_before=24\n" in text and "points_after=4\n" in text
    assert spark.read.text(f"{out}/summary.txt").count() == len(text.splitlines())
    assert read_meta(spark, f"{out}/compressed")["algorithm"] == "merge_within_cell"
    debug = spark.read.parquet(f"{out}/debug_merge_within_cell/steps.parquet").collect()
    assert {r.shower_id for r in debug} == {8} and {r.cluster_label for r in debug} == {0, 1}
    assert spark.read.parquet(f"{out}/validation.parquet").count() > 0


def test_other_commands(spark, source, tmp_path, compact):  # noqa: F811
    common = ["--input", source, "--output", str(tmp_path / "out")]
    hdbscan = ["--algorithm", "hdbscan", "--hdbscan-cell-id-encoding", "system:4,layer:4,x:16,y:8"]
    assert "points_before=12\n" in main([*common, *hdbscan, "--shower-limit", "1"], spark)
    assert "points_before=24\n" in main([*common, "--algorithm", "cluster_within_cell_agglomerative"], spark)
    with pytest.raises(ValueError):
        main([*common, "--algorithm", "merge_within_regular_subcell"], spark)


def test_compare_command(spark, source, tmp_path):
    out = str(tmp_path / "tables")
    frame = ["--axis", "1", "0", "0", "--origin", "0", "1245", "0"]
    text = main(["compare", "--input", source, "--algorithm", "merge_within_cell", "--output", out, *frame], spark)
    assert len(text.splitlines()) == 5
    rows = {r.shower_id: r for r in spark.read.parquet(f"{out}/ratios.parquet").collect()}
    assert rows[3].series == "merge_within_cell" and rows[3].point_ratio == pytest.approx(2 / 12) and rows[8].energy_ratio == pytest.approx(1)
    for r in spark.read.parquet(f"{out}/profiles.parquet").groupBy("shower_id", "side", "variable").agg({"fraction": "sum", "*": "count"}).collect():
        assert r["sum(fraction)"] == pytest.approx(1) and r["count(1)"] == 40
    main(["compare", "--input", source, source, source, "--label", "a", "b", "c", "--output", out, *frame], spark)
    moments = spark.read.parquet(f"{out}/moments.parquet").collect()
    assert {r.series for r in moments} == {"b", "c"} and len({r.long_m1 for r in moments if r.shower_id == 3}) == 1
    for wrong in (["--input", source, source, source], ["--input", source, source, "--label", "a", "a"]):
        with pytest.raises(ValueError):
            main(["compare", *wrong, "--output", out], spark)


def test_comparison_needs_partners(spark, source):
    from showerlake.operators.compare import Comparison, checked

    steps = spark.read.parquet(source)
    with pytest.raises(Exception, match="without a partner"):
        checked(steps, steps.where("shower_id = 3")).collect()
    own = Comparison(steps, steps).moments().collect()
    assert len(own) == 4 and len({round(r.radial_m2, 9) for r in own if r.shower_id == 8}) == 1
    assert Comparison(steps.where("false"), steps.where("false"), axis=(1, 0, 0)).profiles().count() == 0
    with pytest.raises(ValueError):
        Comparison(steps, steps, origin=(1.0, 2.0))


def test_display(spark):
    from pyspark.sql import functions as F

    from showerlake.operators.display import display_axes, incident_label, incident_lines

    kinds = spark.createDataFrame([(11, [3.0, 4.0, 0.0]), (99, None), (None, None), (22, [1.0])], "pdg int, momentum array<float>")
    assert [r[0] for r in kinds.select(incident_label(F.col("pdg"), F.col("momentum"))).collect()] == ["5 GeV e-", "PDG 99", "incident particle", r"$\gamma$"]
    steps = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0) for i in range(5)], "shower_id int, point_index long, x float, y float, z float, e float")
    primary = spark.createDataFrame([(1, [2.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "shower_id int, momentum array<float>, vertex array<float>")
    axes = display_axes(steps, primary)
    assert (axes.first().ax, axes.first().cx) == (1.0, 1.0)
    line = incident_lines(steps, axes).first()
    assert (line.x0, line.x1, line.y0) == (-100.0, -10.0, 0.0)


def test_inspect_cells_and_display_commands(spark, source, tmp_path, compact):  # noqa: F811
    out = str(tmp_path / "tables")
    text = main(["inspect", "--input", source, "--output", out, "--shower-index", "1", "--axis", "1", "0", "0"], spark)
    assert text.startswith("shower_id=8 first_long_centroid=") and len(text.splitlines()) == 5
    assert spark.read.parquet(f"{out}/observables.parquet").count() == 2 and spark.read.parquet(f"{out}/shower.parquet").count() == 12
    assert {r.n for r in spark.read.parquet(f"{out}/histograms.parquet").groupBy("shower_id").count().toDF("s", "n").collect()} == {180}
    assert "layers=3" in main(["cells", "--compact-xml", str(compact), "--collection", "Hits", "--output", out], spark)
    assert spark.read.parquet(f"{out}/outlines.parquet").count() == 8 * 12
    main(["cells", "--compact-xml", str(compact), "--collection", "Hits", "--output", out, "--show", "cells", "--module", "2", "--layer", "1", "--overlay-input", source, "--overlay-shower-index", "1", "--xlim", "-9999", "9999"], spark)
    assert spark.read.parquet(f"{out}/cells_xy.parquet").select("module", "layer").distinct().collect() == [(2, 1)]
    assert spark.read.parquet(f"{out}/overlay.parquet").count() == 12
    main(["display", "--input", source, source, "--label", "a", "b", "--output", out, "--percent", "90", "--sizes", "1", "4"], spark)
    points = spark.read.parquet(f"{out}/points.parquet").collect()
    assert {p.series for p in points} == {"a", "b"} and max(p["size"] for p in points) == 4.0
    for wrong in (["--show", "cells"], ["--module", "99"], ["--show", "modules", "--layer", "1"]):
        with pytest.raises(ValueError):
            main(["cells", "--compact-xml", str(compact), "--collection", "Hits", "--output", out, *wrong], spark)
