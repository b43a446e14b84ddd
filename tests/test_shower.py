import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.functions import kernels, metrics
from showerlake.functions.cellid import decode, field, parse_encoding
from showerlake.operators.cluster import ClusterWithinCell, HDBSCANClustering, neighbour_components, ward_clusterer
from showerlake.operators.merge import Identity, MergeWithinCell, MergeWithinRegularSubcell, summary
from showerlake.operators.select import WorldBounds, pair_showers
from showerlake.operators.validate import EnergyConservation, Sanity
from showerlake.plans.pipeline import Pipeline
from showerlake.sources.steps import read_meta, read_steps, write_steps

SCHEMA = "shower_id int, point_index bigint, x float, y float, z float, e float, t float, cell_id bigint"


def steps(spark, rows):
    return spark.createDataFrame([(s, i, float(x), float(y), float(z), float(e), 0.0, c) for s, i, x, y, z, e, c in rows], SCHEMA)


def test_merge_within_cell(spark):
    df = steps(spark, [(42, 0, 0, 0, 0, 1, 7), (42, 1, 2, 0, 0, 3, 7), (42, 2, 10, 0, 5, 2, 9)])
    made = MergeWithinCell().compress(df)
    rows = made.points.orderBy("point_index").collect()
    assert [(r.cell_id, r.x, r.e) for r in rows] == [(7, 1.5, 4.0), (9, 10.0, 2.0)]
    assert [r.cluster_label for r in made.labels.orderBy("point_index").collect()] == [0, 0, 1]
    assert summary(made.stats).first().total_ratio == pytest.approx(2 / 3)
    assert EnergyConservation().run(df, made.points).first().passed
    assert Sanity().run(df, made.points).first().passed


def test_zero_energy_goes_to_the_origin_and_unsigned_order(spark):
    df = steps(spark, [(1, 0, 5, 5, 5, 0, -1), (1, 1, 1, 1, 1, 2, 3)])
    rows = MergeWithinCell().compress(df).points.orderBy("point_index").collect()
    assert [(r.cell_id, r.x) for r in rows] == [(3, 1.0), (-1, 0.0)]


def test_empty_and_missing_columns(spark):
    empty = steps(spark, [])
    made = MergeWithinCell().compress(empty)
    assert made.points.count() == 0 and summary(made.stats).first().mean_ratio == 0.0
    assert Identity().compress(empty).points.count() == 0
    with pytest.raises(ValueError, match="cell_id"):
        MergeWithinCell().compress(empty.drop("cell_id"))


def test_subcells(spark):
    plane = spark.createDataFrame([(1, 1, 0.0, 10.0, 1.0, 0.0, 2.0, 2.0)], "module bigint, layer bigint, center_x double, center_y double, tan_x double, tan_y double, pitch_t double, pitch_z double")
    cell = 1 | 1 << 4
    df = steps(spark, [(1, i, x, 10, z, i + 1, cell) for i, (x, z) in enumerate([(-0.9, -0.9), (-0.9, 0.9), (0.9, -0.9), (0.9, 0.9)])])
    for position in ("weighted", "center"):
        points = MergeWithinRegularSubcell(plane, "module:4,layer:4,x:16:-8,y:-8", 2, 2, position).compress(df).points.collect()
        assert len(points) == 4 and sum(p.e for p in points) == 10
        if position == "center":
            assert {(p.x, p.z) for p in points} == {(a, b) for a in (-0.5, 0.5) for b in (-0.5, 0.5)}


def test_cell_fields(spark):
    text = "system:8,barrel:3,module:4,layer:6,slice:5,x:32:-16,y:-16"
    f = parse_encoding(text)
    assert (f["x"].offset, f["y"].offset, f["y"].width, f["y"].signed) == (32, 48, 16, True)
    value = 10 | 1 << 8 | 9 << 11 | 12 << 15 | 3 << 21 | 5 << 32 | (-7 & 0xFFFF) << 48
    df = spark.createDataFrame([(value - (1 << 64),)], "cell_id bigint")
    got = df.select(decode("cell_id", text).alias("d"), field("cell_id", text, "y", signed=False).alias("u")).first()
    assert got.d.asDict() == {"system": 10, "barrel": 1, "module": 9, "layer": 12, "slice": 3, "x": 5, "y": -7} and got.u == 65529
    with pytest.raises(ValueError):
        field("cell_id", text, "nothing")


def test_axis_and_coordinates(spark):
    df = steps(spark, [(1, i, 10 + i, 0, 0, 1, 1) for i in range(3)])
    long = lambda **k: [r.long for r in metrics.shower_coordinates(df, k.pop("axis", (1, 0, 0)), **k).orderBy("point_index").collect()]
    assert long(origin="first_deposit") == [0, 1, 2] and long() == [-1, 0, 1]
    assert long(axis=(-1, 0, 0), origin="min_projection") == [2, 1, 0]
    assert metrics.pca_axes(df).first().ax == pytest.approx(1.0)
    with pytest.raises(ValueError):
        metrics.normalized((0, 0, 0))


def test_clustering(spark):
    rng = np.random.default_rng(42)
    blobs = np.vstack([rng.normal(c, 1.0, (30, 2)) for c in (100, 200)])
    df = steps(spark, [(1, i, x, y, 0, 1, 1 << 8 | i << 14) for i, (x, y) in enumerate(blobs)])
    made = HDBSCANClustering(5, 3, scope="layer", encoding="system:8,layer:6,hit:50").compress(df)
    points = made.points.collect()
    assert 2 <= len(points) < 60 and sum(p.e for p in points) == pytest.approx(60)
    noise = HDBSCANClustering(100, 3, scope="layer", encoding="system:8,layer:6,hit:50").compress(df).points.collect()
    assert len(noise) == 1 and noise[0].e == pytest.approx(60)
    cells = steps(spark, [(1, i, i % 2 * 10 + 0.01 * i, 0, 0, 1, 100) for i in range(10)])
    assert ClusterWithinCell(ward_clusterer(1e6)).compress(cells).points.count() == 1
    assert ClusterWithinCell(ward_clusterer(1.0)).compress(cells).points.count() == 2
    with pytest.raises(ValueError):
        HDBSCANClustering(scope="layer")


def test_neighbours(spark):
    at = lambda x, y: x << 14 | y << 22
    df = steps(spark, [(1, i, 0, 0, 0, 1, c) for i, c in enumerate([at(0, 0), at(1, 0), at(5, 5)])])
    parts = {r.cell_id: r.part for r in neighbour_components(df, "system:8,layer:6,x:8,y:8").collect()}
    assert parts == {at(0, 0): at(0, 0), at(1, 0): at(0, 0), at(5, 5): at(5, 5)}


def test_ward_against_plain_merging():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 1:
        cost = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if h >= 2.0:
            break
        groups[i] += groups.pop(j)
    label = kernels.ward(x, 2.0)
    assert sorted(map(sorted, groups)) == sorted(np.flatnonzero(label == k).tolist() for k in np.unique(label))


def test_bounds_pairing_pipeline_and_files(spark, tmp_path):
    df = steps(spark, [(1, 0, 0, 10, -1, 1, 1), (1, 1, 2, 20, 0, 1, 1), (1, 2, 4, 30, 1, 1, 2)])
    assert [r.point_index for r in df.where(WorldBounds((1, 4), (15, 25), (-0.5, 0.5)).mask()).collect()] == [1]
    assert pair_showers(df, df).count() == 1
    with pytest.raises(Exception, match="partner"):
        pair_showers(df, df.where("false")).collect()
    report = Pipeline(MergeWithinCell(), (EnergyConservation(),)).run(df)
    assert report.summary.first().points_after == 2 and report.validation.count() == 4
    write_steps(df, f"{tmp_path}/out", algorithm="identity", source_input="test")
    assert read_steps(spark, f"{tmp_path}/out/steps.parquet").count() == 3
    assert read_meta(spark, f"{tmp_path}/out")["algorithm"] == "identity"
    with pytest.raises(ValueError):
        read_steps(spark, "x.unknown")
    with pytest.raises(ImportError):
        read_steps(spark, "x.root")


def test_weighted_quantile(spark):
    df = steps(spark, [(1, i, i, 0, 0, 1, 1) for i in range(4)]).withColumn("w", F.lit(1.0))
    assert metrics.weighted_quantile(df, "x", "w", 0.5).first()["quantile"] == 1.0


def test_neighbours_with_an_encoding_for_each_subdetector(spark):
    texts = {0: "system:8,layer:6,x:8,y:8", 1: "system:8,layer:6,y:8,x:8"}
    at = lambda u, v: 1 | 1 << 8 | u << 14 | v << 22
    rows = [(1, i, 0.0, 0.0, 0.0, 1.0, 0.0, c, k) for i, (c, k) in enumerate([(at(0, 0), 0), (at(1, 0), 0), (at(4, 0), 0), (at(0, 3), 1), (at(0, 2), 1)])]
    df = spark.createDataFrame(rows, SCHEMA + ", subdetector smallint")
    # both subdetectors have the system and layer of the field values, so their cells are neighbours of one another: x 0, 1 and 4, then 3 and 2
    parts = {(r.subdetector, r.cell_id): r.part for r in neighbour_components(df, texts).collect()}
    assert len(set(parts.values())) == 1
    alone = {(r.subdetector, r.cell_id): r.part for r in neighbour_components(df.where("subdetector = 0"), texts).collect()}
    assert len(set(alone.values())) == 2
    # decoded by the first encoding, cells of the second are three steps apart along y
    far = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, at(0, 0), 1), (1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, at(3, 0), 1)], SCHEMA + ", subdetector smallint")
    assert len({r.part for r in neighbour_components(far, texts).collect()}) == 2
    made = HDBSCANClustering(5, 3, scope="cell_id_neighbour", encoding=texts).compress(df)
    assert sum(p.e for p in made.points.collect()) == 5 and made.labels.count() == 5
    with pytest.raises(Exception, match="no encoding for subdetector"):
        neighbour_components(df.withColumn("subdetector", F.lit(9).cast("smallint")), texts).collect()


def test_axes_of_awkward_showers(spark):
    df = steps(spark, [(1, 0, 0, 0, 0, 1, 1), (1, 1, 3, 4, 0, 1, 1), (2, 0, 5, 5, 5, 1, 1), (3, 0, 1, 0, 0, 0, 1), (3, 1, 2, 0, 0, 0, 1)])
    twice = spark.createDataFrame([(1, [-1.0, 0.0, 0.0]), (1, [-2.0, 0.0, 0.0])], "shower_id int, momentum array<float>")
    found = {r.shower_id: r for r in metrics.pca_axes(df, twice).collect()}
    assert len(found) == 3 and metrics.pca_axes(df, twice).count() == 3
    assert (found[1].ax, found[1].ay) == pytest.approx((-0.6, -0.8)) and found[2].ax is None and found[3].ax is None


def test_axis_is_turned_before_it_is_refined(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(40, 1, 10)])
    y = np.where(x > 20, 30.0, rng.normal(0, 0.2, 310))
    df = steps(spark, [(1, i, a, b, 0, 1, 1) for i, (a, b) in enumerate(zip(x, y, strict=True))])
    axis = {}
    for sign in (1.0, -1.0):
        r = metrics.pca_axes(df, spark.createDataFrame([(1, [sign, 0.0, 0.0])], "shower_id int, momentum array<float>")).first()
        axis[sign] = np.array([r.ax, r.ay, r.az])
        points = np.column_stack([x, y, 0 * x]).astype(np.float32).astype(float)
        first = np.linalg.eigh(np.cov(points.T))[1][:, 2]
        first *= np.sign(first[0]) * sign
        along = (points - points.mean(0)) @ first
        inside = (along >= np.percentile(along, 10)) & (along <= np.percentile(along, 99))
        want = np.linalg.eigh(np.cov(points[inside].T))[1][:, 2]
        assert abs(axis[sign] @ want) == pytest.approx(1, abs=1e-9) and axis[sign][0] * sign > 0
    assert abs(axis[1.0] @ axis[-1.0]) < 0.999  # the percentiles aren't symmetric


def test_crop_without_energy_and_marker_sizes(spark):
    from showerlake.operators.display import color_values, display_points, incident_label, marker_size, overlay_colors
    from showerlake.operators.select import energy_crop

    df = steps(spark, [(1, i, i, 0, 0, 0, 1) for i in range(4)] + [(2, i, i, 0, 0, 1 + 3 * (i == 0), 1) for i in range(4)]).withColumn("radial", F.col("x").cast("double"))
    assert {r.shower_id: r["count"] for r in energy_crop(df, 50).groupBy("shower_id").count().collect()} == {1: 4, 2: 4} and energy_crop(df, 60).where("shower_id = 2").count() == 2
    sizes = {(r.shower_id, r.point_index): r["size"] for r in marker_size(df, 5.0, least=1.0, together=True).collect()}
    assert sizes[2, 0] == 5.0 and sizes[2, 1] == 3.0 and sizes[1, 0] == 1.0
    even = spark.createDataFrame([(22, [2.5, 0.0, 0.0]), (22, [3.5, 0.0, 0.0])], "pdg int, momentum array<float>")
    assert [r[0] for r in even.select(incident_label(F.col("pdg"), F.col("momentum"))).collect()] == [r"2 GeV $\gamma$", r"4 GeV $\gamma$"]
    marked = df.withColumn("pdg", F.when(F.col("point_index") < 2, 11).otherwise(-13)).withColumn("cluster_label", F.col("point_index") * 10)
    assert {(r.pdg, r.color, r.color_lo, r.color_hi) for r in color_values(marked, "pdg").collect()} == {(-13, 0.0, -0.5, 1.5), (11, 1.0, -0.5, 1.5)}
    assert {r.color for r in overlay_colors(marked).collect()} == {0.0, 1.0, 2.0, 3.0}
    both = display_points({"a": df, "b": df.where("shower_id = 2")}, limits={"x": (0, 2)})
    assert both.count() == 9 and set(both.columns) >= {"series", "size", "color"}
    for wrong in ({}, dict.fromkeys("abcd", df)):
        with pytest.raises(ValueError):
            display_points(wrong)
    with pytest.raises(ValueError):
        color_values(df, "subdetector")


def test_percentiles_of_whole_tables(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], 400), np.array([4.0]), rng.integers(0, 3, 1000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        found = metrics.bracketed_percentiles(df, "v", (0.01, 0.5, 0.99, 1.0), accuracy=100).first()
        assert list(found) == pytest.approx(np.percentile(values, [1, 50, 99, 100]).tolist(), abs=1e-12)
    assert list(metrics.bracketed_percentiles(df.where("false"), "v", (0.5,)).first()) == [None]


def test_own_histograms_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, *rng.normal(size=3) * 10, rng.random() + 0.1, 1) for s in (1, 2) for i in range(80)]
    df = steps(spark, rows)
    found = {}
    for r in metrics.own_histograms(df, (0, 0, 1)).collect():
        found.setdefault((r.shower_id, r.variable), {})[r.bin] = r.weight
    for s in (1, 2):
        p = np.array([r[2:6] for r in rows if r[0] == s], np.float32).astype(float)
        e = p[:, 3]
        rel = p[:, :3] - np.average(p[:, :3], axis=0, weights=e)
        long, radial = rel[:, 2] - rel[0, 2], np.hypot(rel[:, 0], rel[:, 1])
        want = {"long": np.histogram(long, 30, weights=e), "radial": np.histogram(radial, 50, weights=e), "phi": np.histogram(np.arctan2(rel[:, 1], rel[:, 0]), np.linspace(-np.pi, np.pi, 51), weights=e), "log_energy": np.histogram(np.log10(e), 50)}
        for name, (h, _) in want.items():
            assert [found[s, name][i] for i in range(len(h))] == pytest.approx(h.tolist()), name


def _plain_hdbscan(x, size, samples, epsilon):
    """Clusters by definition: components of mutual reachability graphs at every height, chosen by excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)
    levels = np.unique(reach[np.triu_indices(n, 1)])[::-1]

    def parts(members, below):
        left, out = set(members), []
        while left:
            own, front = set(), [min(left)]
            while front:
                i = front.pop()
                own.add(i)
                front += [j for j in left - own if reach[i, j] < below and j not in front]
            left -= own
            out.append(frozenset(own))
        return out

    def grow(members, birth):
        """(stability, clusters inside) of a cluster born at lambda `birth`."""
        stable, now = 0.0, set(members)
        for h in levels:
            if len(now) < 2 or not any(reach[i, j] >= h for i in now for j in now if i != j):
                continue
            big = [p for p in parts(now, h) if len(p) >= size]
            at = 1 / h
            if len(big) >= 2:
                stable += (at - birth) * len(now)
                return stable, [(p, at, *grow(p, at)) for p in big]
            kept = set().union(*big)
            stable += (at - birth) * len(now - kept)
            now = kept
            if not now:
                break
        return stable, []

    def choose(cluster):
        members, birth, stable, inside = cluster
        picked, total = [], 0.0
        for c in inside:
            own, value = choose(c)
            picked += own
            total += value
        return (picked, total) if inside and total > stable else ([cluster], stable)

    _, inside = grow(range(n), 0.0)
    chosen = [c for top in inside for c in choose(top)[0]]
    return {frozenset(c[0]) for c in chosen}


@pytest.mark.parametrize("seed", range(6))
def test_hdbscan_against_its_definition(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (int(rng.integers(6, 16)), 2)) for c, s in (((0, 0), 0.5), ((6, 1), 1.0), ((0, 9), 0.3))] + [rng.uniform(-5, 14, (6, 2))])
    label = kernels.hdbscan(x, 5, 3)
    assert {frozenset(np.flatnonzero(label == k).tolist()) for k in range(label.max() + 1)} == _plain_hdbscan(x, 5, 3, 0.0)
