import math

import pytest

from showerlake.operators.layout import bounds, cell_center, cell_polygons, cells, crossing, grid_lines, layers_in_view, outlines, overlapping
from showerlake.operators.merge import MergeWithinRegularSubcell
from showerlake.sources.compact import Compact, evaluate, read_barrel

PART = """<lccdd><define><constant name="inner" value="width * 2 + 1.2*m"/><constant name="width" value="2*cm"/></define>
<detectors><detector name="Barrel" type="{kind}" readout="Hits" gap="1*mm"><dimensions numsides="8" rmin="inner" z="40*cm"/>
<layer repeat="2"><slice thickness="4*mm"/><slice thickness="2*mm" sensitive="yes"/></layer>
<layer repeat="2^0"><slice thickness="3 2"/></layer></detector></detectors></lccdd>"""
MAIN = """<lccdd><include ref="part.xml"/><include ref="./part.xml"/><readouts><readout name="Hits"><segmentation type="CartesianGridXY" grid_size_x="10*cm" grid_size_y="10*cm"/>
<id>module:4,layer:4,x:16:-8,y:-8</id></readout></readouts></lccdd>"""


@pytest.fixture
def compact(tmp_path):
    (tmp_path / "part.xml").write_text(PART.format(kind="DD4hep_PolyhedraBarrelCalorimeter2"))
    (tmp_path / "main.xml").write_text(MAIN)
    return tmp_path / "main.xml"


def test_expressions():
    look = {"a": 3.0}.__getitem__
    assert evaluate("-2^2 + a*(1 - .5)/2", look) == -3.25
    assert evaluate("2**3**2", look) == 512 and evaluate("2 3 + 1e-1", look) == 6.1 and evaluate("2^-1", look) == 0.5
    with pytest.raises(KeyError):
        evaluate("b + 1", look)
    for bad in ("1 +", "(1", "1)", "$x", ""):
        with pytest.raises(ValueError):
            evaluate(bad, look)


def test_barrel(spark, compact):
    made = read_barrel(compact, "Hits")
    assert (made.sides, made.rmin, made.length, len(made.layers), made.thickness) == (8, 1240.0, 400.0, 3, 18.0)
    assert made.encoding.startswith("module:4") and "layers=3" in made.report()
    rows = {(r.module, r.layer): r for r in made.planes(spark).collect()}
    assert len(rows) == 24
    for (m, k), r in rows.items():
        # walk there as a plain construction would: module centre, then out along its radius
        turn = math.pi / 8 - (m - 1) * math.pi / 4
        x, y = math.sin(turn), -math.cos(turn)
        x, y = x * math.cos(math.pi / 8) - y * math.sin(math.pi / 8), x * math.sin(math.pi / 8) + y * math.cos(math.pi / 8)
        radius = 1240 + [5, 11, 12][k - 1]
        assert (r.center_x, r.center_y, r.tan_x, r.tan_y) == pytest.approx((x * radius, y * radius, -y, x))
        assert r.half_t == pytest.approx((1240 + 6 * (k - 1)) * math.tan(math.pi / 8) - 2)


def test_failures(compact):
    with pytest.raises(KeyError):
        Compact(compact).readout("Other")
    (compact.parent / "part.xml").write_text(PART.format(kind="Endcap"))
    with pytest.raises(NotImplementedError):
        read_barrel(compact, "Hits")
    (compact.parent / "part.xml").write_text('<lccdd><constant name="a" value="b"/><constant name="b" value="a"/></lccdd>')
    with pytest.raises(ValueError):
        Compact(compact).constant("a")


def test_cells_outlines_and_bounds(spark, compact):
    planes = read_barrel(compact, "Hits").planes(spark).where("module = 1 and layer = 1")
    plane = planes.first()
    made = cells(planes)
    rows = made.collect()
    assert sorted({r.cell_z for r in rows}) == [-2, -1, 0, 1, 2]  # half of 400 by 100: the outer cells are cut
    area = sum((r.t1 - r.t0) * (r.z1 - r.z0) for r in rows)
    assert area == pytest.approx(4 * plane.half_t * plane.half_z)
    at = made.select("cell_t", "cell_z", *cell_center(made.cell_t, made.cell_z)).where("cell_t = 1 and cell_z = 2").first()
    assert (at.x, at.y, at.z) == pytest.approx((plane.center_x + 100 * plane.tan_x, plane.center_y + 100 * plane.tan_y, 200))
    edges = outlines(planes)
    assert edges.count() == 12
    lengths = sorted(round(math.dist((r.x0, r.y0, r.z0), (r.x1, r.y1, r.z1)), 6) for r in edges.collect())
    assert lengths == sorted(round(x, 6) for x in [2.0, 400.0, 2 * plane.half_t] for _ in range(4))
    limits = bounds(edges).first()
    assert (limits.z_low, limits.z_high) == pytest.approx((-220, 220))
    assert crossing(edges, {"z": (200, None)}).count() == 0 and crossing(edges, {"z": (199, None)}).count() == 8
    assert cells(planes.where("false")).count() == outlines(planes.where("false")).count() == 0


def test_subcells_of_a_read_barrel(spark, compact):
    barrel = read_barrel(compact, "Hits")
    plane = barrel.planes(spark).where("module = 1 and layer = 1").first()
    rows = [(1, i, plane.center_x + t * plane.tan_x, plane.center_y + t * plane.tan_y, z, 1.0 + i, 0.0, 1 | 1 << 4) for i, (t, z) in enumerate([(-20.0, -20.0), (-20.0, 20.0), (20.0, -20.0), (20.0, 20.0)])]
    steps = spark.createDataFrame(rows, "shower_id int, point_index bigint, x float, y float, z float, e float, t float, cell_id bigint")
    for mode in ("weighted", "center"):
        points = MergeWithinRegularSubcell(geometry=barrel.planes(spark), encoding=barrel.encoding, position=mode).compress(steps).points.collect()
        assert len(points) == 4 and sum(p.e for p in points) == 10.0


def test_boxes_and_envelopes(spark, compact):
    barrel = read_barrel(compact, "Hits")
    box = barrel.boxes(spark).where("module = 1 and layer = 3").first()
    assert (box.radius, box.half_thickness) == (1240 + 12 + 3, 3.0)
    module = barrel.envelopes(spark).where("module = 1")
    ends = outlines(module).collect()
    assert len(ends) == 12 and barrel.envelopes(spark).count() == 8
    flat = [math.dist((r.x0, r.y0), (r.x1, r.y1)) for r in ends if r.z0 == r.z1]
    slope = 2 * math.tan(math.pi / 8)
    side = math.hypot(18.0, 9 * slope)
    assert sorted(flat) == pytest.approx(sorted([1240 * slope] * 2 + [1258 * slope] * 2 + [side] * 4))


def test_views(spark, compact):
    planes = read_barrel(compact, "Hits").planes(spark).where("module = 2 and layer = 1")
    plane = planes.first()

    def area(corners):
        turned = corners[1:] + corners[:1]
        return abs(sum(a.u * b.v - a.v * b.u for a, b in zip(corners, turned))) / 2

    total = lambda view: sum(area(r.corners) for r in cell_polygons(planes, view).collect())
    assert total("xy") == pytest.approx(2 * plane.half_t * 2 * plane.half_thickness)
    height = 2 * (abs(plane.tan_y) * plane.half_t + abs(plane.tan_x) * plane.half_thickness)
    assert total("zy") == pytest.approx(2 * plane.half_z * height)
    assert cell_polygons(planes, "xz").count() == cells(planes).count()
    lines = grid_lines(planes, "zy").collect()
    assert sorted(r.corners[0].u for r in lines) == [-200.0, -100.0, 0.0, 100.0, 200.0]
    assert all(math.dist(r.corners[0], r.corners[1]) == pytest.approx(2 * plane.half_thickness) for r in grid_lines(planes, "xy").collect())
    strips = cell_polygons(planes, "zy")
    assert overlapping(strips, u=(150, None)).count() == 1 and overlapping(strips, u=(200, None)).count() == 0
    assert layers_in_view(strips, u=(None, 0)).collect() == [(2, 1)]
    with pytest.raises(ValueError):
        cell_polygons(planes, "yx")
