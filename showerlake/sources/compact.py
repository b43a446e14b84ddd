"""Detector geometry from compact XML files: small configuration, read on the driver.

Constants are resolved when they are used, so a definition may come after its
use; of several of one name the last counts. `^` is a power and two numbers
side by side are a product, in every expression.
"""

from __future__ import annotations

import math
import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Lengths in mm, angles in rad; detector types and the grid that can be read.
UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "um": 1e-3, "nm": 1e-6, "tesla": 1.0, "deg": math.pi / 180.0, "rad": 1.0}
BARRELS = ("ODDPolyhedraBarrelCalorimeter", "DD4hep_PolyhedraBarrelCalorimeter2")
GRID = "CartesianGridXY"
_PART = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/^()]))")
PLANES = "module int, layer int, center_x double, center_y double, tan_x double, tan_y double, pitch_t double, pitch_z double, radius double, half_t double, half_z double, half_thickness double"


def evaluate(text: str, lookup) -> float:
    """The value of an arithmetic expression; lookup(name) gives names' values or raises KeyError."""
    parts, at, text = [], 0, text.rstrip()
    while at < len(text):
        found = _PART.match(text, at)
        if not found:
            raise ValueError(f"cannot read the expression {text!r}")
        number, name, sign = found.groups()
        if number and parts and isinstance(parts[-1], float):
            parts.append("*")
        parts.append(float(number) if number else ("name", name) if name else "^" if sign == "**" else sign)
        at = found.end()
    parts.append("end")
    k = 0

    def take():
        nonlocal k
        k += 1
        return parts[k - 1]

    def total() -> float:
        value = product()
        while parts[k] in ("+", "-"):
            value = value + product() if take() == "+" else value - product()
        return value

    def product() -> float:
        value = signed()
        while parts[k] in ("*", "/"):
            value = value * signed() if take() == "*" else value / signed()
        return value

    def signed() -> float:
        if parts[k] in ("+", "-"):
            return -signed() if take() == "-" else signed()
        base = one()
        if parts[k] == "^":
            take()
            return base ** signed()
        return base

    def one() -> float:
        part = take()
        if isinstance(part, float):
            return part
        if isinstance(part, tuple):
            return lookup(part[1])
        if part == "(":
            value = total()
            if take() == ")":
                return value
        raise ValueError(f"cannot read the expression {text!r}")

    value = total()
    if parts[k] != "end":
        raise ValueError(f"cannot read the expression {text!r}")
    return value


class Compact:
    """The files that a main file includes, each read once."""

    def __init__(self, path: str | Path):
        self.main, self.roots = str(path), {}
        todo = [Path(path).resolve()]
        while todo:
            own = todo.pop()
            if own in self.roots:
                continue
            self.roots[own] = ET.parse(own).getroot()
            refs = [os.path.expandvars(x.get("ref")) for x in self.roots[own].iter("include") if x.get("ref")]
            todo += [(own.parent / r).resolve() for r in reversed(refs)]

    @cached_property
    def _texts(self) -> dict[str, str]:
        return {c.get("name"): c.get("value", "") for r in self.roots.values() for c in r.iter("constant") if c.get("name")}

    def constant(self, name: str, within: tuple[str, ...] = ()) -> float:
        if name in within:
            raise ValueError(f"the constant {name!r} is defined by itself")
        if name in self._texts:
            return evaluate(self._texts[name], lambda n: self.constant(n, (*within, name)))
        return UNITS[name]

    def value(self, text: str) -> float:
        return evaluate(text, self.constant)

    def _first(self, where: str, attribute: str, value: str) -> ET.Element:
        for root in self.roots.values():
            for node in root.iterfind(f".//{where}"):
                if node.get(attribute) == value:
                    return node
        raise KeyError(f"{self.main} has no {where} whose {attribute} is {value!r}")

    def readout(self, name: str) -> ET.Element:
        return self._first("readouts/readout", "name", name)

    def detector(self, readout: str) -> ET.Element:
        return self._first("detectors/detector", "readout", readout)

    def encoding(self, readout: str) -> str:
        text = (self.readout(readout).findtext("id") or "").strip()
        if not text:
            raise ValueError(f"the readout {readout!r} has no id encoding")
        return text


@dataclass(frozen=True)
class Layer:
    """Where a layer starts and where its sensitive slice lies, from the inner face."""

    start: float
    thickness: float
    sensitive_center: float
    sensitive_thickness: float


@dataclass(frozen=True)
class Barrel:
    detector: str
    encoding: str
    sides: int
    rmin: float
    length: float
    gap: float
    pitch_t: float
    pitch_z: float
    layers: tuple[Layer, ...]

    @property
    def thickness(self) -> float:
        return sum(x.thickness for x in self.layers)

    def planes(self, spark: SparkSession) -> DataFrame:
        """A row for each module and layer, both from 1 on (see PLANES).

        Module m faces the angle (2 - m) * 2 pi / sides - pi / 2; its tangent is
        a quarter turn on. A layer is as wide as the polygon is at its start.
        """
        rows = []
        for m, x, y in self._directions():
            for k, own in enumerate(self.layers, 1):
                radius = self.rmin + own.start + own.sensitive_center
                rows.append((m, k, radius * x, radius * y, -y, x, self.pitch_t, self.pitch_z, radius, self._half_width(own), self.length / 2, own.sensitive_thickness / 2))
        return spark.createDataFrame(rows, PLANES)

    def boxes(self, spark: SparkSession) -> DataFrame:
        """As planes(), for the whole thickness of each layer instead of its sensitive slice."""
        rows = []
        for m, x, y in self._directions():
            for k, own in enumerate(self.layers, 1):
                radius = self.rmin + own.start + own.thickness / 2
                rows.append((m, k, radius * x, radius * y, -y, x, self.pitch_t, self.pitch_z, radius, self._half_width(own), self.length / 2, own.thickness / 2))
        return spark.createDataFrame(rows, PLANES)

    def envelopes(self, spark: SparkSession) -> DataFrame:
        """A row for each module (layer 0): all its layers, half_t wide at the inner face and half_t_outer at the outer."""
        radius, slope, rows = self.rmin + self.thickness / 2, math.tan(math.pi / self.sides), []
        for m, x, y in self._directions():
            rows.append((m, 0, radius * x, radius * y, -y, x, self.pitch_t, self.pitch_z, radius, self.rmin * slope, self.length / 2, self.thickness / 2, (self.rmin + self.thickness) * slope))
        return spark.createDataFrame(rows, PLANES + ", half_t_outer double")

    def _directions(self):
        """Each module's number and the direction it faces."""
        for m in range(1, self.sides + 1):
            a = (2 - m) * 2 * math.pi / self.sides - math.pi / 2
            yield m, math.cos(a), math.sin(a)

    def _half_width(self, layer: Layer) -> float:
        return (self.rmin + layer.start) * math.tan(math.pi / self.sides) - 2 * self.gap

    def report(self, layers: int = 5) -> str:
        """Sizes and the first layers, as text."""
        lines = [f"detector={self.detector}", f"encoding={self.encoding}", f"sides={self.sides}", f"rmin_mm={self.rmin:.3f}", f"length_mm={self.length:.3f}", f"thickness_mm={self.thickness:.3f}", f"layers={len(self.layers)}"]
        return "\n".join(lines + [f"layer {k}: start_mm={x.start:.3f} thickness_mm={x.thickness:.3f} sensitive_mm={x.sensitive_center:.3f}" for k, x in enumerate(self.layers[:layers], 1)])


def read_barrel(path: str | Path, readout: str) -> Barrel:
    """The barrel whose hits the readout collects; other detectors and grids raise NotImplementedError."""
    files = Compact(path)
    node, detector, encoding = files.readout(readout), files.detector(readout), files.encoding(readout)
    if detector.get("type") not in BARRELS:
        raise NotImplementedError(f"detectors of type {detector.get('type')!r} can't be read")
    grid, size = node.find("segmentation"), detector.find("dimensions")
    if grid is None or grid.get("type") != GRID:
        raise NotImplementedError(f"only readouts with a {GRID} can be read")
    if size is None:
        raise ValueError(f"the detector of {readout!r} has no dimensions")
    layers, start = [], 0.0
    for stack in detector.iterfind("layer"):
        widths = [(files.value(s.get("thickness")), s.get("sensitive") == "yes") for s in stack.iterfind("slice")]
        total, center, sensitive, upto = sum(w for w, _ in widths), 0.0, 0.0, 0.0
        for width, counts in widths:
            if counts:
                center, sensitive = upto + width / 2, width
            upto += width
        for _ in range(int(files.value(stack.get("repeat")))):
            layers.append(Layer(start, total, center, sensitive))
            start += total
    return Barrel(
        detector.get("name"), encoding, int(files.value(size.get("numsides"))), files.value(size.get("rmin")), files.value(size.get("z")),
        files.value(detector.get("gap", "0")), files.value(grid.get("grid_size_x")), files.value(grid.get("grid_size_y")), tuple(layers),
    )
