"""Read, compress, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from showerlake.operators.merge import Result, summary
from showerlake.operators.validate import Validator, long_form
from showerlake.sources.steps import limit_showers, write_steps


@dataclass
class Report:
    result: Result
    validation: DataFrame | None

    @property
    def summary(self) -> DataFrame:
        return summary(self.result.stats)


@dataclass
class Pipeline:
    """algorithm has compress(steps) -> Result; where is applied before grouping, so it reaches the scan."""

    algorithm: object
    validators: tuple[Validator, ...] = ()
    where: object = None

    def run(self, steps: DataFrame, *, shower_limit: int | None = None) -> Report:
        steps = limit_showers(steps if self.where is None else steps.where(self.where), shower_limit)
        result = self.algorithm.compress(steps)
        found = {v.name: v.run(steps, result.points) for v in self.validators}
        return Report(result, long_form(found) if found else None)

    def run_to(self, steps: DataFrame, path: str, *, source_input: str, shower_limit: int | None = None) -> Report:
        report = self.run(steps, shower_limit=shower_limit)
        write_steps(report.result.points, path, algorithm=report.result.algorithm, source_input=source_input)
        return report
