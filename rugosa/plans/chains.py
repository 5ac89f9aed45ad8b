"""Chains of operators that are recorded as rows: kept with a result they tell how it came about, and replayed they make it again from another table."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .registry import Registry, registry

SCHEMA = "step int, kind string, operator string, parameters string, citations array<string>"


@dataclass(frozen=True)
class Step:
    kind: str
    operator: str
    parameters: str  # JSON, tuples as lists

    def arguments(self) -> dict:
        return {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(self.parameters).items()}


@dataclass(frozen=True)
class Chain:
    """Steps in order. A chain is a value: then() gives a longer one, and nothing runs before on() is given points."""

    steps: tuple[Step, ...] = ()
    of: Registry = field(default_factory=lambda: registry, compare=False)

    def then(self, kind: str, operator: str, **parameters) -> Chain:
        """One operator of the registry more. Parameters must be what JSON can hold; an unknown operator or another parameter is an error at once."""
        if (kind, operator) not in self.of.entries:
            raise AttributeError(f"{kind} surfaces have no {operator!r}")
        text = json.dumps(parameters, sort_keys=True)
        step = Step(kind, operator, text)
        if step.arguments() != {k: tuple(v) if isinstance(v, list) else v for k, v in parameters.items()}:
            raise ValueError(f"{operator}: parameters that JSON doesn't keep can't be replayed")
        return Chain((*self.steps, step), self.of)

    def on(self, points: DataFrame) -> DataFrame:
        """The steps' transformations of points, still lazy."""
        for s in self.steps:
            points = self.of.apply(s.kind, s.operator, points, **s.arguments())
        return points

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, kind, operator, parameters, citations), one row a step."""
        return spark.createDataFrame([(i, s.kind, s.operator, s.parameters, list(self.of.entries[s.kind, s.operator].citations)) for i, s in enumerate(self.steps)], SCHEMA)

    @classmethod
    def read(cls, rows: DataFrame, of: Registry = registry) -> Chain:
        """The chain whose rows() these are, in any order. A step missing or there twice is an error."""
        got = sorted(rows.select("step", "kind", "operator", "parameters").limit(10_001).collect())
        if len(got) > 10_000 or [r.step for r in got] != list(range(len(got))):
            raise ValueError("these rows are not one chain's steps")
        out = cls((), of)
        for r in got:
            out = out.then(r.kind, r.operator, **Step(r.kind, r.operator, r.parameters).arguments())
        return out

    def __str__(self) -> str:
        return " | ".join(f"{s.operator}({', '.join(f'{k}={v!r}' for k, v in s.arguments().items())})" for s in self.steps)


def pipeline_function(name: str, *kinds: str, citations: tuple[str, ...] = (), of: Registry = registry) -> Callable:
    """A decorator that makes a function of points, and parameters by name, a step that chains can record."""
    return of.register(name, *kinds, citations=citations)
