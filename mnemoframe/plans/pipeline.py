"""Pipelines of named DataFrame steps: chaining, fan-out, stamping, warn-only stages."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[DataFrame], DataFrame]
log = logging.getLogger("mnemoframe")


@dataclass
class Pipeline:
    """Steps run lazily one after the other; each may state the columns that it needs."""

    name: str
    steps: list[tuple[str, Step, tuple[str, ...]]] = field(default_factory=list)

    def then(self, name: str, step: Step, needs: tuple[str, ...] = ()) -> Pipeline:
        return Pipeline(self.name, [*self.steps, (name, step, needs)])

    def run(self, df: DataFrame, stamp: bool = False) -> DataFrame:
        for rank, (name, step, needs) in enumerate(self.steps):
            missing = [c for c in needs if c not in df.columns]
            if missing:
                raise ValueError(f"step {name} of {self.name} needs {missing}")
            df = step(df)
            if stamp:
                df = stamped(df, self.name, name, rank)
        return df


def stamped(df: DataFrame, pipeline: str, task: str, rank: int) -> DataFrame:
    """Provenance columns; what is already stamped stays."""
    for column, value, kind in (("source_pipeline", pipeline, T.StringType()), ("source_task", task, T.StringType()), ("topological_rank", rank, T.IntegerType())):
        given = F.lit(value).cast(kind)
        df = df.withColumn(column, F.coalesce(F.col(column), given) if column in df.columns else given)
    return df


def fan_out(*steps: Step) -> Step:
    """The same input through several steps, their results in one."""
    return lambda df: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s(df) for s in steps])


def keep_going(stages: list[tuple[str, Callable[[], object]]]) -> dict[str, object]:
    """Run stages in order; one that fails is logged and skipped."""
    done: dict[str, object] = {}
    for name, stage in stages:
        try:
            done[name] = stage()
        except Exception as e:  # noqa: BLE001 - the stages are independent improvements
            log.warning("stage %s failed: %s", name, e)
            done[name] = None
    return done
