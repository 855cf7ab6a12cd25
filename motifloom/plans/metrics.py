"""Counts and times of runs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@contextmanager
def timed(times: dict[str, float], name: str) -> Iterator[None]:
    """Adds the wall seconds of the block to times[name]."""
    began = time.perf_counter()
    try:
        yield
    finally:
        times[name] = times.get(name, 0.0) + time.perf_counter() - began


def observed(df: DataFrame, name: str = "rows", weight: str | None = None) -> tuple[DataFrame, Observation]:
    """df that counts its rows, or adds up a column, while an action runs over it; the observation's get holds that afterwards."""
    seen = Observation(name)
    counted = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))
    return df.observe(seen, counted.alias("n")), seen


_EXCLUDED, _EMPTY = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


class Levels:
    """What the levels of a mining run did: a row for each, observed in the level's own jobs.

    projections: rows of growth before support is known (graphs: in which graphs codes may grow by which edge);
    candidates: distinct patterns among them; frequent: those that reach the support; canonical: those of them that
    count, which go on. A level's last counts stand once its patterns are written.
    """

    COUNTS = ("projections", "candidates", "frequent", "canonical")

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self._seen: dict[str, Observation] = {}
        self._began = 0.0

    @contextmanager
    def level(self, spark: SparkSession) -> Iterator[None]:
        """For the jobs of one level. Empty parts of a plan are not cut out meanwhile, as their observations would go with them."""
        self._seen, self._began = {}, time.perf_counter()
        before = spark.conf.get(_EXCLUDED, None)
        spark.conf.set(_EXCLUDED, ",".join(filter(None, (before, _EMPTY))))
        try:
            yield
            self._end()
        finally:
            spark.conf.set(_EXCLUDED, before) if before is not None else spark.conf.unset(_EXCLUDED)

    def watched(self, name: str, df: DataFrame, weight: str | None = None) -> DataFrame:
        """df that counts its rows (or adds up a column) as `name` of this level."""
        df, self._seen[name] = observed(df, f"{name}-{len(self.rows)}-{id(self)}", weight)
        return df

    def _end(self) -> None:
        counts = {name: seen.get["n"] for name, seen in self._seen.items()}
        self.rows.append({"level": len(self.rows) + 1} | {name: counts.get(name, counts.get("frequent", 0)) for name in self.COUNTS} | {"seconds": time.perf_counter() - self._began})

    def frame(self, spark: SparkSession) -> DataFrame:
        """level, the counts, seconds."""
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], "level int, projections long, candidates long, frequent long, canonical long, seconds double")
