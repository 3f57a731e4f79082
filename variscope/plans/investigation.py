"""The investigation: one cohort, every dimension, the best combinations."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from variscope.operators import attribution as A
from variscope.operators.cohort import CohortSpec, Predicate, drill


class Investigation:
    """Results of one cohort as DataFrames: ``scope``, ``contributions``, ``scores`` and
    ``interactions``. Drilling returns the investigation of the child cohort over the same rows."""

    def __init__(self, df: DataFrame, spec: CohortSpec, within: Investigation | None = None):
        self.df = df
        self.spec = spec
        self.population = A.Population(df, spec, within.population if within else None)

    @cached_property
    def scope(self) -> DataFrame:
        return A.scope_totals(self.population)

    @cached_property
    def contributions(self) -> DataFrame:
        """One row per category. Scores, candidates and evidence all read it, so it is persisted."""
        return A.group_dimension(self.population).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def scores(self) -> DataFrame:
        """One row per dimension, persisted for the candidates and the evidence."""
        return A.score_dimensions(self.contributions, self.population).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def best_dimensions(self) -> list[str]:
        """Names of the eight best-scored dimensions."""
        return [r["dimension"] for r in A.top_dimensions(self.scores, A.CANDIDATE_DIMENSIONS).collect()]

    @cached_property
    def candidates(self):
        """At most 16 rows by construction, read to the driver as literals of the next plan."""
        if not self.best_dimensions:
            return []
        return A.interaction_candidates(self.contributions, self.best_dimensions).collect()

    @cached_property
    def interactions(self) -> DataFrame:
        return A.find_interactions(self.population, self.candidates)

    @cached_property
    def run_id(self) -> str:
        """A stable id of the calculation: the specification and its totals."""
        s, t = self.spec, self.population.stats
        parts = [
            ",".join(s.dimensions), s.actual, s.expected or "", str(sorted(s.predicates)), s.polarity,
            s.aggregation, s.time_field or "", t["n"], t["actual"], t["expected"],
        ]
        text = "|".join(str(p) for p in parts)
        return "drv-" + hashlib.sha256(text.encode()).hexdigest()[:16]

    def release(self) -> None:
        """Free the persisted results of this cohort."""
        for kept in ("scores", "contributions"):
            if kept in self.__dict__:
                getattr(self, kept).unpersist()
        self.population.release()

    def drill(self, following: Sequence[Predicate]) -> Investigation:
        child = drill(self.spec, following)
        return Investigation(self.df, child, self if self.population.holds(child) else None)
