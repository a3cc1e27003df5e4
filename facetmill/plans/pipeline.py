"""The whole analysis, stage by stage, each a set of DataFrames."""

from __future__ import annotations

import copy
import dataclasses
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.config import AggregationConfig
from facetmill.operators import clustering, components, directives, facts, graph, grouping, profile
from facetmill.sources import scan, sinks


class Analysis:
    """Stages of a source tree; each is made when first asked for.

    files: (path, src) rows; ``of`` reads them from a path.
    """

    def __init__(self, files: DataFrame, config: AggregationConfig | None = None):
        self.files, self.config = files, config or AggregationConfig()
        self.spark: SparkSession = files.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, path: str, config: AggregationConfig | None = None) -> Analysis:
        return cls(scan.scan(spark, path), config)

    @cached_property
    def blocks(self) -> DataFrame:
        return shared.stored(directives.extract(self.files), "blocks")

    @cached_property
    def _grouped(self) -> tuple[DataFrame, DataFrame]:
        groups, members = grouping.group(self.blocks)
        return shared.stored(groups, "groups"), shared.stored(members, "group_blocks")

    @property
    def groups(self) -> DataFrame:
        return self._grouped[0]

    @property
    def group_blocks(self) -> DataFrame:
        return self._grouped[1]

    @cached_property
    def universe(self) -> DataFrame:
        return shared.stored(grouping.universe(self.groups, "ids").select(F.coalesce("universe", F.array().cast("array<string>")).alias("universe")), "universe")

    @cached_property
    def facts(self) -> facts.Facts:
        return facts.extract(self.files, self.groups, self.group_blocks, self.universe)

    @cached_property
    def graph(self) -> graph.Graph:
        return graph.build(self.facts.entities, self.facts.relations)

    @cached_property
    def candidates(self) -> components.Candidates:
        return components.build(self.groups, self.group_blocks, self.facts.entities, self.graph.edges)

    @cached_property
    def compared(self) -> clustering.Compared:
        return clustering.compare(self.candidates, self.config)

    @cached_property
    def aggregation(self) -> clustering.Aggregation:
        return clustering.aggregate(self.candidates, self.groups, self.config, self.compared)

    def by(self, config: AggregationConfig) -> Analysis:
        """This analysis by another config; both share the candidates, and what compares components if only thresholds differ."""
        a = copy.copy(self)
        self.candidates  # noqa: B018 made once for both
        a.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("compared", "aggregation", "_profiled", "_tables")} | {"config": config}
        if dataclasses.replace(self.config, **{k: getattr(config, k) for k in clustering.THRESHOLDS}) == config:
            a.__dict__["compared"] = clustering.judged_by(self.compared, config)
        return a

    @cached_property
    def _profiled(self) -> tuple[DataFrame, DataFrame]:
        p, r = profile.build(self.candidates, self.aggregation, self.config)
        return shared.stored(p, "profiles"), r

    @property
    def profiles(self) -> DataFrame:
        return self._profiled[0]

    @property
    def importance(self) -> DataFrame:
        return self._profiled[1]

    @cached_property
    def _tables(self) -> dict[str, Callable[[], DataFrame]]:
        c, a, g, f = (lambda: self.candidates), (lambda: self.aggregation), (lambda: self.graph), (lambda: self.facts)
        return {
            "entities": lambda: f().entities, "relations": lambda: f().relations, "dependency-nodes": lambda: g().nodes, "dependency-edges": lambda: g().edges, "unresolved-relations": lambda: g().unresolved,
            "group-dependencies": lambda: graph.group_dependencies(g().edges), "feature-effect-candidates": lambda: c().candidates.withColumn("file_count", F.size("files")),
            "feature-effect-members": lambda: sinks.candidate_members(c().entities, c().blocks, c().internal), "candidate-dependencies": lambda: c().dependencies,
            "unassigned-blocks": lambda: self.spark.createDataFrame([], components.UNASSIGNED_BLOCKS), "aggregated-feature-effect-candidates": lambda: sinks.ordered(a().candidates),
            "aggregated-feature-effect-members": lambda: sinks.aggregated_members(a().candidates, a().members, c().entities), "component-similarities": lambda: self.compared.similarities, "component-merge-decisions": lambda: self.compared.decisions,
            "candidate-labels": lambda: sinks.labels(sinks.ordered(a().candidates), a().members, c().entities, a().evidence), "unassigned-components": lambda: a().unassigned.withColumn("reason", F.lit("insufficient semantic aggregation evidence")),
            "feature-evidence-profile": lambda: sinks.profile_rows(self.profiles),
        }

    def table(self, name: str) -> DataFrame:
        """The table of one report; only the stages it needs are made."""
        return self._tables[name]()

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The tables of all reports, by file name."""
        return {name: self.table(name) for name in self._tables}

    def export(self, directory: str) -> None:
        """All reports as CSV and text, and all tables as Parquet."""
        for name, df in self.tables.items():
            sinks.write_csv(df, name, directory)
        sinks.write_report(self.profiles, directory)
        sinks.write_tables(self.tables, f"{directory}/parquet")
