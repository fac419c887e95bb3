"""The tables an analysis session works on, staged once per input folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from eddyline.plans import classify, impact, state, windows
from eddyline.session import prepare, reuse_layout, spread, stage
from eddyline.sources import adapter, side_tables

_OPEN: dict[tuple[str, str], "Tables"] = {}


class Tables:
    """Raw tables by name, and the staged choke points.

    ``spine`` is the adapter's output, ``enriched`` the ETL result, ``impact`` and
    ``rich`` the analysis frames. Each is written once as Parquet in the shared
    folder, and every later plan prunes the columns it needs from it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self.rows = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Tables":
        key = (spark.sparkContext.applicationId, folder.rstrip("/"))
        if key not in _OPEN:
            _OPEN[key] = cls(spark, folder)
        spread(spark, _OPEN[key].rows)
        return _OPEN[key]

    @classmethod
    def refresh(cls, spark: SparkSession, folder: str) -> "Tables":
        """Open the folder anew: what was staged from it before is not used again."""
        _OPEN.pop((spark.sparkContext.applicationId, folder.rstrip("/")), None)
        return cls.open(spark, folder)

    def raw(self, name: str) -> DataFrame:
        """A given table. The largest one opened says how many tasks its folder asks for."""
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.rows = max(self.rows, table.count())
        spread(self.spark, self.rows)
        return table

    @cached_property
    def spine(self) -> DataFrame:
        return stage(adapter.spine_from_events(self.raw("events")), "spine")

    @cached_property
    def sides(self) -> DataFrame:
        """Home and away team: one row per entity."""
        return stage(state.sides(self.spine), "sides")

    @cached_property
    def labels(self) -> DataFrame:
        """Role and cause of the intervention rows."""
        return stage(classify.classify_events(self.spine, self.sides.drop("away_teamId")), "labels")

    @cached_property
    def enriched(self) -> DataFrame:
        with reuse_layout(self.spark):
            # not by folders of a season: every task would sort for them and write a sliver to each
            return stage(state.enrich(self.spine, self.labels, self.sides), "enriched")

    @cached_property
    def impact(self) -> DataFrame:
        """Run-impact frame of the base experiment: runs of 6, three minutes."""
        return stage(impact.run_impact(self.enriched), "impact")

    @cached_property
    def rich(self) -> DataFrame:
        """The same with challenges as a group of their own."""
        return stage(impact.run_impact(self.enriched, challenge_apart=True), "rich")

    @cached_property
    def plays(self) -> DataFrame:
        return adapter.as_plays(self.enriched)

    @cached_property
    def possessions(self) -> DataFrame:
        return state.possessions(self.enriched)

    @cached_property
    def events(self) -> DataFrame:
        """Interventions with the possessions before and after them."""
        return stage(windows.event_windows(self.enriched, self.possessions), "events")

    @cached_property
    def event_table(self) -> DataFrame:
        """The same with the teams' baselines."""
        return stage(windows.with_baselines(self.events, self.spine, self.possessions), "event-table")

    @cached_property
    def stints(self) -> DataFrame:
        return stage(side_tables.stints(self.spine), "stints")

    @cached_property
    def rotations(self) -> DataFrame:
        return side_tables.rotations(self.stints)

    @cached_property
    def player_advanced(self) -> DataFrame:
        return side_tables.player_advanced(self.raw("customer"))

    @cached_property
    def player_season(self) -> DataFrame:
        return side_tables.player_season(self.raw("orders"))

    @cached_property
    def boxscores(self) -> DataFrame:
        return side_tables.boxscores(self.spine)
