"""The snapshot analysis as a data flow: positions -> metrics -> flags -> trend -> ranking -> roster tables.

Every stage returns a new DataFrame and all snapshots of all exchanges run in one pass, keyed by
(snapshot_date, exchange).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tradewright.config import DetectConfig, RankConfig
from tradewright.operators import rank, trend
from tradewright.operators.detect import detect
from tradewright.operators.metrics import snapshot_summary, trader_metrics
from tradewright.session import cut


@dataclass
class Analysis:
    summary: DataFrame
    metrics: DataFrame
    detected: DataFrame
    trended: DataFrame
    candidates: DataFrame
    roster: DataFrame
    tiered: DataFrame

    def new_disqualified(self) -> DataFrame:
        return trend.new_disqualified_incumbents(self.roster, self.trended)

    def diff(self) -> DataFrame:
        return rank.snapshot_diff(self.roster, self.summary, self.new_disqualified())

    def removed(self) -> DataFrame:
        return rank.removed(self.roster, self.tiered, self.summary)

    def roster_rows(self) -> DataFrame:
        return rank.roster_rows(self.roster, self.candidates)

    def report_tables(self) -> dict[str, DataFrame]:
        """The data behind the report, to be published as one set."""
        return {"roster": self.roster_rows(), "changes": self.diff(), "removed": self.removed(), "ages": rank.portfolio_ages(self.roster_rows()),
                "exclusions": rank.notable_exclusions(self.tiered)}


def analyse(positions: DataFrame, snapshot: DataFrame, open_positions: DataFrame | None = None, min_cell: int = 20,
            detect_config: DetectConfig = DetectConfig(), rank_config: RankConfig = RankConfig()) -> Analysis:
    """The benchmark, the metrics, the flagged metrics and the roster are stage tables; everything after them is per trader."""
    summary = cut(snapshot_summary(positions))
    metrics = cut(trader_metrics(positions, min_cell, snapshot, detect_config))
    detected = cut(detect(metrics, snapshot, positions, open_positions, detect_config))
    trended = trend.trend(detected, summary)
    candidates = rank.scored(trended, rank_config)
    roster = cut(rank.allocate(rank.seats(candidates, rank_config), rank_config))
    return Analysis(summary, metrics, detected, trended, candidates, roster, rank.tiers(candidates, roster))
