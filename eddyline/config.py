"""Column names and block sizes shared by every operator.

Nothing below knows about a sport: an operator reads the names it needs from a
``Spine``, so any ordered event log with two sides can be analysed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spine:
    """Names of the event-log columns, and the width of a scan block.

    ``order`` is a total order inside an entity: no two rows of one entity share
    a value. A block of ``block_span`` order values therefore never holds more
    than ``block_span`` rows, however large one entity grows.
    """

    entity: str = "gameId"
    order: str = "orderNumber"
    clock: str = "game_seconds_elapsed"
    remaining: str = "seconds_remaining"
    period: str = "period"
    wall: str = "timeActual"
    action: str = "actionType"
    sub: str = "subType"
    team: str = "teamId"
    person: str = "personId"
    possession: str = "possession"
    points: str = "points_scored"
    home: str = "scoreHome"
    away: str = "scoreAway"
    season: str = "season"
    season_type: str = "season_type"
    block_span: int = 1 << 20
    clock_span: int = 1 << 16

    def order_block(self, column: str | None = None) -> Column:
        """Block number of a row, monotone in the order column."""
        return block_of(column or self.order, self.block_span)

    def clock_block(self, column: str | None = None) -> Column:
        return block_of(column or self.clock, self.clock_span)


def block_of(column: str, span: int) -> Column:
    """Whole-number division, so that ids beyond 2^53 keep their block."""
    return F.expr(f"floor(`{column}`) div {int(span)}L")


SPINE = Spine()
