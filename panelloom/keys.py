"""The key of a panel: one row per (asset, session date)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class PanelKeys:
    """Names of the asset and date columns of a panel.

    The date column has type DATE and (asset, date) is unique, so one asset never holds more
    rows than there are calendar days: the per-asset windows built here are bounded by the
    calendar, not by the data volume. `quality.duplicate_keys` checks the uniqueness.
    """

    asset: str = "asset"
    date: str = "date"

    @property
    def pair(self) -> list[str]:
        return [self.asset, self.date]

    def history(self) -> WindowSpec:
        return Window.partitionBy(self.asset).orderBy(self.date)


KEYS = PanelKeys()


def calendar_order(date: str = "date") -> WindowSpec:
    """Global order of a series with one row per date.

    Only for frames already reduced to one row per calendar day (a benchmark, a macro series,
    the session calendar); a panel goes through `PanelKeys.history` instead.
    """
    return Window.orderBy(date)
