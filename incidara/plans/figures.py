"""Chart specifications of a context, remembered by everything that they depend on."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from functools import lru_cache

from incidara.operators.scatter import guide_lines
from incidara.plans import charts
from incidara.plans.context import Context
from incidara.roles import MIN_EVENTS


class Figures:
    """The daily, scatter and map charts that were asked for last.

    A chart that is asked for again with the same bins, dates and switches runs no job.  What is returned is the caller's own: changes
    to it do not reach later answers.  ``uirevision`` stays the same, so a reader's zoom outlives a change of bins.
    """

    def __init__(self, context: Context, daily_size: int = 64, scatter_size: int = 64, map_size: int = 128):
        self.context = context
        self._daily, self._scatter, self._map = lru_cache(daily_size)(self._make_daily), lru_cache(scatter_size)(self._make_scatter), lru_cache(map_size)(self._make_map)

    def daily(self, selected: Sequence[str], legend: bool = True) -> dict:
        return copy.deepcopy(self._daily(tuple(selected), legend))

    def scatter(self, selected: Sequence[str], legend: bool = True, min_events: int = MIN_EVENTS) -> dict:
        return copy.deepcopy(self._scatter(tuple(selected), legend, min_events))

    def map(self, selected: Sequence[str], start: str | None = None, end: str | None = None, show_colorbar: bool = False, zoom: float = charts.ZOOM) -> tuple[dict, int]:
        """The map of the days from ``start`` to ``end``, and how many points it shows."""
        chart, shown = self._map(tuple(selected), start, end, show_colorbar, zoom)
        return copy.deepcopy(chart), shown

    def _make_daily(self, selected, legend):
        return _laid_out(charts.daily_chart(self.context.daily(selected), selected), "daily", legend)

    def _make_scatter(self, selected, legend, min_events):
        scores = self.context.scatter(selected, min_events).persist()  # a row for each place and bin, read twice
        try:
            chart = charts.scatter_chart(scores, self.context.roles.place, selected, guide_lines(scores))
        finally:
            scores.unpersist()
        return _laid_out(chart, "scatter", legend)

    def _make_map(self, selected, start, end, show_colorbar, zoom):
        context = self.context
        rates, points = context.choropleth(selected), context.points(selected, start, end)
        chart = charts.map_chart(rates, points, context.roles, context.area, selected, show_colorbar=show_colorbar, zoom=zoom)
        return _laid_out(chart, "map"), charts.count_points(chart)


def _laid_out(chart: dict, name: str, legend: bool = True) -> dict:
    layout = chart["layout"] | {"showlegend": legend, "autosize": True, "uirevision": f"keep-{name}"}
    return chart | {"layout": layout}
