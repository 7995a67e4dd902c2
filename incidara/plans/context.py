"""The derived tables of a feed, built once and shared by the queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.functions.bins import importance_bin, BIN_COLUMN
from incidara.operators import choropleth, daily, response, scatter, spatial
from incidara.roles import CITY_BOX, DEFAULT_BINS, MAX_RESPONSE_MINUTES, MIN_EVENTS, BinSpec, Roles


@dataclass(eq=False)
class Context:
    """Calls, boundaries and population, and what follows from them.

    Tables are lazy; those that several queries read are kept by ``persist`` and freed by ``close``.
    """

    calls: DataFrame
    polygons: DataFrame
    population: DataFrame
    roles: Roles = field(default_factory=Roles)
    bins: BinSpec = DEFAULT_BINS
    area: str = "mcpp_neighborhood"
    area_group: str = "mcpp_precinct"
    box: dict = field(default_factory=lambda: dict(CITY_BOX))
    max_minutes: float = MAX_RESPONSE_MINUTES

    @cached_property
    def rows(self) -> DataFrame:
        df = self.calls
        return (df if BIN_COLUMN in df.columns else df.withColumn(BIN_COLUMN, importance_bin(F.col(self.roles.category), self.bins))).persist()

    @cached_property
    def valid_time(self) -> DataFrame:
        return self.rows.filter(F.col(self.roles.event_time).isNotNull() & F.col(self.roles.event_id).isNotNull())

    @cached_property
    def located(self) -> DataFrame:
        """The latest row of each mappable event with its area."""
        r = self.roles
        events = spatial.mappable_events(self.rows, r, self.box)
        found = spatial.lookup(events, self.polygons, r.event_id, r.lon, r.lat, self.area, self.area_group)
        return events.join(found, r.event_id, "left").persist()

    @cached_property
    def response(self) -> DataFrame:
        return response.event_response(self.rows, self.roles, self.bins, self.max_minutes).persist()

    def daily(self, selected: Sequence[str]) -> DataFrame:
        return daily.daily_series(self.rows, self.roles, selected)

    def scatter(self, selected: Sequence[str], min_events: int = MIN_EVENTS) -> DataFrame:
        return scatter.concern_score(scatter.volume_response(self.response, self.population, self.roles, selected, min_events))

    def choropleth(self, selected: Sequence[str]) -> DataFrame:
        people = self.population.withColumnRenamed(self.roles.place, self.area)
        return choropleth.rates(self.located, self.polygons, people, self.roles, selected, self.area, self.max_minutes)

    def points(self, selected: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        return choropleth.map_points(self.located, self.choropleth(selected), self.roles, selected, self.area, start, end)

    def close(self) -> None:
        for name in ("rows", "located", "response"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


class Charts:
    """Small chart tables on the driver, remembered by their parameters; ``figures.Figures`` remembers whole specifications."""

    def __init__(self, context: Context, daily_size: int = 64, scatter_size: int = 64, map_size: int = 128):
        self.daily = lru_cache(daily_size)(lambda bins: context.daily(list(bins)).toPandas())
        self.scatter = lru_cache(scatter_size)(lambda bins: context.scatter(list(bins)).toPandas())
        self.choropleth = lru_cache(map_size)(lambda bins: context.choropleth(list(bins)).drop("rings").toPandas())
        self.point_count = lru_cache(map_size)(lambda bins, start, end: context.points(list(bins), start, end).count())
