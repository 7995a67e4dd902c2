"""Column roles: operators name what a column is for, and a binding says which column that is."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    """Columns of a call feed.  One event has one or more rows (dispatched units)."""

    event_id: str = "cad_event_number"
    row_id: str = "call_sign_dispatch_id"
    event_time: str = "cad_event_original_time_queued"
    arrival_time: str = "cad_event_arrived_time"
    category: str = "event_group"
    place: str = "dispatch_neighborhood"
    priority: str = "priority"
    staff: str = "count_of_officers"
    lat: str = "dispatch_latitude"
    lon: str = "dispatch_longitude"
    precinct: str = "dispatch_precinct"
    #: Columns that make the order of rows with one event time definite.
    ties: tuple[str, ...] = ()

    def bind(self, **columns) -> Roles:
        return replace(self, **columns)


@dataclass(frozen=True)
class BinSpec:
    """Which categories make which importance bin, and which bins are looked at by default."""

    bins: dict[str, tuple[str, ...]] = field(default_factory=dict)
    targets: tuple[str, ...] = ()
    other: str = "other / unclassified"
    unknown: str = "unknown / unclassified"


#: The feed's categories by bin, and the bins that are analysed.
DEFAULT_BINS = BinSpec(
    bins={
        "violent/person crime": (
            "assault",
            "domestic disturbance/violence",
            "homicide",
            "kidnap",
            "rape",
            "robbery",
            "sex offenses (non-rape)",
        ),
        "drug-related": ("narcotics",),
        "property/nonviolent": ("burglary", "theft", "car prowl", "fraud", "trespass"),
        "lower public-safety urgency": (
            "traffic",
            "disturbance",
            "misc. misdemeanors & violations",
            "warrant services/order",
            "person down/injury",
            "suspicious circumstances",
        ),
    },
    targets=("property/nonviolent", "drug-related", "violent/person crime"),
)

#: Fixed values of the analyses.
MAX_RESPONSE_MINUTES = 24 * 60
CITY_BOX = {"lat": (47.45, 47.75), "lon": (-122.46, -122.20)}
YEAR_DAYS, RECENT_DAYS, AVERAGE_DAYS = 364, 29, 7
MIN_EVENTS = 100
OVERLAP_DAYS, RETENTION_DAYS = 14, 365
EXCLUDED_PLACES = ("unknown", "-", "", "nan")
