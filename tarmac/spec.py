"""Column names of the flight fact table, so every operator is reusable on
other on-time-performance tables with different naming."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FlightSpec:
    month: str = "Month"
    hour: str = "DepHour"
    carrier: str = "UniqueCarrier"
    origin: str = "Origin"
    dest: str = "Dest"
    dep: str = "DepDelay"
    arr: str = "ArrDelay"
    # cause column -> display label (fixed values used in result rows)
    causes: tuple[tuple[str, str], ...] = field(
        default=(
            ("CarrierDelay", "Carrier Delay"),
            ("WeatherDelay", "Weather Delay"),
            ("NASDelay", "NAS Delay"),
            ("SecurityDelay", "Security Delay"),
            ("LateAircraftDelay", "Late Aircraft Delay"),
        )
    )

    @property
    def cause_cols(self) -> list[str]:
        return [c for c, _ in self.causes]

    @property
    def measures(self) -> list[str]:
        return [self.arr, self.dep]

    @property
    def corr_cols(self) -> list[str]:
        return [self.arr, self.dep, *self.cause_cols]


DEFAULT = FlightSpec()
