"""Run parameters. Values enter the plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StatusCodes:
    operating: tuple[int, ...] = (1, 100)
    fault: tuple[int, ...] = (200, 201, 202)
    maintenance: tuple[int, ...] = (300,)
    grid: tuple[int, ...] = (400,)
    curtailment: tuple[int, ...] = (500,)
    environmental: tuple[int, ...] = (600,)


@dataclass(frozen=True)
class FutureLosses:
    availability_pct: float = 0.0
    curtailment_pct: float = 0.0
    electrical_pct: float = 0.0
    blade_degradation_pct: float = 0.0

    def any(self) -> bool:
        return any((self.availability_pct, self.curtailment_pct,
                    self.electrical_pct, self.blade_degradation_pct))


@dataclass(frozen=True)
class FarmParams:
    farm_name: str = "Wind Farm"
    rated_power_kw: float = 2500.0
    cut_in_mps: float = 3.0
    cut_out_mps: float = 25.0
    hub_height_m: float = 100.0
    rotor_diameter_m: float = 136.0
    # records
    interval_h: float = 1.0 / 6.0
    air_density_correction: bool = True
    air_pressure_kpa: float | None = None
    status_codes: StatusCodes = field(default_factory=StatusCodes)
    # True: a valid record without a status code stays "missing" instead of "operating"
    strict_flags: bool = False
    max_gap_slots: int = 36
    # binning and sectors
    bin_width_mps: float = 0.5
    min_bin_count: int = 3
    sector_width_deg: int = 30
    # wake
    wake_ti: float = 0.10
    wake_model: str = "layout"            # layout | scada
    wake_bearing: str = "from"            # from | toward: what a direction of 180 means
    ct_curve: tuple[tuple[float, float], ...] = ()   # (m/s, thrust coefficient) in order; empty: the default curve
    # losses, long term
    electrical_loss_pct: float = 2.0
    other_loss_pct: float = 0.5
    loss_mode: str = "sum"                # sum | product
    future_losses: FutureLosses = field(default_factory=FutureLosses)
    lt_primary_method: str = "method_a"   # method_a | method_b | method_b_auto | normalised_month
    excluded_months: tuple[str, ...] = ()
    normalize_days: float = 30.0
    lt_density_correction: bool = True
    site_elevation_m: float = 0.0
    preconstruction_p50_gwh: float | None = None
    uncertainty_overrides_pct: dict = field(default_factory=dict)
