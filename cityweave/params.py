"""All thresholds and weights in one frozen object; every operator accepts an override."""
from __future__ import annotations

from dataclasses import dataclass, replace

from . import vocabulary as v


@dataclass(frozen=True)
class Params:
    # place
    bbox: tuple = v.CITY_BBOX
    centre: tuple = v.CITY_CENTRE
    tz: str = v.CITY_TZ
    hex_edge_m: float = v.HEX_EDGE_M
    namespace: str = v.EVENT_NAMESPACE
    # ingest
    stale_intervals: int = 3
    cluster_window_sec: int = 1800
    # baseline and detection
    lookback_hours: float = 3.0
    window_sec: int = 3600
    step_sec: int = 300
    min_support: int = 5
    prior_days: float = 5.0
    min_lambda: float = 1e-6
    p_volume: float = 0.01
    min_count: int = 3
    p_rare: float = 0.005
    rare_thresholds: tuple = v.RARE_THRESHOLDS  # that calibration tries, the loosest first
    rare_min_count: int = 1
    rare_min_severity: float = 0.40
    rare_rate: str = "hourly"  # or "all_hours"
    # linking
    link_max_distance: int = 1
    near_max_distance: int = 2
    near_max_gap_sec: int = 5400
    lift_smoothing: float = 0.5
    link_min_lift: float = 0.0
    lift_strong: float = 1.5
    lift_min_cooccurrences: int = 3
    w_space: float = 0.4
    w_time: float = 0.4
    w_lift: float = 0.2
    standalone_min_severity: float = 0.25
    # confidence and pulse
    high_max_gap_sec: int = 1800
    high_min_sources: int = 3
    med_min_sources: int = 2
    low_member_confidence: float = 0.5
    # serving
    active_window_sec: int = 1800
    stopped_pulse_penalty: int = 5
    strict_deadline: bool = False
    # raster
    frame_sec: int = 300
    show_depth_m: float = 0.02
    display_from_m: float = 0.03
    idw_power: float = 2.0
    # arrival positions per chunk of the two-level running operators: the most rows of one key a
    # task sorts; larger chunks mean fewer carried totals
    chunk_rows: int = 1_000_000

    def but(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
