"""Engine parameters. Every operator takes the values it needs from one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    window_seconds: float = 10.0
    session_gap_seconds: float = 300.0
    warmup_windows: int = 90
    context: int = 64
    horizons: tuple[int, ...] = (6, 12, 30)
    primary_horizon: int = 30
    episode_merge_gap: int = 30
    onset_quiet: int = 30

    split_fractions: tuple[float, float, float] = (0.60, 0.15, 0.25)
    benign_keep: tuple[tuple[str, float], ...] = (("dapt2020", 0.2),)

    fpr_budgets: tuple[float, ...] = (0.01, 0.03)
    primary_fpr_budget: float = 0.03
    hysteresis: int = 2
    early_warning_budget: float = 0.05
    next_stage_blend: float = 0.25

    internal_cidrs: tuple[str, ...] = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

    new_pair_lookback: int = 64
    beacon_window: int = 6
    beacon_min_gaps: int = 4
    beacon_gap_seconds: tuple[float, float] = (2.0, 900.0)
    beacon_min_idle: float = 1.0
    seq_min_flows: int = 8

    # Rows of one channel or source that a single task should hold (operators/blocked.py).
    block_rows: int = 1_000_000
    # Position slice of one session that a single task may hold.
    session_block: int = 4096

    @property
    def gap_windows(self) -> int:
        return max(1, int(self.session_gap_seconds / self.window_seconds))


# Address ranges of the published corpora, for refine_stages and the m_ip features.
DATASET_CIDRS: dict[str, tuple[str, ...]] = {
    "cicids2017": ("192.168.10.0/24",),
    "cicids2018": ("172.31.0.0/16",),
    "ctu13": ("147.32.0.0/16",),
    "dapt2020": ("192.168.3.0/24",),
}
