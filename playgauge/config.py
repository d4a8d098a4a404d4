"""Parameters shared by the operators: codes, thresholds and band edges.

Fixed values: the defaults below decide the published classifications, so
results only agree with the published tables while they stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal as D

DIFFICULTY_ORDER = {"easy": 1, "normal": 2, "hard": 3, "mythic": 4}
UNKNOWN_DIFFICULTY_ORDER = 99
TIER_SUFFIX_PATTERN = " (Easy|Normal|Hard|Mythic)$"

MAX_PLAY_MINUTES_PER_DAY = 1440
CLEAR_REWARD_SOURCE = "content_clear"


@dataclass(frozen=True)
class Outcomes:
    """Codes of the attempt result column."""

    clear: str = "clear"
    fail: str = "fail"
    give_up: str = "give_up"
    disconnect: str = "disconnect"


@dataclass(frozen=True)
class GapThresholds:
    """When a content counts as off its design goals."""

    participation_share: D = D("0.7")
    clear_rate_drop_pp: D = D("15")
    clear_time_factor: D = D("1.3")
    death_factor: D = D("1.5")
    min_retry_attempts: int = 2


@dataclass(frozen=True)
class UsageThresholds:
    """Half-widths, in percentage points, of the 'as expected' zone."""

    peer_pp: D = D("5")
    target_pp: D = D("5")


@dataclass(frozen=True)
class DifficultyThresholds:
    """Limits of the three difficulty flags and of the verdict on their sum."""

    fail_rate_gap_pp: D = D("5")
    death_gap_pct: D = D("20")
    clear_time_gap_pct: D = D("20")
    likely_from: int = 2


@dataclass(frozen=True)
class ParticipationThresholds:
    """Power share of the near-ready population and the verdict limits."""

    near_ready_share: D = D("0.8")
    heavy_fail_rate: D = D("50")
    under_power_share_pct: D = D("30")


@dataclass(frozen=True)
class PowerBands:
    """Band edges as shares of the recommended power, lowest first."""

    cuts: tuple[D, ...] = (D("0.8"), D("1.0"), D("1.1"), D("1.2"))
    labels: tuple[str, ...] = (
        "01_under_80",
        "02_80_to_100",
        "03_100_to_110",
        "04_110_to_120",
        "05_120_and_over",
    )

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.cuts) + 1:
            raise ValueError("a band set needs one label more than it has cuts")


@dataclass(frozen=True)
class ReleaseStages:
    """Days since release at which the next stage begins."""

    settling_from: int = 30
    settled_from: int = 90


@dataclass(frozen=True)
class Settings:
    """Everything above in one bundle, each part replaceable."""

    outcomes: Outcomes = field(default_factory=Outcomes)
    gap: GapThresholds = field(default_factory=GapThresholds)
    usage: UsageThresholds = field(default_factory=UsageThresholds)
    difficulty: DifficultyThresholds = field(default_factory=DifficultyThresholds)
    participation: ParticipationThresholds = field(default_factory=ParticipationThresholds)
    bands: PowerBands = field(default_factory=PowerBands)
    release: ReleaseStages = field(default_factory=ReleaseStages)


DEFAULT = Settings()
