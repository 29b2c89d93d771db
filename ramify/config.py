"""Settings that every stage shares. All of them are parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass

#: Quantile levels that reports show.
REPORTING = (0.01, 0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975, 0.99)
#: Quantile levels that scores integrate over: 199 of them, evenly spaced from 0.005 to 0.995.
SCORING = tuple(round(0.005 * k, 3) for k in range(1, 200))
#: Nominal coverages of reported intervals.
NOMINAL = (0.80, 0.90, 0.95)
#: Service levels between which a planner may choose, besides those of the inputs.
SLIDER = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Levels of the hierarchy from the root to the leaves.
LEVELS = ("city", "borough", "area")
ROOT = "ALL"
SEASON = 7


@dataclass(frozen=True)
class Schedule:
    """Forecast origins: every ``step`` days once ``min_train`` days have passed, ``horizon`` days ahead each.

    The defaults are fixed values. ``train_window`` limits the history a forecast sees; None lets it grow.
    """

    horizon: int = 14
    step: int = 7
    refit_every: int = 4
    min_train: int = 1095
    train_window: int | None = 1095

    def __post_init__(self) -> None:
        if min(self.horizon, self.step, self.refit_every, self.min_train) < 1:
            raise ValueError("horizon, step, refit_every and min_train must be positive")
        if self.train_window is not None and not 1 <= self.train_window <= self.min_train:
            raise ValueError("train_window must be positive and at most min_train")

    def count(self, n_days: int) -> int:
        """Number of origins in so many days; raises if there is none."""
        if n_days < self.min_train + self.horizon:
            raise ValueError(f"{n_days} days are too few for {self.min_train} of training and {self.horizon} ahead")
        return (n_days - self.min_train - self.horizon) // self.step + 1


DEFAULT = Schedule()


@dataclass(frozen=True)
class Panel:
    """Which leaves stay: the share of the window they span, and their mean count a day."""

    min_coverage: float = 0.98
    min_daily: float = 1.0


@dataclass(frozen=True)
class Conformal:
    """Calibration window in origins, target miscoverage, step sizes and learning rate of the adaptive methods."""

    window: int = 52
    alpha: float = 0.10
    gamma: float = 0.01
    gammas: tuple[float, ...] = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5)
    learning_rate: float = 0.05
    alpha_floor: float = 1e-4


def check_levels(levels) -> None:
    """Raise unless the quantile levels increase strictly inside (0, 1)."""
    if not len(levels) or not all(0 < q < 1 for q in levels) or any(b <= a for a, b in zip(levels, levels[1:], strict=False)):
        raise ValueError("levels must increase strictly between 0 and 1")


def interval_levels(coverage: float) -> tuple[float, float]:
    """The two levels that bound the central interval of a nominal coverage."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie between 0 and 1")
    tail = (1 - coverage) / 2
    return tail, 1 - tail


def level_index(levels, wanted: float) -> int:
    """Position of a level, exact to 1e-12; never interpolated."""
    for k, q in enumerate(levels):
        if abs(q - wanted) < 1e-12:
            return k
    raise ValueError(f"level {wanted} is not on the grid")


def check_level(name: str) -> str:
    """The name of a level of the hierarchy; any other is refused."""
    if name not in LEVELS:
        raise ValueError(f"{name} is not a level; the levels are {', '.join(LEVELS)}")
    return name
