"""Parameters of the analyses, with the defaults that results are compared at (fixed values). Times in seconds unless the name says otherwise, frequencies in Hz."""

from __future__ import annotations

from dataclasses import dataclass, fields

Span = tuple[float, float]


@dataclass(frozen=True)
class Parameters:
    """Checks what all families share: numbers are not negative unless they are places in time, spans rise, shares lie in 0 to 1."""

    def __post_init__(self) -> None:
        for f in fields(self):
            v, name = getattr(self, f.name), f"{type(self).__name__}.{f.name}"
            if isinstance(v, tuple) and len(v) == 2 and not v[0] < v[1]:
                raise ValueError(f"{name} must rise: {v}")
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v < 0:
                raise ValueError(f"{name} must not be negative: {v}")
            if f.name in ("missing", "finite", "quantile", "share", "confidence", "locked") and not 0 <= v <= 1:
                raise ValueError(f"{name} is a share: {v}")

    @staticmethod
    def frames(seconds: float, fps: float, least: int = 1) -> int:
        return max(least, round(seconds * fps))

    @staticmethod
    def lags(span: Span, fps: float) -> tuple[int, int]:
        """A span of seconds around an event as lags in frames."""
        return round(span[0] * fps), round(span[1] * fps)


@dataclass(frozen=True)
class EnsembleComparison(Parameters):
    ks: tuple[int, ...] = (2, 3, 4, 5, 6)
    replicates: int = 20
    share: float = 0.8
    most: int = 8
    acf: Span = (0.0, 120.0)
    band: Span = (0.005, 0.2)
    prominence: float = 0.13


@dataclass(frozen=True)
class RhythmAgainstNoise(Parameters):
    window: float = 300.0
    step: float = 60.0
    surrogates: int = 100
    signal: str = "pc1"


@dataclass(frozen=True)
class KSweep(Parameters):
    ks: tuple[int, ...] = (3, 4, 5, 6, 8)
    epoch_minutes: Span = (2.0, 27.0)


@dataclass(frozen=True)
class LowHighWindows(Parameters):
    window_minutes: float = 20.0
    step_minutes: float = 5.0
    missing: float = 0.20


@dataclass(frozen=True)
class ManifoldWindows(Parameters):
    window_minutes: float = 20.0
    step_minutes: float = 5.0
    components: int = 10
    missing: float = 0.05


@dataclass(frozen=True)
class PhaseReset(Parameters):
    band: Span = (0.01, 0.05)
    around: float = 120.0
    pre: Span = (-40.0, -5.0)
    post: Span = (5.0, 40.0)
    peak: Span = (0.0, 40.0)
    least_events: int | None = 8
    least_gap: float = 20.0
    order: int = 3


@dataclass(frozen=True)
class SensoryReset(PhaseReset):
    """As ``PhaseReset`` without a gate on the number of events."""

    least_events: int | None = None


@dataclass(frozen=True)
class NoiseModelEvents(Parameters):
    rate: float = 4.0
    decay: float = 2.0
    confidence: float = 0.99
    merge: float = 0.5
    delete: float = 0.5


@dataclass(frozen=True)
class MadEvents(Parameters):
    height: float = 4.0
    gap: float = 3.5
    prominence: float = 2.5
    quantile: float = 0.9
    least: float = 10.0


@dataclass(frozen=True)
class Loops(Parameters):
    smooth: float = 0.5
    low: float = 0.5
    peak: float = 1.0
    least: float = 1.0


@dataclass(frozen=True)
class InterHemisphere(Parameters):
    lag: float = 120.0
    area: float = 10.0
    zscored: bool = True


@dataclass(frozen=True)
class CorrByDistance(Parameters):
    bins: int = 50
    least: float = 50.0
    fallback: float = 100.0
    shuffles: int = 100


@dataclass(frozen=True)
class ConditionStats(Parameters):
    smooth: float = 0.10
    k: float = 4.0
    least_bout: float = 0.20
    pooled: bool = True
