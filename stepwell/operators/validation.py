"""Argument checks, made before any plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.time import PERIODS

WINDOW_ANCHORS = ("entry", "previous")


def check_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {tuple(allowed)}, got {value!r}")


def check_steps(steps: Sequence[str]) -> None:
    names = list(steps)
    if len(names) < 2:
        raise ValueError(f"steps must list at least two event names, got {names!r}")
    if len(set(names)) < len(names):
        raise ValueError(f"steps must be distinct, got {names!r}")
    unusable = [name for name in names if not isinstance(name, str) or name == ""]
    if unusable:
        raise ValueError(f"steps must be non-empty strings, got {unusable!r}")


def check_window(window_hours: float, window_from: str) -> None:
    if not window_hours > 0:
        raise ValueError(f"window_hours must be positive, got {window_hours!r}")
    check_choice("window_from", window_from, WINDOW_ANCHORS)


def check_retention(period: str, max_periods: int) -> None:
    check_choice("period", period, PERIODS)
    if max_periods < 0:
        raise ValueError(f"max_periods must be >= 0, got {max_periods!r}")


def check_probabilities(probabilities: Sequence[float]) -> None:
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError(f"probabilities must lie between 0 and 1, got {list(probabilities)!r}")
