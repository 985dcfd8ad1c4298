"""Rates over counts as SQL expressions, with every zero case spelled out.

Spark in ANSI mode raises on x / 0, so each division is guarded.
"""

from __future__ import annotations


def step_conversion(users: str, previous: str) -> str:
    """Share of the previous step. First step and 0 / 0 give 1.0; n / 0 gives infinity."""
    return (
        f"CASE WHEN {previous} IS NULL OR ({previous} = 0 AND {users} = 0) THEN 1D"
        f" WHEN {previous} = 0 THEN DOUBLE('Infinity')"
        f" ELSE {users} / {previous} END"
    )


def overall_conversion(users: str, entered: str) -> str:
    """Share of the users who entered; 0.0 when nobody did."""
    return f"CASE WHEN {entered} = 0 THEN 0D ELSE {users} / {entered} END"


def wilson_bound(successes: str, total: str, z: float, *, upper: bool) -> str:
    """One end of the Wilson score interval of ``successes / total``."""
    n, rate = f"DOUBLE({total})", f"({successes} / {total})"
    z1, z2 = f"{z!r}D", f"{z * z!r}D"
    centre = f"({rate} + {z2} / (2D * {n}))"
    margin = f"({z1} * sqrt({rate} * (1D - {rate}) / {n} + {z2} / (4D * {n} * {n})))"
    return f"({centre} {'+' if upper else '-'} {margin}) / (1D + {z2} / {n})"
