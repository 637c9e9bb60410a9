"""The rolling rate model: an adaptive window of coded frames is fitted, outliers go, and it is fitted again.

The length of a window depends on that of the one before, so a stream's frames are worked through in
order, with 20 frames of state.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_in_order

HISTORY = 20


def estimate(points: list[tuple[float, float]]) -> tuple[float, float]:
    """x1, x2 of r = x1 / q + x2 / q^2 over (q, r); first order where all q agree or nothing can be solved."""
    n = len(points)
    first = sum(q * r for q, r in points) / n
    if all(q == points[0][0] for q, _ in points):
        return first, 0.0
    inverse, squares = sum(1 / q for q, _ in points), sum(1 / (q * q) for q, _ in points)
    weighted, total = sum(q * r for q, r in points), sum(r for _, r in points)
    det = n * squares - inverse * inverse
    if abs(det) <= 1e-6:
        return first, 0.0
    return (weighted * squares - total * inverse) / det, (total * n - weighted * inverse) / det


State = tuple[int, int, float | None, tuple[tuple[float, float], ...]]
START: State = (0, 0, None, ())


def next_model(state: State, frame: tuple[float, float, float]) -> tuple[State, tuple[int, float, float]]:
    """The state (frames, window, mad before, points, newest first) and (window, x1, x2) after a frame (q, bits, mad)."""
    k, window, before, history = state
    q, bits, mad = frame
    history = ((q, bits / mad), *history)[:HISTORY]
    likeness = 1.0 if before is None or not max(mad, before) else min(mad, before) / max(mad, before)
    window = min(max(int(likeness * HISTORY), 1), k + 1, window + 1, HISTORY)
    held = list(history[:window])
    x1, x2 = estimate(held)
    errors = [x1 / q + x2 / (q * q) - r for q, r in held]
    limit = 0.0 if window == 2 else math.sqrt(sum(e * e for e in errors) / window)
    x1, x2 = estimate([p for n, (p, e) in enumerate(zip(held, errors, strict=True)) if n == 0 or abs(e) <= limit])
    return (k + 1, window, mad, history), (window, x1, x2)


def rolling_rate_model(frames: DataFrame, by: str = "stream_id", order: str = "i") -> DataFrame:
    """``by, order, window, x1, x2`` for frames with ``q``, ``bits`` and ``mad`` (above 0)."""
    return fold_in_order(frames.select(by, order, *[F.col(c).cast("double").alias(c) for c in ("q", "bits", "mad")]), by, order, START, next_model, "window long, x1 double, x2 double")
