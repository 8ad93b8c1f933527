"""Shaping of lines, as array expressions over ``array<array<double>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamgrid.config import DISPLAY_CAP


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def subsample(line: Column, most: int) -> Column:
    """About every n-th place and the last, at most ``most``."""
    if most < 2:
        return F.when(F.size(line) <= most, line).otherwise(F.slice(line, 1, 1))
    step = F.greatest(F.lit(1), F.floor((F.size(line) - 1) / (most - 1)))
    picked = F.filter(line, lambda p, i: i % step == 0)
    whole = F.when((F.size(line) - 1) % step == 0, picked).otherwise(F.concat(picked, F.slice(line, -1, 1)))
    return F.when(F.size(line) <= most, line).otherwise(F.slice(whole, 1, most))


def densify(line: Column, between: int = 6) -> Column:
    """``between`` places evenly put in each leg."""
    def leg(p, i):
        q = F.get(line, i + 1)
        inner = [F.array(p[0] + (q[0] - p[0]) * (t / (between + 1)), p[1] + (q[1] - p[1]) * (t / (between + 1))) for t in range(1, between + 1)]
        return F.when(i == F.size(line) - 1, F.array(p)).otherwise(F.array(p, *inner))

    return F.when(F.size(line) < 2, line).otherwise(F.flatten(F.transform(line, leg)))


def smooth(line: Column, alpha: float = 0.22, rounds: int = 2) -> Column:
    """Moves inner places towards the middle of their neighbours, ``rounds`` times."""
    out = line
    for _ in range(rounds):
        out = let(out, lambda c: _smoothed(c, alpha))
    return F.when(F.size(line) < 3, line).otherwise(out)


def _smoothed(line: Column, alpha: float) -> Column:
    def moved(p, i):
        a, b = F.get(line, i - 1), F.get(line, i + 1)
        x, y = (p[k] * (1 - alpha) + ((a[k] + b[k]) / 2.0) * alpha for k in (0, 1))
        return F.when((i == 0) | (i == F.size(line) - 1), p).otherwise(F.array(x, y))

    return F.transform(line, moved)


def trajectory_like(line: Column) -> Column:
    """A coarse line made to look like a drive: subsampled, densified, subsampled again and smoothed."""
    out = line
    for step in (lambda c: subsample(c, DISPLAY_CAP), densify, lambda c: subsample(c, 3 * DISPLAY_CAP), lambda c: smooth(c, 0.24)):
        out = let(out, step)
    return F.when(F.size(line) < 2, line).otherwise(out)


def simplify(line: Column) -> Column:
    """Drops places on the straight line from the last kept place to the next one."""
    def step(kept, i):
        a, b, c = F.element_at(kept, -1), F.get(line, i), F.get(line, i + 1)
        cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        return F.when(F.abs(cross) > 1e-12, F.concat(kept, F.array(b))).otherwise(kept)

    inner = F.sequence(F.lit(1), F.size(line) - 2)
    return F.when(F.size(line) <= 2, line).otherwise(F.concat(F.aggregate(inner, F.slice(line, 1, 1), step), F.slice(line, -1, 1)))
