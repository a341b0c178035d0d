"""Schedules, seeded orders, decoded variants, timestamps, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int, key: Column) -> Column:
    """A reproducible order: the digest of seed and key. The same in any engine that has SHA-256."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def timestamp_text(seed: int, index: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1_785_000_000 + seed) + index), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def radix(value: Column, sizes: list[int]) -> list[Column]:
    """The digits of a number in a mixed radix, least first."""
    out, place = [], 1
    for n in sizes:
        out.append(F.pmod(F.floor(value / place), F.lit(n)).cast("long"))
        place *= n
    return out


def cosine_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up to the peak, then a half cosine down to the floor."""
    p = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    down = F.lit(floor) + F.lit(0.5 * (peak - floor)) * (1 + F.cos(F.pi() * p))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(down)


def capacity(tokens: Column, experts: int, factor: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(factor) * tokens / experts)).cast("long")


def relative_error(value: Column, target: Column) -> Column:
    return F.abs(value - target) / F.greatest(F.lit(1), target)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
