"""Column expressions that give rows a reproducible order or bucket."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import col


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """Pseudo-random hexadecimal text of a row key: the same on every run and engine."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *parts))


def bucket_of(value: Column, bounds: Sequence[float], *, inclusive: bool = False) -> Column:
    """How many of the ascending bounds lie below `value` (or at it, if inclusive).

    Two short scans (over the last bound of each block, then inside the block
    found) instead of one over all bounds.
    """
    bounds = [float(b) for b in bounds]
    if not bounds:
        return F.lit(0)
    v = value.cast("double")

    def passed(listed: Column) -> Column:
        return F.size(F.filter(listed, lambda b: b <= v if inclusive else b < v))

    width = math.isqrt(len(bounds) - 1) + 1
    if len(bounds) <= 16:
        return passed(F.array(*map(F.lit, bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    full = passed(F.array(*[F.lit(block[-1]) for block in blocks]))
    nested = F.array(*[F.array(*map(F.lit, block)) for block in blocks])
    inside = passed(F.coalesce(F.get(nested, full), F.array().cast("array<double>")))
    return F.when(full == len(blocks), F.lit(len(bounds))).otherwise(full * width + inside)
