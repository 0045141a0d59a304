"""Running totals over a global order, computed in two levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import broadcast_if_small, col
from ..functions.ordering import bucket_of

BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 16_384


def range_bounds(df: DataFrame, order: str, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """Ascending values that cut `order` into ranges of about bucket_rows rows."""
    n = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(n / bucket_rows))
    if buckets <= 1:
        return []
    fractions = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(col(order).cast("double"), fractions, 10 * buckets)).first()[0]
    return sorted(set(got or []))


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    *,
    groups: Sequence[str] = (),
    descending: bool = False,
    suffix: str = "_upto",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add `<value><suffix>`: the sum of value over all rows up to this one.

    Rows must be unique on (groups, order); numeric `order`. Rows are cut into
    value ranges of bounded size; a window runs inside each range and the sums
    of the earlier ranges, one short row per range, are added on top. `df` is
    read several times: pass a written table, not a long plan.
    """
    groups = list(groups)

    def ordered(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    bounds = range_bounds(df, order, bucket_rows)
    placed = df.withColumn("_range", bucket_of(F.col(order), bounds))
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(ordered("_range")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *groups, "_range", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(ordered(order)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        placed.join(broadcast_if_small(offsets), [*groups, "_range"])
        .select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"_o_{v}")).alias(v + suffix) for v in values])
    )
