"""Exact quantiles (linear interpolation) in three aggregates, none of which moves the data.

A mergeable sketch proposes values around each wanted position. One aggregate then counts, for
every column at once, the rows below and up to each of them: a wanted rank that falls on a proposed value is
settled; any other lies between two of them. What lies there, a few rows in ten thousand, is counted
by value. Where even that is more than SETTLE_ROWS, the sketch is drawn again inside the gaps.
The driver sees proposed values and counts. The result does not depend on the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..core import chunks, col

#: The sketch is right to one row in so many.
ACCURACY = 10_000
#: Values are proposed at each wanted position and at these multiples of the sketch's error from it.
STEPS = (-2.0, 0.0, 2.0)
#: Gaps with more rows than this in all are narrowed before their values are counted.
SETTLE_ROWS = 1_000_000
#: Aggregates of one job: columns are searched together up to this many.
PER_JOB = 400
COLUMNS_PER_PASS = 20


@dataclass(frozen=True)
class _Span:
    """Open interval of one column (None: no end on that side); `below` rows lie
    to its left, `inside` in it."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self) -> Column:
        v = col(self.column).cast("double")
        inside = v.isNotNull()
        if self.low is not None:
            inside = inside & (v > F.lit(self.low))
        if self.high is not None:
            inside = inside & (v < F.lit(self.high))
        return inside


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    rows: int | None = None,
    settle_rows: int = SETTLE_ROWS,
    sample_rows: int = ACCURACY,
    beside: Callable[[Sequence[str]], list[Column]] | None = None,
    found: list[tuple[Sequence[str], Row]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles per column as fitted constants; [None, ...] for an all-null column.

    sample_rows is the accuracy of the sketch. beside gives further aggregates over some
    columns, which the first pass computes too; their rows are put into found.
    """
    out: dict[str, list[float | None]] = {}
    cols = list(dict.fromkeys(cols))
    width = max(1, min(COLUMNS_PER_PASS, PER_JOB // max(1, 2 * len(STEPS) * len(probs))))
    for part in chunks(cols, width):
        out.update(_search(df, list(part), list(probs), settle_rows, sample_rows, beside, found))
    return out


def _search(df, cols, probs, settle_rows, accuracy, beside, found):
    more = [] if beside is None else beside(cols)
    spans = [_Span(c, None, None, 0, 0) for c in cols]
    row = df.agg(*_sketches(spans, [probs] * len(cols), accuracy), *[F.count(col(c)).alias(f"_n{i}") for i, c in enumerate(cols)], *more).first()
    if found is not None:
        found.append((cols, row))
    filled = {c: row[f"_n{i}"] for i, c in enumerate(cols)}
    spans = [_Span(c, None, None, 0, filled[c]) for c in cols]
    points = _proposed(row, len(spans))
    wanted = {
        (c, rank)
        for c in cols
        if filled[c]
        for p in probs
        for rank in (math.floor((filled[c] - 1) * p), math.ceil((filled[c] - 1) * p))
    }
    values: dict[tuple[str, int], float] = {}
    open_ = _locate(spans, _count_between(df, spans, points), points, wanted, values)
    while open_ and sum(s.inside for s in open_) > settle_rows:
        spans = sorted(open_, key=lambda s: (s.column, s.below))
        left = {w for w in wanted if w not in values}
        at = [[(rank - s.below + 0.5) / s.inside for c, rank in left if c == s.column and s.below <= rank < s.below + s.inside] for s in spans]
        points = _proposed(df.where(_any_holds(spans)).agg(*_sketches(spans, at, accuracy)).first(), len(spans))
        open_ = _locate(spans, _count_between(df, spans, points), points, left, values)
    if open_:
        _settle(df, sorted(open_, key=lambda s: (s.column, s.below)), {w for w in wanted if w not in values}, values)

    def at(c: str, p: float) -> float | None:
        if not filled[c]:
            return None
        position = (filled[c] - 1) * p
        a, b = math.floor(position), math.ceil(position)
        low, high = values[(c, a)], values[(c, b)]
        return low if low == high else (b - position) * low + (position - a) * high

    return {c: [at(c, p) for p in probs] for c in cols}


def _sketches(spans: Sequence[_Span], at: Sequence[Sequence[float]], accuracy: int) -> list[Column]:
    """Values of each span near the wanted fractions of it."""
    out = []
    for i, s in enumerate(spans):
        fractions = sorted({min(1.0, max(0.0, p + step / accuracy)) for p in at[i] for step in STEPS}) or [0.5]
        v = col(s.column).cast("double")
        own = v if s.low is None and s.high is None else F.when(s.holds(), v)
        out.append(F.percentile_approx(own, fractions, accuracy).alias(f"_q{i}"))
    return out


def _proposed(row: Row, n: int) -> list[np.ndarray]:
    return [np.unique(np.array(row[f"_q{i}"] or [], float)) for i in range(n)]


def _any_holds(spans: Sequence[_Span]) -> Column:
    """Rows with a value between the outer ends of some column's spans (reaches the scan)."""
    keep = None
    for c in dict.fromkeys(s.column for s in spans):
        own = [s for s in spans if s.column == c]
        lows, highs = [s.low for s in own], [s.high for s in own]
        hull = _Span(c, None if None in lows else min(lows), None if None in highs else max(highs), 0, 0).holds()
        keep = hull if keep is None else keep | hull
    return keep


def _count_between(df: DataFrame, spans: Sequence[_Span], points: list[np.ndarray]) -> list[np.ndarray]:
    """Rows per bin of each span: bin 2i+1 is point i itself, bin 2i the gap before it."""
    aggs = []
    for i, (s, p) in enumerate(zip(spans, points)):
        v = col(s.column).cast("double")
        for j, x in enumerate(p.tolist()):
            aggs += [F.count_if(v < F.lit(x)).alias(f"l{i}_{j}"), F.count_if(v <= F.lit(x)).alias(f"u{i}_{j}")]
    row = df.agg(*aggs).first() if aggs else None
    counts = []
    for i, (s, p) in enumerate(zip(spans, points)):
        upto = [s.below, *(row[f"{k}{i}_{j}"] for j in range(len(p)) for k in "lu"), s.below + s.inside]
        counts.append(np.diff(np.array(upto, np.int64)))
    return counts


def _locate(spans, counts, points, wanted, values) -> set[_Span]:
    """Settle ranks that fall on a point; return the open intervals of the others."""
    open_: set[_Span] = set()
    for i, s in enumerate(spans):
        ends = s.below + np.cumsum(counts[i])
        for c, rank in wanted:
            if c != s.column or not (s.below <= rank < ends[-1]):
                continue
            b = int(np.searchsorted(ends, rank, side="right"))
            if b % 2:
                values[(c, rank)] = float(points[i][b // 2])
                continue
            low = points[i][b // 2 - 1] if b else s.low
            high = points[i][b // 2] if b // 2 < len(points[i]) else s.high
            low, high = (None if x is None else float(x) for x in (low, high))
            open_.add(_Span(c, low, high, int(ends[b] - counts[i][b]), int(counts[i][b])))
    return open_


def _settle(df: DataFrame, spans, wanted, values) -> None:
    """Few rows left: count them by value and read the ranks off a running sum."""
    ranks = [
        sorted(rank for c, rank in wanted if c == s.column and s.below <= rank < s.below + s.inside) for s in spans
    ]
    names = list(dict.fromkeys(s.column for s in spans))
    parts = []
    for c in names:  # the spans of a column do not overlap
        place = F.lit(None).cast("int")
        for i, s in enumerate(spans):
            if s.column == c:
                place = F.when(s.holds(), F.lit(i)).otherwise(place)
        parts.append(F.struct(place.alias("span"), col(c).cast("double").alias("v")))
    inside = df.where(_any_holds(spans)).select(F.inline(F.filter(F.array(*parts), lambda x: x["span"].isNotNull())))
    nth = F.array(*[F.array(*[F.lit(r - s.below).cast("long") for r in rs]) for s, rs in zip(spans, ranks)])
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v"))
    found = (
        inside.groupBy("span", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("span", "v", "n", upto.alias("upto"))
        .where(F.exists(F.get(nth, F.col("span")), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
        .collect()
    )
    for row in found:
        span = spans[row["span"]]
        for rank in ranks[row["span"]]:
            if row["upto"] - row["n"] <= rank - span.below < row["upto"]:
                values[(span.column, rank)] = row["v"]
