"""Exact quantiles without a buffer of the values: selection by counts in intervals that narrow around each rank.

A pass estimates the quantiles just below and above each rank among the values in its interval, the next one counts what lies before,
at and behind these two values. The counts are exact, so they say in which part the rank lies: at one of the two values, and the answer
is known, however often it repeats, or strictly between, and the interval has shrunk to the error of the estimate, a 500th. An
interval of at most FEW values is sorted. A task's memory is that of its estimates, for any number of values. A million take three scans,
a billion five."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.expressions import col, numeric

#: Accuracy of the estimates, and the number of values that are sorted in one buffer.
ACCURACY, FEW = 2_000, 10_000


@dataclass
class _Rank:
    """A place in the order of a column's values, and the interval in which its value lies. Ends belong to it where closed."""

    place: int
    low: float
    high: float
    before: int
    inside: int
    low_closed: bool = True
    high_closed: bool = True
    value: float | None = None

    def within(self, x: Column) -> Column:
        return (x >= self.low if self.low_closed else x > self.low) & (x <= self.high if self.high_closed else x < self.high)

    def narrow(self, low: float, high: float, lt_low: int, le_low: int, lt_high: int, le_high: int) -> None:
        """low and high are values inside; the counts are of all values of the column less than, or not above, each."""
        if lt_low <= self.place < le_low:
            self.value = low
        elif lt_high <= self.place < le_high:
            self.value = high
        elif self.place < lt_low:
            self.high, self.high_closed, self.inside = low, False, lt_low - self.before
        elif self.place < lt_high:
            self.low, self.low_closed, self.high, self.high_closed, self.before, self.inside = low, False, high, False, le_low, lt_high - le_low
        else:
            self.inside -= le_high - self.before
            self.low, self.low_closed, self.before = high, False, le_high


    @property
    def interval(self) -> tuple:
        return self.low, self.high, self.low_closed, self.high_closed


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float], together: int = 8) -> dict[str, list[float | None]]:
    """For each numeric column its quantiles at these points, interpolated between neighbours as `percentile` does; nulls and NaN are left out, a column without values has None. So many columns share the scans of a pass."""
    out: dict[str, list[float | None]] = {}
    for i in range(0, len(columns), together):
        out |= _quantiles(df, columns[i : i + together], points)
    return out


def _asked(df: DataFrame, aggs: list[Column]) -> list:
    return list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())


def _estimate(x: Column, shares: list[float]) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(min(1.0, max(0.0, s))) for s in shares]), F.lit(ACCURACY))


def _quantiles(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float | None]]:
    # The values once, as many counts are taken of each.
    df = df.select(*[numeric(col(c), df.schema[c].dataType).alias(f"x{i}") for i, c in enumerate(columns)])
    x = {c: F.col(f"x{i}") for i, c in enumerate(columns)}
    step = 2.0 / ACCURACY
    # The first estimates are over all values, before their number is known.
    first = [p + d for p in points for d in (-step, step)]
    seen = _asked(df, [a for c in columns for a in (F.count(x[c]), F.min(x[c]), F.max(x[c]), _estimate(x[c], first))])
    ranks: dict[str, list[_Rank]] = {}
    sizes, guesses = {}, {}
    for i, c in enumerate(columns):
        n, low, high, near = seen[4 * i : 4 * i + 4]
        sizes[c] = n
        places = {f(p * (n - 1)): k for k, p in enumerate(points) for f in (math.floor, math.ceil)} if n else {}
        ranks[c] = [_Rank(k, low, high, 0, n, value=low if low == high else None) for k in sorted(places)]
        guesses |= {(c, r.place): (near[2 * places[r.place]], near[2 * places[r.place] + 1]) for r in ranks[c] if r.value is None}
    while wide := [(c, r) for c in columns for r in ranks[c] if r.value is None and r.inside > FEW]:
        if not all((c, r.place) in guesses for c, r in wide):
            groups: dict[tuple, list[_Rank]] = {}
            for c, r in wide:
                groups.setdefault((c, r.interval), []).append(r)
            shares = {k: [(r.place - r.before + 0.5) / r.inside + d for r in rs for d in (-step, step)] for k, rs in groups.items()}
            near = _asked(df, [_estimate(F.when(rs[0].within(x[k[0]]), x[k[0]]), shares[k]) for k, rs in groups.items()])
            guesses = {(k[0], r.place): (v[2 * i], v[2 * i + 1]) for (k, rs), v in zip(groups.items(), near) for i, r in enumerate(rs)}
        marks = sorted({(c, v) for c, r in wide for v in guesses[c, r.place]})
        counts = _asked(df, [F.count_if(t) for c, v in marks for t in (x[c] < v, x[c] <= v)])
        below = {m: (counts[2 * i], counts[2 * i + 1]) for i, m in enumerate(marks)}
        for c, r in wide:
            low, high = guesses[c, r.place]
            r.narrow(low, high, *below[c, low], *below[c, high])
        guesses = {}
    left = [(c, r) for c in columns for r in ranks[c] if r.value is None]
    if left:
        groups = {}
        for c, r in left:
            groups.setdefault((c, r.interval), []).append(r)
        found = _asked(df, [F.sort_array(F.collect_list(F.when(rs[0].within(x[c]), x[c]))) for (c, _), rs in groups.items()])
        for rs, values in zip(groups.values(), found):
            for r in rs:
                r.value = values[r.place - r.before]

    def at(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        place, of = p * (sizes[c] - 1), {r.place: r.value for r in ranks[c]}
        a, b = math.floor(place), math.ceil(place)
        return of[a] if a == b or of[a] == of[b] else (b - place) * of[a] + (place - a) * of[b]

    return {c: [at(c, p) for p in points] for c in columns}
