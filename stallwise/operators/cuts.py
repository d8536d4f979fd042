"""Exact order statistics without sorting or moving the table.

A global NTILE or percentile in Spark puts all rows (or all distinct values) in one task.
Here the rows stay where they are. Per sort column, a small sample proposes pivots, one
aggregate counts the rows between and on the pivots, and only the zones that hold a wanted
rank are looked at again, until few enough rows are left to read. Rows equal to a pivot form a
zone of their own, so one value may hold any share of the table; the next sort column is only
needed inside such a group of equals.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLECT_ROWS = 50_000
SAMPLE_ROWS = 8_000


@dataclass(frozen=True)
class Cut:
    """Key at one rank: ``below`` rows sort before it, ``equal`` rows share it."""

    key: tuple
    below: int
    equal: int


@dataclass
class _Zone:
    """Open interval of values known to contain the wanted ranks."""

    low: object | None
    high: object | None
    below: int
    rows: int
    ranks: list[int] = field(default_factory=list)

    def contains(self, value) -> bool:
        return (self.low is None or value > self.low) and (self.high is None or value < self.high)

    def test(self, column: Column) -> Column:
        inside = column.isNotNull()
        if self.low is not None:
            inside = inside & (column > F.lit(self.low))
        if self.high is not None:
            inside = inside & (column < F.lit(self.high))
        return inside


class SortKey:
    """Comparisons of ascending, NULLS LAST columns with a key found by :func:`cut_points`.

    A NULL column makes a test NULL, which WHEN takes as "not before" and "not equal": the row
    sorts after the key, as it should.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = [F.col(c) for c in columns]

    def before(self, key: tuple) -> Column:
        test = F.lit(False)
        for column, value in reversed(list(zip(self.columns, key))):
            if value is None:
                test = column.isNotNull() | test
            else:
                test = (column < F.lit(value)) | ((column == F.lit(value)) & test)
        return test

    def equals(self, key: tuple) -> Column:
        return _all([c.isNull() if v is None else c == F.lit(v) for c, v in zip(self.columns, key)])

    def up_to(self, key: tuple) -> Column:
        return self.before(key) | self.equals(key)

    def zone_number(self, keys: list[tuple]) -> Column:
        """2 * (keys before the row), plus 1 when the row is a key itself; ``keys`` ascend."""

        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(2 * lo)
            mid = (lo + hi) // 2
            return (
                F.when(self.before(keys[mid]), search(lo, mid))
                .when(self.equals(keys[mid]), F.lit(2 * mid + 1))
                .otherwise(search(mid + 1, hi))
            )

        return search(0, len(keys))


def _all(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result & test
    return result


def _any(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def key_order(key: tuple) -> tuple:
    """Python sort key of a cut key: NaN after all numbers, NULLs last, as Spark compares them."""
    return tuple((v is None, v != v, 0 if v != v else v) for v in key)


def cut_points(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Sequence[int],
    rows: int | None = None,
    collect_rows: int = COLLECT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    complete: frozenset[str] = frozenset(),
) -> dict[int, Cut]:
    """Keys found at the given 1-based ranks when ``df`` is sorted by ``columns`` ascending.

    ``df`` is read several times, so pass a written table. The driver only ever sees the
    samples and at most ``collect_rows`` keys per zone, whatever the size of ``df``.
    ``complete`` names columns already known to have no NULLs.
    """
    total = df.count() if rows is None else rows
    wanted = sorted({r for r in ranks if 1 <= r <= total})
    if not wanted:
        return {}
    if total <= collect_rows:
        return _resolve(wanted, _read_keys(df, columns), 0)

    name, others = columns[0], list(columns[1:])
    column = F.col(name)
    filled = total
    if name not in complete:
        counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
        filled = counts[name]
        complete = complete | {c for c, n in counts.items() if n == total}
    found = _cut_column(df, name, [r for r in wanted if r <= filled], filled, collect_rows, sample_rows)
    found |= {r: Cut((None,), filled, total - filled) for r in wanted if r > filled}
    if not others:
        return found

    # ranks that share a value of this column are told apart by the remaining columns
    groups: dict[object, list[int]] = {}
    for rank in wanted:
        groups.setdefault(found[rank].key[0], []).append(rank)
    full: dict[int, Cut] = {}
    read: list[object] = []
    for value, members in groups.items():
        cut = found[members[0]]
        if cut.equal <= collect_rows:
            read.append(value)
            continue
        same, places = df.where(_is(column, value)), [r - cut.below for r in members]
        inner = cut_points(same, others, places, cut.equal, collect_rows, sample_rows, complete)
        for rank, c in inner.items():
            full[rank + cut.below] = Cut((value, *c.key), c.below + cut.below, c.equal)
    if read:
        counted = _read_keys(df.where(_any([_is(column, v) for v in read])), columns)
        for value in read:
            members = groups[value]
            same = [pair for pair in counted if pair[0][0] == value]
            full |= _resolve(members, same, found[members[0]].below)
    return full


def _is(column: Column, value) -> Column:
    return column.isNull() if value is None else column == F.lit(value)


def _read_keys(df: DataFrame, columns: Sequence[str]) -> list[tuple[tuple, int]]:
    """Distinct keys with their row counts, in order; for a bounded number of rows."""
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n")).collect()
    return sorted(((tuple(r)[:-1], r["_n"]) for r in counted), key=lambda pair: key_order(pair[0]))


def _resolve(ranks: Sequence[int], counted: list[tuple[tuple, int]], below: int) -> dict[int, Cut]:
    found = {}
    waiting = list(ranks)
    for key, n in counted:
        while waiting and waiting[0] <= below + n:
            found[waiting.pop(0)] = Cut(key, below, n)
        below += n
    return found


def _cut_column(
    df: DataFrame, name: str, ranks: list[int], filled: int, collect_rows: int, sample_rows: int
) -> dict[int, Cut]:
    """Values of one column at the given ranks among its ``filled`` non-null values."""
    column = F.col(name)
    found: dict[int, Cut] = {}
    zones = [_Zone(None, None, 0, filled, ranks)] if ranks else []
    while zones:
        small = [z for z in zones if z.rows <= collect_rows]
        large = [z for z in zones if z.rows > collect_rows]
        if small:
            counted = _read_keys(df.where(_any([z.test(column) for z in small])), [name])
            for zone in small:
                found |= _resolve(zone.ranks, [p for p in counted if zone.contains(p[0][0])], zone.below)
        if not large:
            break
        active = df.where(_any([z.test(column) for z in large])).select(name)
        share = min(1.0, sample_rows * len(large) / sum(z.rows for z in large))
        drawn = sorted(r[0] for r in active.sample(share, seed=17).collect())
        pivots: set = set()
        for zone in large:
            sample = [v for v in drawn if zone.contains(v)]
            if sample:
                pivots |= _propose(zone, sample)
        if not pivots:
            sample_rows *= 4
            zones = large
            continue
        bounds = {z.low for z in large} | {z.high for z in large}
        edges = sorted(pivots | (bounds - {None}))
        zone_number = SortKey([name]).zone_number([(e,) for e in edges])
        sizes = active.groupBy(zone_number.alias("zone")).agg(F.count("*").alias("n")).collect()
        counts = {r["zone"]: r["n"] for r in sizes}
        zones = [inner for zone in large for inner in _narrow(zone, edges, counts, found)]
    return found


def _propose(zone: _Zone, sample: list) -> set:
    """Two sample values that bracket each wanted rank with high probability."""
    size = len(sample)
    margin = int(2 * math.sqrt(size)) + 1
    pivots = set()
    for rank in zone.ranks:
        position = int((rank - zone.below) / max(zone.rows, 1) * size)
        pivots.add(sample[max(0, min(size - 1, position - margin))])
        pivots.add(sample[max(0, min(size - 1, position + margin))])
    return pivots


def _narrow(zone: _Zone, edges: list, counts: dict[int, int], found: dict[int, Cut]) -> list[_Zone]:
    """Place the ranks of ``zone`` into the counted sub-zones between and on its edges."""
    first = 0 if zone.low is None else bisect_left(edges, zone.low) + 1
    last = len(edges) if zone.high is None else bisect_left(edges, zone.high)
    below = zone.below
    waiting = list(zone.ranks)
    result = []
    for i in range(first, last + 1):
        n = counts.get(2 * i, 0)
        inner = [r for r in waiting if r <= below + n]
        if inner:
            low = edges[i - 1] if i > 0 else None
            high = edges[i] if i < len(edges) else None
            result.append(_Zone(low, high, below, n, inner))
            waiting = waiting[len(inner) :]
        below += n
        if i < last:
            n = counts.get(2 * i + 1, 0)
            while waiting and waiting[0] <= below + n:
                found[waiting.pop(0)] = Cut((edges[i],), below, n)
            below += n
    return result


def tile_starts(rows: int, tiles: int) -> list[int]:
    """1-based rank of the first row of tiles 2..n; the first ``rows % tiles`` tiles get one more."""
    size, extra = divmod(rows, tiles)
    return [1 + t * size + min(t, extra) for t in range(1, tiles)]


def with_ntile(df: DataFrame, columns: Sequence[str], tiles: int, name: str, **limits) -> DataFrame:
    """NTILE over a total order of ``columns`` (the last one must be unique), as a narrow column."""
    rows = df.count()
    starts = tile_starts(rows, tiles)
    cuts = cut_points(df, columns, starts, rows=rows, **limits)
    key = SortKey(columns)
    tile: Column = F.lit(1)
    for start in starts:
        if start in cuts:
            tile = tile + F.when(key.before(cuts[start].key), F.lit(0)).otherwise(F.lit(1))
    return df.withColumn(name, tile)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], **limits) -> list[float | None]:
    """Exact quantiles with linear interpolation; NULLs and NaN are left out. All None when nothing is left."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = values.count()
    if rows == 0:
        return [None] * len(probabilities)
    spots = [(rows - 1) * p for p in probabilities]
    ranks = {math.floor(s) + 1 for s in spots} | {math.ceil(s) + 1 for s in spots}
    cuts = cut_points(values, ["v"], sorted(ranks), rows=rows, **limits)
    result = []
    for spot in spots:
        low, high = cuts[math.floor(spot) + 1].key[0], cuts[math.ceil(spot) + 1].key[0]
        result.append(low + (high - low) * (spot - math.floor(spot)))
    return result
