"""Natural (least squared deviation) breaks of numeric columns, exact on data of any size.

A partition of n sorted values into k classes is found without sorting or gathering the values. Rows are counted into
value bins (count, sum, sum of squares, extremes), and two arguments narrow the bins in which an optimal cut can lie:

* A cut inside a bin costs at least what the bins wholly between cuts cost. Where even that exceeds the best partition
  along bin borders, no optimal cut lies.
* In an optimal partition each cut halves the way between the means of its two classes. Moving all cuts up moves the
  means and the midpoints up, so lower bounds of all cuts give lower bounds again, and upper bounds likewise.

Only the remaining bins are counted anew, more finely, until each holds a single value. The second argument settles the
flat surroundings of an optimum, where very many cuts cost nearly the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import is_number
from eventrates.session import materialize

# Bins counted for a measure in one pass, and value ranges they are dealt to at most.
BINS = 1024
RANGES = 32
# Entries of a cost table held at once.
TABLE = 1 << 21
BREAKS_SCHEMA = "measure string, class int, lower double, upper double, n long"


@dataclass
class _Summary:
    """Bins of one measure in value order.

    Columns: count, centred sum, centred sum of squares, lowest value, highest value, and 1 while an optimal cut may lie
    in the bin or at its end. ``within`` holds the lowest and highest value next to which each cut can lie.
    """

    center: float
    classes: int
    bounds: tuple[float, float]
    bins: np.ndarray = field(default_factory=lambda: np.empty((0, 6)))
    within: np.ndarray | None = None
    # Value ranges to be counted anew, as (low, high, number of bins), both ends inclusive, in order.
    pending: list[tuple[float, float, int]] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)


def _count_bins(values: DataFrame, work: dict[str, _Summary]) -> dict[str, np.ndarray]:
    """One pass over (m, v, n) for the pending ranges of all measures; a bounded number of bins comes back.

    A value's range is found by halving the ranges' lower ends, one column a turn, in generated code; ranges are data.
    """

    def own(of: dict[str, list] | dict[str, float]) -> Column:
        """The measure's own array or number."""
        out = F.lit(None)
        for name, value in of.items():
            held = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
            out = F.when(F.col("m") == name, held).otherwise(out)
        return out

    def at(of: dict[str, list], place: Column) -> Column:
        out = F.lit(None)
        for name, value in of.items():
            out = F.when(F.col("m") == name, F.get(F.array(*[F.lit(v) for v in value]), place)).otherwise(out)
        return out

    lows = {c: [r[0] for r in s.pending] for c, s in work.items()}
    highs = {c: [r[1] for r in s.pending] for c, s in work.items()}
    parts = {c: [r[2] for r in s.pending] for c, s in work.items()}
    firsts = {c: np.concatenate([[0], np.cumsum(p)])[:-1].tolist() for c, p in parts.items()}
    asked = values.select("m", "v", "n").where(F.col("m").isin(list(work)))
    asked = asked.withColumn("d", F.col("v") - own({c: s.center for c, s in work.items()}))
    asked = asked.withColumn("at", F.lit(-1))
    step = 1 << max(0, max(map(len, lows.values())).bit_length() - 1)
    while step:
        further = F.coalesce(at(lows, F.col("at") + step) <= F.col("v"), F.lit(False))
        asked = asked.withColumn("at", F.when(further, F.col("at") + step).otherwise(F.col("at")))
        step >>= 1
    asked = asked.where(F.col("at") >= 0).select("*", *[at(x, F.col("at")).alias(c) for c, x in (("low", lows), ("high", highs), ("parts", parts), ("first", firsts))])
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts"))).otherwise(0)
    binned = asked.where(F.col("v") <= F.col("high")).withColumn("b", F.col("first") + F.least(place, F.col("parts") - 1))
    n = F.col("n")
    rows = (
        binned.groupBy("m", "b")
        .agg(F.sum(n), F.sum(n * F.col("d")), F.sum(n * F.col("d") * F.col("d")), F.min("v"), F.max("v"))
        .collect()
    )
    found: dict[str, list] = {name: [] for name in work}
    for row in rows:
        found[row[0]].append((*row[2:], 1.0))
    return {name: np.array(r, dtype=float).reshape(-1, 6) for name, r in found.items()}


class _Costs:
    """Squared deviations of runs of bins."""

    def __init__(self, bins: np.ndarray) -> None:
        self.count, self.total, self.square = (np.concatenate([[0.0], np.cumsum(bins[:, i])]) for i in range(3))

    def table(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Deviation of bins start..stop-1 for all starts (rows) and stops (columns); 0 where empty."""
        n = self.count[stops][None, :] - self.count[starts][:, None]
        s = self.total[stops][None, :] - self.total[starts][:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self.square[stops][None, :] - self.square[starts][:, None] - s * s / n
        return np.where((n > 0) & (stops[None, :] > starts[:, None]), np.maximum(spread, 0.0), 0.0)

    def runs(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Deviation of bins start..stop-1 for pairs of starts and later stops."""
        n = self.count[stops] - self.count[starts]
        s = self.total[stops] - self.total[starts]
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self.square[stops] - self.square[starts] - s * s / n
        return np.where(n > 0, np.maximum(spread, 0.0), 0.0)


def _blocks(m: int) -> list[slice]:
    """Slices of 0..m-1 whose tables against all m stay within a fixed size."""
    size = max(1, TABLE // m)
    return [slice(a, min(m, a + size)) for a in range(0, m, size)]


def _best_cuts(bins: np.ndarray, k: int) -> tuple[list[int], float]:
    """Best partition along bin borders and its deviation.

    The best last cut moves up with the end of the run, so the ends are solved by halves: the cut of a middle end bounds
    the cuts of those on either side. All middles of a depth are worked on together, k m log m costs in all.
    """
    m = len(bins)
    ends = np.arange(m + 1)
    costs = _Costs(bins)
    best = np.where(ends > 0, costs.table(ends[:1], ends)[0], np.inf)
    origin = []
    for _ in range(1, k):
        step, through = np.zeros(m + 1, dtype=np.int64), np.full(m + 1, np.inf)
        # Open stretches of ends, and the cuts that their middles may have.
        low, high = np.array([1]), np.array([m])
        first, last = np.array([0]), np.array([m - 1])
        while len(low):
            middle = (low + high) // 2
            stop = np.minimum(last, middle - 1)
            counts = np.maximum(stop - first + 1, 0)
            offsets = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(middle)), counts)
            cut = first[owner] + np.arange(counts.sum()) - offsets[owner]
            total = best[cut] + costs.runs(cut, middle[owner])
            used = np.flatnonzero(counts)
            least = np.minimum.reduceat(total, offsets[used])
            through[middle[used]] = least
            hit = np.flatnonzero(total == np.repeat(least, counts[used]))
            seen, where = np.unique(owner[hit], return_index=True)
            step[middle[seen]] = cut[hit[where]]
            chosen = np.where(np.isfinite(through[middle]), step[middle], first)
            # Ends too short for so many classes have no cut and bound nothing.
            some = np.isfinite(through[middle])
            left, right = low < middle, middle < high
            low, high, first, last = (
                np.concatenate([low[left], middle[right] + 1]),
                np.concatenate([middle[left] - 1, high[right]]),
                np.concatenate([first[left], np.where(some, chosen, first)[right]]),
                np.concatenate([np.where(some, chosen, last)[left], last[right]]),
            )
        origin.append(step)
        best = through
    cuts, stop = [], m
    for step in reversed(origin):
        stop = int(step[stop])
        cuts.append(stop)
    return cuts[::-1], float(best[m])


def _within_cost(bins: np.ndarray, k: int, deviation: float) -> np.ndarray:
    """For each of the k-1 cuts, the bins in or at the end of which it can lie without exceeding ``deviation``."""
    m = len(bins)
    single, closed = bins[:, 4] <= bins[:, 3], bins[:, 5] == 0
    at = np.arange(m)
    # A cut in bin b has b on its left if b is one value, and else counts b for neither class.
    stops = np.where(single, at + 1, at)
    costs = _Costs(bins)

    def between(rows: slice, columns: slice) -> np.ndarray:
        """Least cost of a class from a cut in one bin to a cut in another."""
        table = costs.table(at[rows] + 1, stops[columns])
        first, second = at[rows][:, None], at[columns][None, :]
        return np.where((first < second) | (first == second) & ~single[columns][None, :], table, np.inf)

    everything = slice(0, m)
    forward = [np.where(closed, np.inf, costs.table(at[:1], stops)[0])]
    backward = [np.where(closed, np.inf, costs.table(at + 1, np.array([m]))[:, 0])]
    for _ in range(1, k - 1):
        ahead, behind = np.empty(m), np.empty(m)
        for block in _blocks(m):
            ahead[block] = np.min(forward[-1][:, None] + between(everything, block), axis=0)
            behind[block] = np.min(between(block, everything) + backward[-1][None, :], axis=1)
        forward.append(np.where(closed, np.inf, ahead))
        backward.append(np.where(closed, np.inf, behind))
    rounding = 1e-11 * (bins[:, 2].sum() + 1e-300)
    return np.array([forward[i] + backward[k - 2 - i] <= deviation + rounding for i in range(k - 1)])


def _within_midpoints(bins: np.ndarray, lows: np.ndarray, highs: np.ndarray, center: float) -> tuple[np.ndarray, np.ndarray]:
    """Narrow the first and last bin of each cut until the midpoint argument gives nothing more."""
    count, total = (np.concatenate([[0.0], np.cumsum(bins[:, i])]) for i in range(2))
    lowest, highest = bins[:, 3], bins[:, 4]
    single = (highest <= lowest).astype(int)
    m = len(bins)

    def midpoints(borders: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Midpoints of the means of classes between borders; an empty class stands for the value in ``empty``."""
        edges = np.concatenate([[0], borders, [m]])
        n = count[edges[1:]] - count[edges[:-1]]
        mean = (total[edges[1:]] - total[edges[:-1]]) / np.where(n > 0, n, 1.0) + center
        mean = np.where(n > 0, mean, empty[np.minimum(edges[:-1], m - 1)] if empty is lowest else empty[np.maximum(edges[1:] - 1, 0)])
        return (mean[1:] + mean[:-1]) / 2

    scale = 1e-12 * (np.abs(lowest[0]) + np.abs(highest[-1]))
    while True:
        # A cut in bin b has at least the bins before b on its left, and b too if b is one value.
        least = midpoints(lows + single[lows], lowest)
        up = np.maximum(lows, np.searchsorted(highest, least - scale, "left") - 1)
        down = np.minimum(highs, np.searchsorted(lowest, midpoints(highs + 1, highest) + scale, "right") - 1)
        if (up == lows).all() and (down == highs).all():
            return lows, highs
        if (up > down).any():  # rounding: keep what was proven before
            return lows, highs
        lows, highs = up, down


def _refine(state: _Summary) -> bool:
    """Solve on the present bins and schedule those that may still hold an optimal cut; false when there are none."""
    bins, k = state.bins, state.classes
    state.cuts, deviation = _best_cuts(bins, k)
    open_bins = _within_cost(bins, k, deviation)
    at = np.arange(len(bins))
    if state.within is not None:
        for o, (low, high) in zip(open_bins, state.within):
            o &= (bins[:, 4] >= low) & (bins[:, 3] <= high)
    lows = np.array([o.argmax() for o in open_bins])
    highs = np.array([len(o) - 1 - o[::-1].argmax() for o in open_bins])
    lows, highs = _within_midpoints(bins, lows, highs, state.center)
    for o, low, high in zip(open_bins, lows, highs):
        o &= (at >= low) & (at <= high)
    state.within = np.stack([bins[lows, 3], bins[highs, 4]], axis=1)
    needed = open_bins.any(axis=0)
    wide = needed & (bins[:, 4] > bins[:, 3])
    if not wide.any():
        return False
    _schedule(state, needed, wide)
    return True


def _schedule(state: _Summary, needed: np.ndarray, wide: np.ndarray) -> None:
    """Count ``wide`` bins anew; merge the bins between ``needed`` ones.

    Neighbours share a range as long as each of them is still cut at least in two. Of more than ``RANGES`` ranges those
    with the most rows come first; the others wait as they are.
    """
    bins = state.bins
    share = max(2, BINS // int(wide.sum()))
    runs: list[list[int]] = []
    finest = np.inf
    for i in np.flatnonzero(wide):
        width = bins[i, 4] - bins[i, 3]
        if runs and runs[-1][1] == i - 1:
            size = i - runs[-1][0] + 1
            if (bins[i, 4] - bins[runs[-1][0], 3]) / (share * size) <= min(finest, width) / 2:
                runs[-1][1], finest = int(i), min(finest, width)
                continue
        runs.append([int(i), int(i)])
        finest = width
    runs = sorted(sorted(runs, key=lambda r: -bins[r[0] : r[1] + 1, 0].sum())[:RANGES])
    covered = np.zeros(len(bins), dtype=bool)
    state.pending = []
    for a, b in runs:
        covered[a : b + 1] = True
        state.pending.append((float(bins[a, 3]), float(bins[b, 4]), share * (b - a + 1)))
    kept, run = [], None
    for i, row in enumerate(bins):
        if covered[i]:
            run = None
        elif needed[i] or run is None:
            kept.append(np.append(row[:5], float(needed[i])))
            run = None if needed[i] else kept[-1]
        else:
            run[:3] += row[:3]
            run[4] = row[4]
    state.bins = np.array(kept).reshape(-1, 6)


def natural_breaks(df: DataFrame, columns: Sequence[str], k: int | dict[str, int] = 5) -> DataFrame:
    """Classes of each column with least total squared deviation from class means.

    Returns one row per measure and class with its lowest and highest value and row count. All measures advance
    together, so a pass over the data serves every one of them. Missing, NaN and infinite values are left out; a column
    with no more distinct values than classes gets one class per value. After the first pass the values still in question
    are stored as counts of distinct values, and later passes read nothing else.
    """
    wanted = {c: k[c] if isinstance(k, dict) else k for c in columns}

    def value(c: str) -> Column:
        number = F.col(c).cast("double")
        return F.when(is_number(c) & (F.abs(number) < float("inf")), number)

    parts = [F.struct(F.lit(c).alias("m"), value(c).alias("v")) for c in columns]
    values = df.select(F.inline(F.array(*parts))).where(F.col("v").isNotNull()).withColumn("n", F.lit(1).cast("long"))
    edges = values.groupBy("m").agg(F.min("v"), F.max("v"), F.avg("v")).collect()
    states = {r[0]: _Summary(r[3], wanted[r[0]], (r[1], r[2]), pending=[(r[1], r[2], BINS)]) for r in edges}
    stored = False
    work = dict(states)
    while work:
        for c, fresh in _count_bins(values, work).items():
            state = work[c]
            merged = np.vstack([state.bins, fresh])
            state.bins = merged[np.argsort(merged[:, 3], kind="stable")]
            several = state.bins[:, 4] > state.bins[:, 3]
            if state.classes == 1 or len(state.bins) <= state.classes and not several.any():
                state.cuts = list(range(1, len(state.bins))) if state.classes > 1 else []
                state.pending = []
            elif len(state.bins) <= state.classes:
                # Too few bins to choose from: count every bin that holds several values anew.
                _schedule(state, np.ones_like(several), several)
            elif not _refine(state):
                state.pending = []
        work = {c: s for c, s in work.items() if s.pending}
        if work and not stored:
            # One range for each cut of a measure.
            asked = [
                (F.col("m") == c) & F.col("v").between(float(low), float(high))
                for c, s in work.items()
                for low, high in ([(s.bounds[0], s.bounds[1])] if s.within is None else s.within)
            ]
            left = values.where(reduce(lambda a, b: a | b, asked))
            values, stored = materialize(left.groupBy("m", "v").agg(F.sum("n").alias("n"))), True

    rows = []
    for c in columns:
        if c not in states:
            continue
        state = states[c]
        borders = [0, *state.cuts, len(state.bins)]
        for i, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            part = state.bins[a:b]
            rows.append((c, i, float(part[0, 3]), float(part[-1, 4]), int(part[:, 0].sum())))
    return df.sparkSession.createDataFrame(rows, BREAKS_SCHEMA)
