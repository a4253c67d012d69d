"""Implausible values: robust seasonal-trend decomposition per source with generalised ESD limits, runs and ranges."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.lookup import BROADCAST_BYTES, lookup_join
from touchline.session import ship, written

#: A source with more readings than this is spread over blocks of successive readings, of about BLOCK_ROWS each; its
#: statistics are those of the whole source all the same.
HOT_ROWS = 8192
BLOCK_ROWS = 4096
#: Widths of the bins in which medians are taken: of logarithms, of deviations, and of changes in a measure's units.
#: Counts of bins add up over blocks, so a source's medians don't depend on how it is cut.
LOG_BIN, DEVIATION_BIN, CHANGE_BIN = 0.002, 0.02, 0.25
#: Deviations below this are far from any ESD limit and aren't counted.
LEAST_DEVIATION = 2.0
#: Spikes in a row beyond which the ends of the row are too far off to tell whether it is abrupt.
LONGEST_ROW = 24


@dataclass(frozen=True)
class Measure:
    """What is known of a field before looking at a source.

    per_time: the value grows with the time since the previous reading and is judged as a rate.
    highest: limit of what is physically possible, of the rate if per_time; for a rate, `slack` is added to the limit.
    unit: smallest step in which the field is recorded.
    noise: usual spread of the log residuals, the prior for sources with few readings.
    jump: least log ratio to the trend that counts as a spike, however quiet the source.
    """

    name: str
    highest: float
    unit: float
    noise: float
    jump: float
    per_time: bool = False
    slack: float = 0.0


#: Speeds in km/h, accelerations in m/s2, distances in m since the previous reading, per frame of 1/25 s.
MOVEMENT = (
    Measure("speed_kmh", 60.0, 0.01, 0.06, 0.4),
    Measure("acceleration", 40.0, 0.001, 0.3, 1.2),
    Measure("distance_meters", 0.7, 0.001, 0.18, 1.0, per_time=True, slack=6.0),
)


@dataclass(frozen=True)
class Limits:
    window: int = 11  # readings of the running median that gives the trend
    reach: int = 150  # time units beyond which a neighbour says nothing about the trend
    period: int = 1500  # time units of a season
    phases: int = 12
    least_per_phase: int = 12
    share: float = 0.3  # most outliers of a source that the test looks for
    alpha: float = 1e-3
    abrupt: float = 1.0  # share of a measure's jump that must come in one step on either side of a spike
    prior_weight: float = 20.0
    stuck_alpha: float = 1e-3
    stuck_least: int = 6
    stuck_units: float = 2.0  # successive readings this many units apart count as the same


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Upper quantiles of the normal distribution, p in (0, 0.5]: rational approximation, then one Newton step."""
    from math import pi

    t = np.sqrt(-2 * np.log(p))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t**2) / (1 + 1.432788 * t + 0.189269 * t**2 + 0.001308 * t**3)
    # tail by the continued fraction, exact enough beyond 1
    k = x.copy()
    for i in range(40, 0, -1):
        k = x + i / k
    tail = np.exp(-x * x / 2) / np.sqrt(2 * pi) / k
    return np.where(x > 1, x + (tail - p) / np.maximum(np.exp(-x * x / 2) / np.sqrt(2 * pi), 1e-300), x)


def _esd_limit(n: np.ndarray, i: np.ndarray, alpha: float) -> np.ndarray:
    """Critical value of the i-th largest deviation of n, from Student's t with n - i - 1 degrees of freedom."""
    dof = np.maximum(n - i - 1, 3).astype(float)
    z = _normal_quantile(alpha / (2 * np.maximum(n - i + 1, 1)))
    t = z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof**2)
    return t * np.maximum(n - i, 1) / np.sqrt((dof + t * t) * (dof + 2))


def _group_median(values: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and size of each group; groups are numbers below n_groups."""
    order = np.lexsort((values, group))
    sizes = np.bincount(group, minlength=n_groups)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    s = values[order]
    if not len(s):
        return np.full(n_groups, np.nan), sizes
    lo = np.minimum(starts + np.maximum(sizes - 1, 0) // 2, len(s) - 1)
    hi = np.minimum(starts + sizes // 2, len(s) - 1)
    return np.where(sizes > 0, (s[lo] + s[hi]) / 2, np.nan), sizes


def _trend(values: np.ndarray, group: np.ndarray, time: np.ndarray, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Running median over neighbours of the same source within reach, and the number of neighbours."""
    half, n = lim.window // 2, len(values)
    table = np.full((n, lim.window), np.nan)
    for k in range(-half, half + 1):
        a, b = max(0, -k), n - max(0, k)
        if a >= b:
            continue
        near = (group[a:b] == group[a + k : b + k]) & (np.abs(time[a:b] - time[a + k : b + k]) <= lim.reach)
        table[a:b, k + half] = np.where(near, values[a + k : b + k], np.nan)
    table.sort(axis=1)
    count = (~np.isnan(table)).sum(axis=1)
    at = np.arange(n)
    return (table[at, (count - 1) // 2] + table[at, count // 2]) / 2 if n else values, count - 1


def _abrupt(spike: np.ndarray, source: np.ndarray, time: np.ndarray, x: np.ndarray, least: float, reach: int) -> np.ndarray:
    """Spikes whose run of successive spikes rises or falls by `least` in one step; a sprint is built up instead.

    A run that has no neighbour within reach on either side counts as abrupt. Of a longer run, a spike sees only ends
    within LONGEST_ROW readings.
    """
    if not spike.any():
        return spike
    at = np.flatnonzero(spike)
    new = np.concatenate([[True], (np.diff(at) > 1) | (source[at[1:]] != source[at[:-1]])])
    run = np.cumsum(new) - 1
    first, last = at[new], at[np.concatenate([new[1:], [True]])]

    def step(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        there = (outer >= 0) & (outer < len(x))
        o = np.clip(outer, 0, len(x) - 1)
        there &= (source[o] == source[inner]) & (np.abs(time[o] - time[inner]) <= reach)
        return np.where(there, x[inner] - x[o], np.nan)

    steps = np.vstack([step(first, first - 1), step(last, last + 1)])
    sharp = np.nan_to_num(steps, nan=-np.inf) >= least
    near = np.vstack([at - first[run], last[run] - at]) < LONGEST_ROW
    out = np.zeros(len(spike), dtype=bool)
    out[at] = (sharp[:, run] & near).any(axis=0) | (np.isnan(steps[:, run]) & near).all(axis=0)
    return out


def _steps(source: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Time since the source's previous reading, at least 1; infinite for its first."""
    first = np.concatenate([[True], source[1:] != source[:-1]])
    return np.where(first, np.inf, np.maximum(np.diff(time, prepend=time[:1]), 1))


def _near(m: Measure, a: np.ndarray, b: np.ndarray, lim: Limits) -> np.ndarray:
    """Whether successive values count as the same."""
    return np.abs(a - b) <= m.unit * (lim.stuck_units + 0.1)


#: Statistics of a source and measure, in the order in which they are found: numbers of the columns of `Statistics`.
LEVEL, CHANGE, SPREAD, CENTRE, WIDE, MAD, LIMIT, PHASE = range(8)
#: Which of them a round finds; each round needs those before it.
ROUNDS = ((LEVEL, CHANGE), (SPREAD, PHASE), (CENTRE, WIDE), (MAD,), (LIMIT,))


class Statistics:
    """Medians, in bins, and counts of each of some sources, by statistic; the season has one column per phase."""

    def __init__(self, n_sources: int, lim: Limits):
        self.bins, self.counts = np.full((n_sources, PHASE + lim.phases), np.nan), np.zeros((n_sources, PHASE + lim.phases), dtype=np.int64)

    def value(self, what: int, width: float) -> np.ndarray:
        return (self.bins[:, what] + 0.5) * width

    def set(self, which: tuple[int, ...], source: np.ndarray, what: np.ndarray, bin_: np.ndarray, count: np.ndarray, lim: Limits) -> None:
        """From counts of bins, of which each (source, what, bin) may occur more than once."""
        width = self.bins.shape[1]
        order = np.lexsort((bin_, what, source))
        group, bin_, count = (source * width + what)[order], bin_[order], count[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        if not len(starts):
            return
        at, upto = group[starts], np.cumsum(count)
        ends = np.concatenate([starts[1:], [len(group)]])
        before = np.concatenate([[0], upto])[starts]
        total = upto[ends - 1] - before
        if which == (LIMIT,):
            # the ESD test on bins, from the largest deviation: a bin passes by its lower edge and its last rank
            rank = np.repeat(upto[ends - 1], ends - starts) - np.concatenate([[0], upto[:-1]])
            n = self.counts[:, LEVEL][group // width]
            most = np.maximum(1, (lim.share * n).astype(np.int64))
            here = (rank - count < most) & (bin_ * DEVIATION_BIN > _esd_limit(np.maximum(n, 15), np.minimum(rank, most), lim.alpha))
            least = np.full(self.bins.shape[0], np.inf)
            np.minimum.at(least, (group // width)[here], bin_[here].astype(float))
            self.bins[:, LIMIT] = np.where(np.isfinite(least), least, np.nan)
            return
        low = bin_[np.searchsorted(upto, before + (total - 1) // 2, "right")]
        high = bin_[np.searchsorted(upto, before + total // 2, "right")]
        self.bins.flat[at], self.counts.flat[at] = (low + high) / 2, total


def _bins(x: np.ndarray, width: float) -> np.ndarray:
    return np.floor(np.clip(x / width, -1e15, 1e15)).astype(np.int64)


class Series:
    """The readings of one measure, sorted by source and time; sources are numbers.

    step: time since the previous reading, where that isn't the row before. extent: least and largest value of the run of
    near values that a reading ends or begins beyond the rows given; the value itself elsewhere. own: rows that count and
    are judged; the others are context.
    """

    def __init__(self, m: Measure, source: np.ndarray, time: np.ndarray, value: np.ndarray, present: np.ndarray, lim: Limits, step: np.ndarray | None = None, extent: tuple[np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None):
        self.m, self.lim, self.source, self.value = m, lim, source, value
        self.extent = (value, value) if extent is None else extent
        self.own = np.ones(len(value), bool) if own is None else own
        if not m.per_time:
            step = np.ones(len(value))
        elif step is None:
            step = _steps(source, time)
        with np.errstate(invalid="ignore"):
            # the time before a source's first reading isn't known: it is no spike, and its range is that of `reach`
            known = np.where(np.isfinite(step), step, lim.reach)
            self.impossible = present & ~(np.isfinite(value) & (value >= 0) & (value <= m.highest * known + m.slack))
            sound = present & np.isfinite(value) & (value > 0)
            at = np.flatnonzero(sound & np.isfinite(step) & (value <= 10 * (m.highest * step + m.slack)))
        self.at, self.src, self.t = at, source[at], time[at]
        self.x = np.log(value[at] / step[at])
        self.trend, neighbours = _trend(self.x, self.src, self.t, lim)
        self.lonely = neighbours < 3
        self.phase = ((self.t % lim.period) * lim.phases // lim.period).astype(np.int64)
        self.sound = np.flatnonzero(sound)
        v, src = value[self.sound], source[self.sound]
        self.inside, self.change = src[1:] == src[:-1], np.abs(np.diff(v))

    def _detrended(self, st: Statistics) -> np.ndarray:
        return self.x - np.where(self.lonely, st.value(LEVEL, LOG_BIN)[self.src], self.trend)

    def _residual(self, st: Statistics) -> np.ndarray:
        column = PHASE + self.phase
        spread = np.nan_to_num(st.value(SPREAD, LOG_BIN))[self.src]
        known = st.counts[self.src, column] >= self.lim.least_per_phase
        season = np.clip(np.where(known, (st.bins[self.src, column] + 0.5) * LOG_BIN, 0.0), -spread, spread)
        return self._detrended(st) - np.where(self.lonely, 0.0, season)

    def _deviation(self, st: Statistics, residual: np.ndarray) -> np.ndarray:
        k, noise = st.counts[:, CENTRE], self.m.noise
        centre, mad = np.nan_to_num(st.value(CENTRE, LOG_BIN)), np.nan_to_num(st.value(MAD, LOG_BIN))
        scale = np.sqrt((k * (1.4826 * mad) ** 2 + self.lim.prior_weight * noise**2) / (k + self.lim.prior_weight))
        wide = np.maximum(1.4826 * np.nan_to_num(st.value(WIDE, LOG_BIN)), 8 * noise)
        return np.where(self.lonely, residual / wide[self.src], (residual - centre[self.src]) / scale[self.src])

    def counted(self, which: tuple[int, ...], st: Statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, statistic and bin of each value that the statistics of a round are made of."""
        mine, usual = self.own[self.at], self.own[self.at] & ~self.lonely
        if which == (LEVEL, CHANGE):
            pair = self.inside & self.own[self.sound[1:]] if len(self.sound) else np.empty(0, bool)
            parts = [(LEVEL, mine, self.src, _bins(self.x, LOG_BIN)), (CHANGE, pair, self.source[self.sound[1:]], _bins(self.change, self.m.unit * CHANGE_BIN))]
        elif which == (SPREAD, PHASE):
            d = self._detrended(st)
            parts = [(SPREAD, mine, self.src, _bins(np.abs(d), LOG_BIN)), (PHASE + self.phase, mine, self.src, _bins(d, LOG_BIN))]
        elif which == (CENTRE, WIDE):
            level = st.value(LEVEL, LOG_BIN)[self.src]
            parts = [(CENTRE, usual, self.src, _bins(self._residual(st), LOG_BIN)), (WIDE, mine, self.src, _bins(np.abs(self.x - level), LOG_BIN))]
        elif which == (MAD,):
            centre = np.nan_to_num(st.value(CENTRE, LOG_BIN))[self.src]
            parts = [(MAD, usual, self.src, _bins(np.abs(self._residual(st) - centre), LOG_BIN))]
        else:
            d = self._deviation(st, self._residual(st))
            parts = [(LIMIT, mine & (d > LEAST_DEVIATION), self.src, _bins(d, DEVIATION_BIN))]
        whole = [(np.broadcast_to(what, len(src))[chosen], src[chosen], b[chosen]) for what, chosen, src, b in parts]
        what, src, b = (np.concatenate([w[i] for w in whole]) for i in range(3))
        return src.astype(np.int64), what.astype(np.int64), b

    def judged(self, st: Statistics) -> np.ndarray:
        """Reasons per reading: 0 none, 1 range, 2 spike, 3 stuck."""
        m, lim = self.m, self.lim
        reason = np.where(self.impossible, 1, 0).astype(np.int8)
        # only values above the trend are implausible: zero is the default and small values are ordinary rest
        residual = self._residual(st)
        with np.errstate(invalid="ignore"):
            spike = (_bins(self._deviation(st, residual), DEVIATION_BIN) >= st.bins[:, LIMIT][self.src]) & (residual > m.jump)
        spike &= _abrupt(spike, self.src, self.t, self.x, m.jump * lim.abrupt, lim.reach)
        reason[self.at[spike & (reason[self.at] == 0)]] = 2
        # stuck: runs longer than equal successive values are likely to be, given the source's usual changes
        at, v = self.sound, self.value[self.sound]
        if len(at) > 1:
            src, pairs = self.source[at], np.maximum(st.counts[:, CHANGE], 1)
            near = self.inside & _near(m, v[1:], v[:-1], lim)
            spread = np.maximum(np.nan_to_num(st.value(CHANGE, m.unit * CHANGE_BIN)), m.unit) / 0.6745
            chance = np.clip(2 * m.unit * (lim.stuck_units + 0.5) * 0.4 / spread, 0.005, 0.4)
            least = np.maximum(lim.stuck_least, 1 + np.ceil(np.log(lim.stuck_alpha / pairs) / np.log(chance)))
            least = np.minimum(least, 4 * lim.stuck_least)
            run = np.concatenate([[0], np.cumsum(~near)])
            length = np.bincount(run)[run]
            # a drift of many small steps isn't stuck: the run's span stays within a few units
            lo, hi = np.full(run[-1] + 1, np.inf), np.full(run[-1] + 1, -np.inf)
            np.minimum.at(lo, run, self.extent[0][at])
            np.maximum.at(hi, run, self.extent[1][at])
            still = (hi - lo)[run] <= m.unit * (2 * lim.stuck_units + 0.1)
            reason[at[(length >= least[src]) & still & (reason[at] == 0)]] = 3
        return reason


def flag_measure(m: Measure, source: np.ndarray, time: np.ndarray, value: np.ndarray, present: np.ndarray, lim: Limits) -> np.ndarray:
    """Reasons per reading of whole sources: 0 none, 1 range, 2 spike, 3 stuck. Rows are sorted by source and time."""
    if not len(value):
        return np.zeros(0, dtype=np.int8)
    series = Series(m, source, time, value, present, lim)
    st = Statistics(int(source.max()) + 1, lim)
    for which in ROUNDS:
        src, what, b = series.counted(which, st)
        st.set(which, src, what, b, np.ones(len(b), dtype=np.int64), lim)
    return series.judged(st)


REASONS = np.array(["", "range", "spike", "stuck"], dtype=object)


def _context(lim: Limits) -> int:
    """Readings of a measure that a block is shown on either side: enough for a trend within a run that decides a verdict."""
    return max(4 * lim.stuck_least, LONGEST_ROW) + lim.window


#: A reading at a block's edge: time, value, time since the previous reading, extent of its run so far, and whether that
#: run reaches back to the block's first reading of the measure.
EDGE = [("t", "f8"), ("v", "f8"), ("step", "f8"), ("lo", "f8"), ("hi", "f8"), ("open", "?")]


def _edge(m: Measure, time: np.ndarray, value: np.ndarray, step: np.ndarray, lim: Limits) -> tuple[np.ndarray, float]:
    """The last readings of a measure in a block, and its first value; for the first readings, give the block reversed."""
    e = np.zeros(min(len(value), _context(lim)), EDGE)
    if not len(e):
        return e, np.nan
    run = np.concatenate([[0], np.cumsum(~_near(m, value[1:], value[:-1], lim))])
    from_ = len(value) - len(e)
    e["t"], e["v"], e["step"], e["open"] = time[from_:], value[from_:], step[from_:], run[from_:] == 0
    start = np.searchsorted(run, run[from_])
    for r in range(run[from_], run[-1] + 1):
        here = slice(start if r == run[from_] else np.searchsorted(run, r), np.searchsorted(run, r, "right"))
        keep = slice(max(here.start, from_) - from_, here.stop - from_)
        drop = max(here.start, from_) - here.start
        e["lo"][keep] = np.minimum.accumulate(value[here])[drop:]
        e["hi"][keep] = np.maximum.accumulate(value[here])[drop:]
    return e, float(value[0])


def _carry(m: Measure, before: np.ndarray, own: tuple[np.ndarray, float], lim: Limits) -> np.ndarray:
    """The last readings up to and including a block, from those before it and the block's own."""
    e, first = own
    if len(before) and len(e) and _near(m, before["v"][-1], first, lim):
        e = e.copy()
        e["lo"] = np.where(e["open"], np.minimum(e["lo"], before["lo"][-1]), e["lo"])
        e["hi"] = np.where(e["open"], np.maximum(e["hi"], before["hi"][-1]), e["hi"])
    return np.concatenate([before, e])[-_context(lim) :]


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by the keys."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*kept, b])
        columns = [t[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *new.tolist()]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(i, j - i)
        kept = t.slice(starts[-1]).combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _edges(measures: Sequence[Measure], lim: Limits):
    """Per block, what its neighbours need of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["src", "block"]):
            time = t["t"].to_numpy().astype(float)
            step = _steps(np.zeros(len(time), int), time)
            last, first = [], []
            for i, m in enumerate(measures):
                v = t[f"m{i}"].to_numpy(zero_copy_only=False).astype(float)
                at = np.flatnonzero(np.isfinite(v) & (v > 0))
                last.append(_edge(m, time[at], v[at], step[at], lim))
                first.append(_edge(m, time[at][::-1], v[at][::-1], step[at][::-1], lim))
            edge = pa.array([pickle.dumps((time[0], time[-1], last, first))], pa.binary())
            yield pa.RecordBatch.from_arrays([t["src"].slice(0, 1).combine_chunks(), t["block"].slice(0, 1).combine_chunks(), edge], names=["src", "block", "edge"])

    return run


def _carrier(measures: Sequence[Measure], lim: Limits, forward: bool):
    """From the edges of a source's blocks in order, or in reverse, what each block is shown of those before it."""

    def shown(t: pa.Table) -> Iterator[pa.RecordBatch]:
        src, block = t["src"].combine_chunks(), t["block"].combine_chunks()
        for i in range(t.num_rows):
            at, text = src[i].as_py(), t["edge"][i].as_py()
            begins, ends, last, first = pickle.loads(text)
            if at != state["src"]:
                state.update(src=at, time=np.nan, before=[np.zeros(0, EDGE) for _ in measures], first=None)
            waiting = state["first"]
            if not forward and waiting is not None:
                # the step of a block's first reading needs the block before it, which comes now
                state["before"] = [_carry(m, b, (_stepped(e, waiting[0], ends), v), lim) for m, b, (e, v) in zip(measures, state["before"], waiting[1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [src.slice(i, 1), block.slice(i, 1), pa.array([-2 if forward else -1], pa.int32()), pa.array([pickle.dumps((state["time"], state["before"]))], pa.binary())],
                names=["src", "block", "pos", "shown"],
            )
            if forward:
                state["before"] = [_carry(m, b, (_stepped(e, begins, state["time"]), v), lim) for m, b, (e, v) in zip(measures, state["before"], last, strict=True)]
                state["time"] = ends
            else:
                state["first"] = (begins, first)

    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state.update(src=None, time=np.nan, before=[], first=None)
        for b in batches:
            if b.num_rows:
                yield from shown(pa.Table.from_batches([b]))

    return run


def _stepped(e: np.ndarray, begins: float, previous: float) -> np.ndarray:
    """Edge readings with the step of the block's first reading, if it is among them."""
    open_ = ~np.isfinite(e["step"])
    if not open_.any() or np.isnan(previous):
        return e
    e = e.copy()
    e["step"][open_] = max(begins - previous, 1)
    return e


def _verdicts(t: pa.Table, names: list[str], m: Measure, reason: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    hit = np.flatnonzero(reason > 0)
    if len(hit):
        reading = t.select(["src", "t", *names]).take(pa.array(hit)).combine_chunks()
        verdict = [pa.array([m.name] * len(hit), pa.string()), pa.array(REASONS[reason[hit]], pa.string()), pa.array(v[hit], pa.float64())]
        yield pa.RecordBatch.from_arrays([*[x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in reading.columns], *verdict], names=["src", "t", *names, "field", "reason", "value"])


def _flagger(measures: Sequence[Measure], lim: Limits, chunk_rows: int = 60_000):
    """Judge whole sources, many at once."""
    names = [f"m{i}" for i in range(len(measures))]

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t["src"].to_numpy(zero_copy_only=False)
        source = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        time = t["t"].to_numpy(zero_copy_only=False).astype(np.int64)
        for m, c in zip(measures, names, strict=True):
            v = t[c].to_numpy(zero_copy_only=False).astype(float)
            yield from _verdicts(t, names, m, flag_measure(m, source, time, v, ~np.asarray(t[c].is_null()), lim), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows = 0
        for t in _groups(batches, ["src"]):
            kept.append(t)
            rows += t.num_rows
            if rows >= chunk_rows:
                yield from judge(pa.concat_tables(kept))
                kept, rows = [], 0
        if kept:
            yield from judge(pa.concat_tables(kept))

    return run


def _packer(measures: Sequence[Measure]):
    """One row per block of a hot source: its readings and what it is shown of the blocks beside it."""
    names = [f"m{i}" for i in range(len(measures))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _groups(batches, ["src", "block"]):
            pos = every["pos"].to_numpy(zero_copy_only=False)
            t = every.take(pa.array(np.flatnonzero(pos == 0)))
            if not t.num_rows:
                continue
            beside = {int(pos[i]): pickle.loads(every["shown"][int(i)].as_py()) for i in np.flatnonzero(pos != 0)}
            columns = [t[c].to_numpy(zero_copy_only=False).astype(float) for c in names]
            nulls = [np.asarray(t[c].is_null()) for c in names]
            body = pickle.dumps((t["t"].to_numpy(zero_copy_only=False).astype(np.int64), columns, nulls, beside))
            yield pa.RecordBatch.from_arrays([t["src"].slice(0, 1).combine_chunks(), t["block"].slice(0, 1).combine_chunks(), pa.array([body], pa.binary())], names=["src", "block", "body"])

    return run


def _unpacked(body: bytes, measures: Sequence[Measure], lim: Limits) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[Series]]:
    time, columns, nulls, beside = pickle.loads(body)
    step = _steps(np.zeros(len(time), int), time)
    if -2 in beside and not np.isnan(beside[-2][0]):
        step[0] = max(time[0] - beside[-2][0], 1)
    out = []
    for k, m in enumerate(measures):
        v, n = columns[k], len(time)
        before = beside[-2][1][k] if -2 in beside else np.zeros(0, EDGE)
        after = beside[-1][1][k][::-1] if -1 in beside else np.zeros(0, EDGE)
        join = lambda a, mine, b: np.concatenate([a, mine, b])
        own = join(np.zeros(len(before), bool), np.ones(n, bool), np.zeros(len(after), bool))
        out.append(
            Series(
                m,
                np.zeros(len(own), dtype=np.int64),
                join(before["t"].astype(np.int64), time, after["t"].astype(np.int64)),
                join(before["v"], v, after["v"]),
                join(np.ones(len(before), bool), ~nulls[k], np.ones(len(after), bool)),
                lim,
                join(before["step"], step, after["step"]),
                (join(before["lo"], v, after["lo"]), join(before["hi"], v, after["hi"])),
                own,
            )
        )
    return time, columns, nulls, out


def _statistics(found: bytes | None, n_measures: int, lim: Limits) -> list[Statistics]:
    return pickle.loads(found) if found is not None else [Statistics(1, lim) for _ in range(n_measures)]


def _counter(measures: Sequence[Measure], lim: Limits, which: tuple[int, ...]):
    """Counts of bins of packed blocks, for the statistics of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                st = _statistics(b.column("found")[i].as_py(), len(measures), lim)
                series = _unpacked(b.column("body")[i].as_py(), measures, lim)[3]
                for k, one in enumerate(series):
                    _, what, bins = one.counted(which, st[k])
                    pairs, n = np.unique(np.stack([what, bins]), axis=1, return_counts=True)
                    if len(n):
                        src = pa.concat_arrays([b.column("src").slice(i, 1)] * len(n))
                        yield pa.RecordBatch.from_arrays([src, pa.array(np.full(len(n), k), pa.int32()), pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1]), pa.array(n)], names=["src", "k", "what", "bin", "n"])

    return run


def _finder(measures: Sequence[Measure], lim: Limits, which: tuple[int, ...]):
    """A source's statistics of a round from its counts, added to those of the rounds before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["src"]):
            kinds = t["k"].to_numpy(zero_copy_only=False)
            old = [x for x in t["found"].to_pylist() if x is not None]
            st = _statistics(old[0] if old else None, len(measures), lim)
            for k in range(len(measures)):
                at = np.flatnonzero(kinds == k)
                numbers = [t[c].to_numpy(zero_copy_only=False)[at].astype(np.int64) for c in ("what", "bin", "n")]
                st[k].set(which, np.zeros(len(at), dtype=np.int64), *numbers, lim)
            yield pa.RecordBatch.from_arrays([t["src"].slice(0, 1).combine_chunks(), pa.array([pickle.dumps(st)], pa.binary())], names=["src", "found"])

    return run


def _block_flagger(measures: Sequence[Measure], lim: Limits):
    names = [f"m{i}" for i in range(len(measures))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                st = _statistics(b.column("found")[i].as_py(), len(measures), lim)
                time, columns, nulls, series = _unpacked(b.column("body")[i].as_py(), measures, lim)
                src = pa.concat_arrays([b.column("src").slice(i, 1)] * len(time))
                t = pa.table([src, pa.array(time), *[pa.array(np.where(n, 0.0, c), mask=n) for c, n in zip(columns, nulls, strict=True)]], names=["src", "t", *names])
                for k, (m, one) in enumerate(zip(measures, series, strict=True)):
                    yield from _verdicts(t, names, m, one.judged(st[k])[one.own], columns[k])

    return run


def _in_blocks(readings: DataFrame, hot: DataFrame, measures: Sequence[Measure], limits: Limits, kind: str) -> DataFrame:
    """Verdicts on the readings of hot sources, of which `hot` holds the time range and the length of blocks."""
    names = [f"m{i}" for i in range(len(measures))]
    src = readings.schema["src"].dataType.simpleString()
    block = F.floor((F.col("t") - F.col("t0")) / F.col("span")).cast("long")
    order = ["src", "block", "t", *names]
    # each block of a hot source is shown the last readings before it and the first after it, with the runs they are part of
    edges = (
        lookup_join(readings, hot, ["src"])
        .select(*order[:1], block.alias("block"), *order[2:])
        .repartition("src", "block")
        .sortWithinPartitions(*order)
        .mapInArrow(_edges(measures, limits), f"src {src}, block long, edge binary")
    )
    edges = written(edges, "edges").repartition("src")
    around = [
        edges.sortWithinPartitions("src", F.asc("block") if forward else F.desc("block")).mapInArrow(_carrier(measures, limits, forward), f"src {src}, block long, pos int, shown binary")
        for forward in (True, False)
    ]
    blocks = lookup_join(readings, hot, ["src"]).select("src", block.alias("block"), F.lit(0).alias("pos"), "t", *names)
    for shown in around:
        blocks = blocks.unionByName(shown, allowMissingColumns=True)
    packed = written(blocks.repartition("src", "block").sortWithinPartitions("src", "block", "pos", "t", *names).mapInArrow(_packer(measures), f"src {src}, block long, body binary"), "blocks")
    # a source's statistics have a bounded size, so the number of hot sources tells whether all of them may be broadcast
    small = hot.count() * (1024 + 32 * len(measures) * (PHASE + limits.phases)) <= BROADCAST_BYTES
    beside = F.broadcast if small else lambda found: found.hint("merge")
    found = hot.select("src", F.lit(None).cast("binary").alias("found"))
    for which in ROUNDS:
        counts = (
            packed.join(beside(found), "src")
            .mapInArrow(_counter(measures, limits, which), f"src {src}, k int, what int, bin long, n long")
            .groupBy("src", "k", "what", "bin")
            .agg(F.sum("n").alias("n"))
        )
        every = found.unionByName(counts, allowMissingColumns=True).repartition("src").sortWithinPartitions("src")
        found = written(every.mapInArrow(_finder(measures, limits, which), f"src {src}, found binary"), "statistics")
    return packed.join(beside(found), "src").mapInArrow(_block_flagger(measures, limits), kind)


def flag_implausible(
    readings: DataFrame,
    source: str = "player_id",
    time: str = "frame_number",
    row_id: str = "id",
    measures: Sequence[Measure] = MOVEMENT,
    limits: Limits = Limits(),
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Implausible values, one row per reading and field: <row_id>, field, reason, value.

    reason is "range" (negative, not finite, or beyond what is physically possible), "spike" (a residual of the
    source's robust seasonal-trend decomposition beyond its generalised ESD limit) or "stuck" (part of a run of equal,
    or within a digit equal, values that is longer than the source's usual changes make likely).

    Decomposition works on the logarithm of the value, or of its rate for fields that grow with the time since the
    previous reading: trend is a running median, season the median by phase of what is left, scale the median absolute
    deviation, shrunk to the field's prior for sources with few readings. Medians and ESD ranks are taken in narrow bins,
    whose counts add up. A source of up to `hot_rows` readings is judged in one task, many sources at once; a larger one
    is spread over blocks of successive time ranges of `block_rows` readings on average, so that one that holds a third
    of the table fills no task. Its statistics are the sums of its blocks' counts, and a block sees the readings beyond
    its borders that decide on its own, so verdicts are the same however a source is cut. A stuck run need never be
    longer than 4 x `stuck_least` readings, and of more than LONGEST_ROW spikes in a row the inner ones are no spikes.

    Nulls and zeros are no cases and break no run. Rows with equal measurements of one source and time are one reading,
    counted and judged once and reported under each of their ids, whatever their number. Rows without source or time are only checked for range, per row,
    as nobody's behaviour is known. An empty table gives no rows; other columns are ignored.
    """
    ship(readings.sparkSession)
    cols = [F.col(source).alias("src"), F.col(time).cast("long").alias("t"), F.col(row_id).cast("long").alias("id")]
    cols += [F.col(m.name).cast("double").alias(f"m{i}") for i, m in enumerate(measures)]
    rows = readings.select(*cols)
    placed = rows.where("src is not null and t is not null")
    names = [f"m{i}" for i in range(len(measures))]
    readings = written(placed.select("src", "t", *names).distinct(), "readings")  # copies go once, for all that follows
    hot = (
        readings.groupBy("src")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
        .where(F.col("n") > hot_rows)
        .select("src", "t0", F.greatest(F.ceil((F.col("t1") - F.col("t0") + 1) / F.ceil(F.col("n") / block_rows)), F.lit(4 * limits.reach)).alias("span"))
    )
    hot = written(hot, "hot")
    src = readings.schema["src"].dataType.simpleString()
    kind = f"src {src}, t long, {', '.join(f'{c} double' for c in names)}, field string, reason string, value double"
    whole = lookup_join(readings, hot.select("src"), ["src"], "left_anti")
    flagged = whole.repartition("src").sortWithinPartitions("src", "t", *names).mapInArrow(_flagger(measures, limits), kind)
    if not hot.isEmpty():
        flagged = flagged.unionByName(_in_blocks(readings, hot, measures, limits, kind))
    # verdicts on readings go to all rows that hold them; equality of nulls by a mask beside the values
    mask = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(names)), F.lit(0)).alias("_mask")
    key = ["src", "t", *[F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in names], mask]
    on = ["src", "t", *[f"_{c}" for c in names], "_mask"]
    verdicts = written(flagged.select(*key, F.struct("field", "reason", "value").alias("_v")).groupBy(*on).agg(F.collect_list("_v").alias("_v")), "flags")
    flagged = lookup_join(placed.select("id", *key), verdicts, on).select("id", "_v").distinct().select("id", F.inline("_v"))
    lost = rows.where("src is null or t is null").select(
        "id", F.inline(F.array(*[F.struct(F.lit(m.name).alias("field"), F.lit("range").alias("reason"), F.col(f"m{i}").alias("value"), F.lit(m.highest).alias("highest"), F.lit(m.per_time).alias("rate")) for i, m in enumerate(measures)]))
    )
    lost = lost.where("value < 0 or isnan(value) or value = double('infinity') or (not rate and value > highest)").select("id", "field", "reason", "value").distinct()
    return flagged.unionByName(lost).withColumnRenamed("id", row_id)
