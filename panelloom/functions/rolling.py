"""Window expressions over an ordered window (see `PanelKeys.history`).

Every operator with a span takes `min_periods`, the number of known values the span must hold.
The default is the whole span; `min_periods=1` accepts partial spans at the start of a series.

Two rules keep a wide set of features cheap. Spark evaluates every window expression it is given,
equal ones too, so the span operators ask a `Frames` object for window values and each distinct
value is computed once per pass. And Spark re-aggregates a sliding frame for every row, so counts
are taken as the difference of two frames that only grow: one step per row for any span. For sums,
spreads, slopes and extremes a difference would lose digits, and a NaN or a very large value would
stay in it for the rest of the series. Over long spans they are aggregated in blocks from two sides:
the rows of a partition are cut into blocks as long as the span, and one growing frame runs forwards
and one backwards inside each block. A span covers the end of one block and the start of the next at most, so it is
merged from one value of each: a few steps per row for any span, and only rows of the span enter.
Middle spans up to the current row are merged from short sliding parts: a span of 90 rows from the value of nine
parts of 10 rows, which all spans and aggregates share. That takes no sort, and again only rows of the span enter.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_FIRST = Window.unboundedPreceding
_END = Window.unboundedFollowing
# Spans of up to this many rows need no blocks: on wide rows two more sorts cost more than so few steps.
_SHORT = 120
# Rows of a part; spans of less than two parts slide.
_PART = 10


def _total(values: Sequence[Column]) -> Column:
    """Sum of the known values, 0 without any."""
    return reduce(operator.add, [F.coalesce(v, F.lit(0.0)) for v in values])


class Frames:
    """Window values over one ordered window, each distinct one computed once.

    The methods return references to columns that `select` adds; the expressions built from them
    must be passed through `select` of the same object. `by` are the partition columns of the window;
    only where they are given, spans of more than `short` rows are aggregated in blocks and shorter ones
    in parts, else all slide.
    """

    def __init__(self, w: WindowSpec, by: Sequence[str] | None = None, short: int = _SHORT):
        self._w = w
        self._by = by
        self._short = short
        self._made: dict[str, tuple[str, Column]] = {}
        self._sides: dict[int, dict[str, tuple[str, Column]]] = {}
        self._pieces: dict[str, tuple[str, Column]] = {}
        self._merges: dict[str, tuple[str, Column]] = {}

    def _take(self, key: str, value: Column) -> Column:
        if key not in self._made:
            self._made[key] = (f"__frame_{len(self._made)}", value)
        return F.col(self._made[key][0])

    def rows(self, agg: Column, first: int, last: int) -> Column:
        """Aggregate over the rows first..last around the current one."""
        return self._take(f"rows {agg} {first} {last}", agg.over(self._w.rowsBetween(first, last)))

    def days(self, agg: Column, first: int, last: int) -> Column:
        """Aggregate over order values first..last around the current one (a day number)."""
        return self._take(f"days {agg} {first} {last}", agg.over(self._w.rangeBetween(first, last)))

    def lag(self, value: Column, n: int = 1) -> Column:
        return self._take(f"lag {value} {n}", F.lag(value, n).over(self._w))

    def lead(self, value: Column, n: int = 1) -> Column:
        return self._take(f"lead {value} {n}", F.lead(value, n).over(self._w))

    def count(self, value: Column, first: int, last: int) -> Column:
        """Known values on rows first..last."""
        return self.rows(F.count(value), _FIRST, last) - self.rows(F.count(value), _FIRST, first - 1)

    def _slides(self, first: int, last: int) -> bool:
        return self._by is None or last - first < self._short

    def _halves(self, agg: Column, first: int, last: int) -> tuple[Column, Column]:
        """Aggregates over the two parts of rows first..last: the end of the block that the span
        starts in, and the start of the block that it ends in. NULL for a part without rows."""
        n = last - first + 1
        sides = self._sides.setdefault(n, {})
        name, _ = sides.setdefault(str(agg), (f"{n}_{len(sides)}", agg))
        start, end = F.col("__row") + first, F.col("__row") + last
        head, tail = self._at(F.col(f"__up_{name}"), last), self._at(F.col(f"__down_{name}"), first)
        whole = start % n == 0
        if last > 0:
            # The series may end inside the span: the part up to its last row takes the place of the head.
            final = self.rows(F.max("__row"), _FIRST, _END)
            head = F.when(end <= final, head).otherwise(self.rows(F.last(f"__up_{name}"), _FIRST, _END))
            one_block = F.floor(start / n) == F.floor(F.least(end, final) / n)
            head = F.when((start <= final) & (whole | ~one_block | (start < 0)), head)
        return F.when(~whole, tail), head

    def _at(self, value: Column, offset: int) -> Column:
        if offset == 0:
            return value
        return self.lag(value, -offset) if offset < 0 else self.lead(value, offset)

    def _in_parts(self, first: int, last: int) -> bool:
        return self._by is not None and last <= 0 and 2 * _PART <= last - first + 1 <= self._short

    def _parts(self, agg: Column, first: int, last: int) -> list[Column]:
        """Aggregates over consecutive parts of rows first..last, the latest first; NULL for a part before
        the series."""
        whole, rest = divmod(last - first + 1, _PART)
        sizes = [_PART] * whole + ([rest] if rest else [])
        found = []
        for number, size in enumerate(sizes):
            frame = self._w.rowsBetween(1 - size, 0)
            name, _ = self._pieces.setdefault(f"{agg} {size}", (f"__part_{len(self._pieces)}", agg.over(frame)))
            found.append(self._at(F.col(name), last - number * _PART))
        return found

    def _merged(self, agg: Column, first: int, last: int, merge) -> Column:
        if self._slides(first, last):
            return self.rows(agg, first, last)
        return merge(*self._halves(agg, first, last))

    def sum(self, value: Column, first: int, last: int) -> Column:
        """Sum of the known values on rows first..last; 0 without any."""
        if self._in_parts(first, last):
            return _total(self._parts(F.sum(value), first, last))
        whole = self._merged(F.sum(value), first, last, lambda a, b: F.coalesce(a + b, a, b))
        return F.coalesce(whole, F.lit(0.0))

    def product(self, value: Column, first: int, last: int) -> Column:
        """Product of the known values on rows first..last."""
        if self._in_parts(first, last):
            parts = self._parts(F.product(value), first, last)
            whole = reduce(operator.mul, [F.coalesce(p, F.lit(1.0)) for p in parts])
            return F.when(F.coalesce(*parts).isNotNull(), whole)
        return self._merged(F.product(value), first, last, lambda a, b: F.coalesce(a * b, a, b))

    def max(self, value: Column, first: int, last: int) -> Column:
        if self._in_parts(first, last):
            return F.greatest(*self._parts(F.max(value), first, last))
        return self._merged(F.max(value), first, last, F.greatest)

    def min(self, value: Column, first: int, last: int) -> Column:
        if self._in_parts(first, last):
            return F.least(*self._parts(F.min(value), first, last))
        return self._merged(F.min(value), first, last, F.least)

    def _moments(self, first: int, last: int, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """Number, sum of squared deviations of x and of the products of deviations of x and y, over
        the rows where both are known. Equal values of x have no deviation at all: means of two
        halves may differ in their last digit."""
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

        def halves(agg: Column) -> tuple[Column, Column]:
            return self._halves(agg, first, last)

        n1, n2 = (F.coalesce(n, F.lit(0)) for n in halves(F.count(x)))
        n = n1 + n2
        weight = n1 * n2 / F.nullif(n, F.lit(0))
        x1, x2 = halves(F.avg(x))
        y1, y2 = halves(F.avg(y))

        def spread(parts: tuple[Column, Column], between: Column) -> Column:
            within = [F.when(k > 0, k * part).otherwise(0.0) for k, part in zip((n1, n2), parts)]
            return within[0] + within[1] + F.when((n1 > 0) & (n2 > 0), between).otherwise(0.0)

        squares = spread(halves(F.var_pop(x)), (x2 - x1) * (x2 - x1) * weight)
        products = spread(halves(F.covar_pop(x, y)), (x2 - x1) * (y2 - y1) * weight)
        level = F.greatest(*halves(F.max(x))) == F.least(*halves(F.min(x)))
        return n, F.when(level & ~F.isnan(squares), 0.0).otherwise(squares), products

    def _moments_of_parts(self, first: int, last: int, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """What `_moments` gives, from parts: deviations within the parts and those of their means."""
        same = str(x) == str(y)
        if not same:
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

        def parts(agg: Column) -> list[Column]:
            return self._parts(agg, first, last)

        def mean(means: Sequence[Column]) -> Column:
            return _total([k * m for k, m in zip(counts, means)]) / F.nullif(n, F.lit(0))

        def once(name: str, value: Column) -> Column:
            """A value that several expressions use, as a column of its own."""
            key = f"{name} {x} {y} {first} {last}"
            return F.col(self._merges.setdefault(key, (f"__merge_{len(self._merges)}", value))[0])

        counts, xs, within = parts(F.count(x)), parts(F.avg(x)), parts(F.var_pop(x))
        n = self.count(x, first, last)
        x_mean = once("x", mean(xs))
        # Means of equal values may differ in their last digit, so their highest values are compared.
        # An array function also keeps this long projection out of one method that the JVM won't compile.
        highest = parts(F.max(x))
        level = F.forall(F.array(*within), lambda v: F.coalesce(v, F.lit(0.0)) == 0.0) & (F.greatest(*highest) == F.least(*highest))
        squares = _total([k * (v + (m - x_mean) * (m - x_mean)) for k, v, m in zip(counts, within, xs)])
        squares = F.when(level, 0.0).otherwise(squares)
        if same:
            return n, squares, squares
        ys, joint = parts(F.avg(y)), parts(F.covar_pop(x, y))
        y_mean = once("y", mean(ys))
        products = _total([k * (c + (a - x_mean) * (b - y_mean)) for k, c, a, b in zip(counts, joint, xs, ys)])
        return n, squares, products

    def deviation(self, value: Column, first: int, last: int) -> Column:
        """Sample standard deviation on rows first..last; NULL under two known values."""
        if self._in_parts(first, last):
            n, squares, _ = self._moments_of_parts(first, last, value, value)
        elif self._slides(first, last):
            return self.rows(F.stddev_samp(value), first, last)
        else:
            n, squares, _ = self._moments(first, last, value, value)
        return F.when(n > 1, F.sqrt(squares / (n - 1)))

    def slope(self, y: Column, x: Column, first: int, last: int) -> Column:
        """Slope of y on x on rows first..last where both are known; NULL when x does not vary."""
        if self._in_parts(first, last):
            _, squares, products = self._moments_of_parts(first, last, x, y)
        elif self._slides(first, last):
            return self.rows(F.regr_slope(y, x), first, last)
        else:
            _, squares, products = self._moments(first, last, x, y)
        return products / F.nullif(squares, F.lit(0.0))

    def select(self, df: DataFrame, *columns: Column) -> DataFrame:
        """All columns of df plus the given ones."""
        staged = df
        if self._sides:
            staged = staged.select("*", (F.row_number().over(self._w) - 1).alias("__row"))
        for n, sides in self._sides.items():
            block = F.floor(F.col("__row") / n)
            up = Window.partitionBy(*self._by, block).orderBy("__row").rowsBetween(_FIRST, 0)
            down = Window.partitionBy(*self._by, block).orderBy(F.col("__row").desc()).rowsBetween(_FIRST, 0)
            staged = staged.select("*", *[agg.over(up).alias(f"__up_{name}") for name, agg in sides.values()])
            staged = staged.select("*", *[agg.over(down).alias(f"__down_{name}") for name, agg in sides.values()])
        for stage in (self._pieces, self._made, self._merges):
            if stage:
                staged = staged.select("*", *[value.alias(name) for name, value in stage.values()])
        return staged.select(*df.columns, *columns)


# Operators on spans, over Frames.


def _compound(fr: Frames, returns: Column, first: int, last: int, need: int) -> Column:
    """Compounded return of rows first..last; a return of -1 or less is a total loss."""
    logs = F.log1p(F.when(returns > -1.0, returns))
    lost = fr.count(F.when(returns <= -1.0, 1), first, last) > 0
    growth = F.when(lost, F.lit(-1.0)).otherwise(F.expm1(fr.sum(logs, first, last)))
    return F.when(fr.count(returns, first, last) >= need, growth)


def trailing_compound(fr: Frames, returns: Column, n: int, min_periods: int | None = None) -> Column:
    """Compounded return of the n sessions before today."""
    return _compound(fr, returns, -n, -1, n if min_periods is None else min_periods)


def forward_compound(fr: Frames, returns: Column, n: int, min_periods: int | None = None) -> Column:
    """Compounded return of the n sessions after today."""
    return _compound(fr, returns, 1, n, n if min_periods is None else min_periods)


def trailing_volatility(fr: Frames, returns: Column, n: int, min_periods: int | None = None) -> Column:
    """Sample standard deviation over the n sessions before today."""
    known = fr.count(returns, -n, -1)
    return F.when(
        known >= (n if min_periods is None else min_periods), fr.deviation(returns, -n, -1)
    )


def moving_average(fr: Frames, value: Column, n: int, min_periods: int | None = None) -> Column:
    """Mean of the last n sessions, the current one included."""
    known = fr.count(value, 1 - n, 0)
    mean = fr.sum(value, 1 - n, 0) / F.nullif(known, F.lit(0))
    return F.when(known >= (n if min_periods is None else min_periods), mean)


def distance_to_average(fr: Frames, price: Column, n: int, min_periods: int | None = None) -> Column:
    mean = moving_average(fr, price, n, min_periods)
    return (price - mean) / F.nullif(mean, F.lit(0.0))


def drawdown_from_peak(fr: Frames, price: Column, n: int, min_periods: int | None = None) -> Column:
    """Share lost since the highest price of the last n sessions."""
    peak = fr.max(price, 1 - n, 0)
    share = (peak - price) / F.nullif(peak, F.lit(0.0))
    known = fr.count(price, 1 - n, 0)
    return F.when(known >= (n if min_periods is None else min_periods), share)


def outperformance_rate(
    fr: Frames, returns: Column, reference: Column, n: int, min_periods: int | None = None
) -> Column:
    """Share of the last n sessions whose return beat the reference.

    A session where either return is unknown counts as not beaten, so the guard counts rows.
    """
    rows = fr.count(F.lit(1), 1 - n, 0)
    beaten = fr.count(F.when(returns > reference, 1), 1 - n, 0)
    return F.when(rows >= (n if min_periods is None else min_periods), beaten / rows)


def rolling_beta(
    fr: Frames, returns: Column, reference: Column, n: int, min_obs: int = 60
) -> Column:
    """Slope of returns on reference over the last n sessions.

    Only sessions where both are known enter, into numerator and denominator alike; NULL under
    `min_obs` such pairs or when the reference does not vary.
    """
    paired = F.when(returns.isNotNull() & reference.isNotNull(), reference)
    pairs = fr.count(paired, 1 - n, 0)
    # A slope over a reference that does not vary is NULL by itself.
    return F.when(pairs >= min_obs, fr.slope(returns, reference, 1 - n, 0))


def rsi_from_moves(
    fr: Frames, gain: Column, loss: Column, n: int, min_periods: int | None = None
) -> Column:
    """Relative strength index from columns that hold the gain and the loss of each session."""
    first = 1 - n
    up, down = fr.sum(gain, first, 0), fr.sum(loss, first, 0)
    index = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + up / F.nullif(down, F.lit(0.0)))
    fell = fr.count(F.when(loss > 0, 1), first, 0) > 0
    known = fr.count(gain, first, 0)
    return F.when(
        known >= (n if min_periods is None else min_periods), F.when(fell, index).otherwise(F.lit(100.0))
    )


def days_since_last(fr: Frames, date: Column, happened: Column) -> Column:
    """Days since the latest earlier row where `happened`; NULL before the first one."""
    return F.datediff(date, fr.rows(F.max(F.when(happened, date)), _FIRST, -1))


def history_days(fr: Frames, date: Column) -> Column:
    """Days since the first row of the partition."""
    return F.datediff(date, fr.rows(F.min(date), _FIRST, 0))


def trailing_days_count(fr: Frames, value: Column, days: int) -> Column:
    """Known values on the `days` calendar days before today (order = day number)."""
    return fr.days(F.count(value), _FIRST, -1) - fr.days(F.count(value), _FIRST, -days - 1)


def trailing_days_sum(fr: Frames, value: Column, days: int) -> Column:
    """Sum of the values on the `days` calendar days before today (order = day number).

    NULL when the span has no known value.
    """
    return fr.days(F.sum(value), -days, -1)


# Single window expressions, over a plain window.


def simple_return(w: WindowSpec, price: Column) -> Column:
    """(price - previous) / previous: the one form used everywhere, so that equal price moves give
    equal returns, bit by bit, and a comparison of the two sees the tie."""
    previous = F.lag(price, 1).over(w)
    return (price - previous) / F.nullif(previous, F.lit(0.0))


def forward_fill(w: WindowSpec, value: Column) -> Column:
    """Last known value up to and including the current row."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(_FIRST, Window.currentRow))


def running_compound(w: WindowSpec, returns: Column) -> Column:
    """Growth factor from the start of the partition up to the current row."""
    return F.product(returns + F.lit(1.0)).over(w.rowsBetween(_FIRST, Window.currentRow))


def running_max(w: WindowSpec, value: Column) -> Column:
    return F.max(value).over(w.rowsBetween(_FIRST, Window.currentRow))
