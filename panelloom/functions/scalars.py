"""Row-level expressions. Every one stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(predicate: Column) -> Column:
    """Two-valued flag: an unknown predicate counts as False."""
    return F.when(predicate, True).otherwise(False)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """What `F.round` gives for a double, without its decimal arithmetic where the digits leave no doubt.

    Whole steps divided once are the double nearest to the decimal number. Near a tie, and for values of
    too many steps, NaN or infinity, `F.round` itself decides.
    """
    steps = value * float(10**digits)
    whole = F.rint(steps)
    clear = (F.abs(steps - whole) < 0.499) & (F.abs(steps) < 1e12)
    return F.when(clear, (whole + 0.0) / float(10**digits)).otherwise(F.round(value, digits))


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open range [edge[i-1], edge[i]) that holds the value; NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(value < F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def null_if_nonfinite(value: Column) -> Column:
    """NaN and the two infinities become NULL."""
    limit = F.lit(float("inf"))
    return F.when(F.isnan(value) | (F.abs(value) == limit), None).otherwise(value)


def known_score(score: Column) -> Column:
    """A score as it is ranked: NaN is unknown, like NULL."""
    value = score.cast("double")
    return F.when(~F.isnan(value), value)


def best_first(score: Column, asset: Column) -> Column:
    """The one order of scores, for ascending sorts and `min_by`: the highest first, ties by the smaller
    asset, unknown scores last."""
    value = known_score(score)
    return F.struct(value.isNull(), -value, asset)


def parse_date_multi(text: Column, formats: Sequence[str]) -> Column:
    """First format that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def parse_decimal_comma(text: Column) -> Column:
    """'1.234,50' -> 1234.5; text that is not a number -> NULL."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def normalise_symbol(symbol: Column) -> Column:
    """Upper-case symbol without its exchange suffix ('abcd11.SA' -> 'ABCD11')."""
    return F.upper(F.regexp_replace(F.trim(symbol), r"\.[A-Za-z]{1,3}$", ""))


def month_start(date: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(date, "month")


def month_index(date: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(date) * 12 + F.month(date)


def day_number(date: Column) -> Column:
    """Days since the epoch; unlike seconds it has no daylight-saving shift."""
    return F.unix_date(date)


def hash_order(seed: int, *parts: Column) -> Column:
    """Order key that looks random but depends only on the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_slot(seed: int, slots: int, *parts: Column) -> Column:
    """Integer in [0, slots) drawn from `hash_order`."""
    digits = F.conv(F.substring(hash_order(seed, *parts), 1, 12), 16, 10).cast("long")
    return F.pmod(digits, F.lit(slots).cast("long"))
