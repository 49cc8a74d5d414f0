"""How values are shown: numbers, shares, titles, authors and times as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing number, for no authors and for a text that is no time
NONE, NOBODY, NO_TIME = "—", "Unknown", "Invalid Date"


def grouped_number(value: Column) -> Column:
    """Thousands apart by commas, at most three decimals and none that are zero; a dash for null and NaN."""
    shown = F.call_function("format_number", F.round(value.cast("double"), 3), F.lit("#,##0.###"))
    return F.when(value.isNull() | F.isnan(value.cast("double")), NONE).otherwise(shown)


def percent(value: Column) -> Column:
    """A share as whole per cent, halves up; a dash for null."""
    return F.when(value.isNull(), NONE).otherwise(F.concat(F.floor(value * 100 + 0.5).cast("long"), F.lit("%")))


def short_title(title: Column, most: int = 70) -> Column:
    """At most ``most`` code points, the last an ellipsis where some are left out; empty for null."""
    held = F.coalesce(title, F.lit(""))
    return F.when(F.length(held) > most, F.concat(F.left(held, F.lit(most - 1)), F.lit("…"))).otherwise(held)


def author_line(authors: Column, most: int = 3) -> Column:
    """The first ``most`` names and how many follow; a null name is an empty one."""
    first = F.array_join(F.slice(authors, 1, most), ", ", "")
    n = F.coalesce(F.size(authors), F.lit(0))
    return F.when(n < 1, NOBODY).when(n <= most, first).otherwise(F.concat(first, F.lit(" +"), n - most))


def _nearest_millis(at: Column) -> Column:
    """A time in whole milliseconds since 1970, halves away from it."""
    micros = F.unix_micros(at)
    return F.unix_millis(F.timestamp_micros(micros + F.when(micros < 0, 499).otherwise(500)))


def time_ago(text: Column, as_of: Column) -> Column:
    """How long before ``as_of`` a time was: seconds, minutes or hours, from a day on its date (month/day/year).

    Both times count to the nearest millisecond. The present is a parameter, so that a result can be had again. Null
    for null; a later time has negative seconds.
    """
    at = F.try_to_timestamp(text)
    seconds = F.floor((_nearest_millis(as_of) - _nearest_millis(at)) / 1000)
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    shown = F.when(seconds < 60, F.concat(seconds, F.lit("s ago"))).when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago")))
    return F.when(text.isNull(), None).when(at.isNull(), NO_TIME).otherwise(shown.otherwise(F.date_format(at, "M/d/yyyy")))


def _over(first: Column, second: Column) -> Column:
    keys = F.map_keys(second)
    rest = F.map_filter(first, lambda k, _: ~F.array_contains(keys, k))
    return F.when(second.isNull(), first).when(first.isNull(), second).otherwise(F.map_concat(rest, second))


def later_wins(*maps: Column) -> Column:
    """One map of several: of equal keys the last map's value. A null map is an empty one; no session setting is needed."""
    return reduce(_over, maps)
