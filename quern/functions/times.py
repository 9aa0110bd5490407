"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def relative_bucket(seconds_ago: Column) -> Column:
    """`now` within a minute either way, then minutes, hours and days below thirty; null beyond or in the future."""
    n = lambda d, unit: F.concat(F.floor(seconds_ago / d).cast("string"), F.lit(unit))
    return F.when(seconds_ago < -60, None).when(seconds_ago < 60, F.lit("now")).when(seconds_ago < 3600, n(60, "m")).when(seconds_ago < 86400, n(3600, "h")).when(seconds_ago < 30 * 86400, n(86400, "d"))


def day_key(text: Column) -> Column:
    """`YYYY-MM-DD` of an RFC 2822 date, else its first 20 characters; null and empty give an empty text."""
    date = F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})", 0)
    parsed = F.try_to_timestamp(date, F.lit("d MMM yyyy"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.substring(F.coalesce(text, F.lit("")), 1, 20))
