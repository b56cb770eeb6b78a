"""Date and epoch expressions on timestamp_ntz, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three accepted layouts of a date in a predicate.
PREDICATE_DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def load_date(text: Column) -> Column:
    """Parse a loaded date to whole seconds; text that is no date becomes NULL."""
    return F.date_trunc("second", F.try_to_timestamp(text)).cast("timestamp_ntz")


def predicate_date(text: Column) -> Column:
    """Parse a predicate date in one of the accepted layouts; NULL when none fits."""
    parsed = [F.try_to_timestamp(text, F.lit(layout)) for layout in PREDICATE_DATE_LAYOUTS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since 1970-01-01 as a double."""
    days = F.unix_date(F.to_date(moment)).cast("bigint")
    seconds = days * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return seconds.cast("double")


def from_epoch(seconds: Column) -> Column:
    """timestamp_ntz of an epoch value, fraction of a second dropped."""
    whole = F.floor(seconds).cast("bigint")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)"))


def moment_text(moment: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS."""
    return F.date_trunc("second", moment).cast("timestamp_ntz").cast("string")


def day_text(moment: Column) -> Column:
    return F.to_date(moment).cast("string")
