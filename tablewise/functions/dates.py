"""Date text to ``yyyy-MM-dd``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# The accepted date shapes in the order they are tried. The second
# item says how the captured parts form year-month-day; the order puts day-first
# before month-first.
NUMERIC_SHAPES = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
)
NAMED_SHAPE = r"^[A-Za-z]+ \d{1,2}, \d{4}$"
NAMED_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy")
CLOCK_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2})(?:\.\d+)? ?(?:Z|UTC|[+-]\d{2}:?\d{2})?$"


def date_of(c: Column) -> Column:
    """The date in ``c``, null where no shape fits the whole text.

    A time may carry a fraction and a zone; the date is the one written, in that zone.

    Every shape is tested before the text is read: Spark's own pattern reader
    accepts a four-digit year for a one-digit day.
    """
    text = strip(c)
    tries = [
        F.when(text.rlike(shape), F.regexp_replace(text, shape, order).try_cast("date"))
        for shape, order in NUMERIC_SHAPES
    ]
    tries += [
        F.when(text.rlike(NAMED_SHAPE), F.try_to_timestamp(text, F.lit(fmt)).cast("date"))
        for fmt in NAMED_FORMATS
    ]
    tries.append(
        F.when(text.rlike(CLOCK_SHAPE), F.regexp_replace(text, CLOCK_SHAPE, "$1").try_cast("timestamp_ntz").cast("date"))
    )
    return F.coalesce(*tries)


def standard_date(c: Column) -> Column:
    """Date text as ``yyyy-MM-dd``; text that holds no date stays as it is."""
    return F.coalesce(date_of(c).cast("string"), c)
