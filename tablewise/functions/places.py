"""Place-name aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import strip

# Short or old place names and their standard form, first match wins.
PLACE_ALIASES = {
    "bengaluru": "Bangalore",
    "blr": "Bangalore",
    "bombay": "Mumbai",
    "madras": "Chennai",
    "calcutta": "Kolkata",
    "nyc": "New York City",
    "ny": "New York",
    "sf": "San Francisco",
    "bay area": "San Francisco Bay Area",
    "usa": "United States",
    "us": "United States",
    "uk": "United Kingdom",
    "uae": "United Arab Emirates",
    "delhi ncr": "Delhi-NCR",
    "gurugram": "Gurgaon",
}


def standard_place(c: Column) -> Column:
    """Standard place name, of the first alias in the list that stands in the value.

    An alias stands between blanks or ends of the value; a comma may follow it at the
    start. All its whole words are then replaced.
    """
    text = strip(c)

    def named(alias: str) -> Column:
        stands = r"(?i)^{0}(?=[, ]|\z)|(?<= ){0}(?= |\z)".format(re.escape(alias))
        return F.when(text.rlike(stands), F.regexp_replace(text, rf"(?i)\b{re.escape(alias)}\b", PLACE_ALIASES[alias]))

    return F.coalesce(*map(named, PLACE_ALIASES), c)
