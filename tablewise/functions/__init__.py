"""Cell rules as Spark column expressions."""

from .dates import date_of, standard_date
from .hashing import compact_key, content_hash, key_hash, short_id, url_key
from .numbers import (
    bin_edge,
    bin_index,
    display,
    num_loose,
    num_strict,
    to_integer,
)
from .places import standard_place
from .text import (
    blank_to_null,
    change_case,
    collapse,
    comma_list,
    contains_text,
    formula_guard,
    is_email,
    is_empty,
    is_missing,
    map_value,
    parse_boolean,
    strip,
    title_case,
)
from .urls import checked_url, clean_url, domain, has_web_scheme, url_safety

__all__ = [name for name in dir() if not name.startswith("_")]
