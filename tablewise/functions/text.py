"""Text rules: whitespace, blanks, case, lists, formula guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The words that count as "no value", by place of use.
MISSING_NULL: tuple[str, ...] = ()
MISSING_PROFILE = ("", "null")
MISSING_FILTER = ("", "null", "none")
MISSING_REQUIRED = ("", "null", "none", "n/a")
BLANK_WORDS = ("", "n/a", "na", "null", "none", "-", "--", "undefined")

# Words of a true or false cell.
TRUE_WORDS = ("true", "yes", "1", "y", "t")
FALSE_WORDS = ("false", "no", "0", "n", "f")

# Fixed value: a cell that a spreadsheet would read as a formula.
FORMULA_START = r"^[=+\-@\t\r]"

# Fixed value: shape of an e-mail address.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


def strip(c: Column) -> Column:
    """Text without whitespace at both ends."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def lowered(c: Column) -> Column:
    """Stripped, lower-case text: the form in which record filters compare."""
    return F.lower(strip(c))


def collapse(c: Column) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return strip(F.regexp_replace(c.cast("string"), f"[{WHITESPACE}]+", " "))


def is_missing(c: Column, words: Iterable[str] = MISSING_PROFILE) -> Column:
    """True where ``c`` is null or one of ``words``; never null itself."""
    words = list(words)
    if not words:
        return c.isNull()
    text = strip(c)
    # The length test keeps long texts from being copied to lower case.
    longest = max(len(w) for w in words)
    return c.isNull() | ((F.octet_length(text) <= longest) & F.lower(text).isin(words))


def is_empty(c: Column, textual: bool = True) -> Column:
    """Null or exactly the empty string."""
    return (c.isNull() | (c == F.lit(""))) if textual else c.isNull()


def blank_to_null(c: Column) -> Column:
    return F.when(~lowered(c).isin(list(BLANK_WORDS)), c)


def title_case(c: Column) -> Column:
    """Capital after every character that is no letter, as in ``It'S Ab-Cd``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(
        runs,
        lambda x: F.concat(
            F.upper(F.left(x, F.lit(1))), F.lower(x.substr(F.lit(2), F.length(x)))
        ),
    )
    return F.array_join(cased, "")


def change_case(c: Column, case: str) -> Column:
    if case == "lower":
        return F.lower(c)
    if case == "upper":
        return F.upper(c)
    return title_case(c)


def is_true_word(c: Column) -> Column:
    return lowered(c).isin(list(TRUE_WORDS))


def parse_boolean(c: Column) -> Column:
    """Boolean of a declared boolean field: other text is true when not empty."""
    low = F.lower(c)
    return (
        F.when(low.isin(list(TRUE_WORDS)), F.lit(True))
        .when(low.isin(list(FALSE_WORDS)), F.lit(False))
        .otherwise(F.length(c) > 0)
    )


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL)


def comma_list(c: Column) -> Column:
    """Comma separated text to an array of stripped, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def formula_guard(c: Column) -> Column:
    """A quote in front of text that a spreadsheet would run as a formula."""
    text = c.cast("string")
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def contains_text(c: Column, needle: str) -> Column:
    """Literal, case-insensitive containment; null never matches."""
    return F.coalesce(F.lower(c.cast("string")).contains(needle.lower()), F.lit(False))


def map_value(c: Column, mapping: dict) -> Column:
    """Mapped value: exact stripped key first, then the key in any case, else ``c``.

    The mapping is a literal of the plan, so it is meant for small maps given
    by hand; ``map_by_table`` in the transform operators joins larger ones.
    """
    text = c.cast("string")
    if not mapping:
        return text
    key = strip(text)
    anycase: dict[str, str] = {}
    for k, v in mapping.items():
        anycase.setdefault(str(k).lower(), v)

    def literal(pairs: dict) -> Column:
        flat = [F.lit(x) for k, v in pairs.items() for x in (str(k), None if v is None else str(v))]
        return F.create_map(*[x.cast("string") for x in flat])

    exact, loose = literal(mapping), literal(anycase)
    return (
        F.when(F.map_contains_key(exact, key), F.try_element_at(exact, key))
        .when(F.map_contains_key(loose, F.lower(key)), F.try_element_at(loose, F.lower(key)))
        .otherwise(text)
    )
