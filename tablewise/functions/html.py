"""Tags and attributes of a page, read as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is no markup: comments, scripts, styles.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
# The attributes of a tag; a quoted value may hold any sign but its quote.
ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
# One attribute: its name and, behind an equals sign, a value in double, single or no quotes.
ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def tags(html: Column, name: str) -> Column:
    """Attribute texts of all tags ``name``, in order."""
    shown = F.regexp_replace(html, HIDDEN, "")
    return F.regexp_extract_all(shown, F.lit(rf"(?i)<{name}(?=[\s/>]){ATTRIBUTES}"), F.lit(1))


def attribute(text: Column, name: str) -> Column:
    """Value of the first attribute ``name``; '' where it has none, null where it is missing."""
    parts = F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(0))
    named = F.filter(parts, lambda p: F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1)) == name)
    value = F.regexp_extract(F.get(named, F.lit(0)), r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.regexp_replace(F.regexp_extract(value, r"""(?s)^("?)('?)(.*?)\2\1$""", 3), "(?i)&amp;", "&")


def canonical_link(html: Column) -> Column:
    """``href`` of the first link tag whose ``rel`` holds the word canonical; null without one.

    Attributes come in any order, case and quoting. Tags in comments, scripts and styles do not count, nor
    do those without a target.
    """
    links = F.transform(
        tags(html, "link"), lambda t: F.struct(F.lower(F.trim(attribute(t, "rel"))).alias("rel"), F.trim(attribute(t, "href")).alias("href"))
    )
    fit = F.filter(links, lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "canonical") & (x["href"] != ""))
    # Most pages are told by one look for the word.
    return F.when(F.lower(html).contains("canonical"), F.get(fit, F.lit(0))["href"])
