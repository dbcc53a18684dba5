"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode, and so Python's str.strip, treats as white space (29 of them, all below U+3001).
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_WHITESPACE_RUN = "[" + "".join(f"\\x{{{ord(char):x}}}" for char in WHITESPACE) + "]+"


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, from both ends; linear in the text."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.filter(F.split(text, _WHITESPACE_RUN), lambda word: word != "")


def present(text: Column) -> Column:
    """True where the text is neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def or_null(text: Column) -> Column:
    """The text, with '' turned into null."""
    return F.nullif(text, F.lit(""))


def title_key(title: Column) -> Column:
    """Lower-cased ASCII letters and digits of the title, null when none are left."""
    return or_null(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""))


def doi_key(doi: Column) -> Column:
    """Lower-cased, stripped DOI, null when absent."""
    return or_null(strip(F.lower(doi)))


def paper_id(source: Column, external_id: Column) -> Column:
    """Stable id: source, underscore, external id with every slash turned into an underscore."""
    return F.concat(source, F.lit("_"), F.translate(external_id, "/", "_"))


def id_list(ids: Column) -> Column:
    """Comma-separated ids as an array: stripped, empties dropped, order and repeats kept."""
    return F.filter(F.transform(F.split(ids, ","), strip), lambda item: item != "")


def clean_names(names: Column) -> Column:
    """Stripped, non-empty, distinct and sorted; null counts as no names."""
    stripped = F.filter(F.transform(names, strip), lambda name: name != "")
    return F.coalesce(F.sort_array(F.array_distinct(stripped)), F.array().cast("array<string>"))
