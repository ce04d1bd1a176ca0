"""Labels and sources: their spellings, and rows that lack them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paigham import lexicon
from paigham.functions.text import lookup, strip


def canonical_label(c: Column) -> Column:
    """The label a spelling stands for, null for others."""
    return lookup(lexicon.LABEL_SPELLINGS)[F.lower(strip(c))]


def canonical_source(c: Column) -> Column:
    """The source a spelling stands for; unknown ones stay, stripped; blank is null."""
    stripped = strip(c)
    return F.when(stripped != "", F.coalesce(lookup(lexicon.SOURCE_SPELLINGS)[F.lower(stripped)], stripped))


def is_missing_text(c: Column) -> Column:
    return c.isNull()


def is_empty_text(c: Column) -> Column:
    return c.isNotNull() & (strip(c) == "")


def is_missing_label(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin("", "nan", "none")


def is_invalid_label(c: Column) -> Column:
    """Present, but no spelling of a label."""
    return ~is_missing_label(c) & canonical_label(c).isNull()


def is_bad_label(c: Column) -> Column:
    """Of a normalised label: not one of the two; null is bad."""
    return ~F.coalesce(c.isin(*lexicon.LABELS), F.lit(False))
