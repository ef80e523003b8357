"""Dirty labels made one: sources, languages, kinds of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip_space


def slug(c: Column) -> Column:
    """Case, outer space and ``_`` or blanks for ``-`` aside; null for null or blank."""
    return F.nullif(F.regexp_replace(F.lower(strip_space(c)), r"[_\s]+", "-"), F.lit(""))


def source(c: Column) -> Column:
    return F.coalesce(slug(c), F.lit("unknown"))


def language(c: Column) -> Column:
    """The primary subtag: ``en-XX``, ``EN`` and `` en`` are ``en``; ``und`` and null are ``unknown``."""
    tag = F.split(slug(c), "-", 2)[0]
    return F.when(tag.isNull() | tag.isin("und", "unknown", "mul", "zxx"), F.lit("unknown")).otherwise(tag)


def domain(c: Column) -> Column:
    return F.coalesce(slug(c), F.lit("unknown"))
