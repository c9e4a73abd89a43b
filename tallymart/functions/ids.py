"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_uuid(digits: Column) -> Column:
    """32 hex digits with hyphens put in."""
    return F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def canonical_uuid(text: Column) -> Column:
    """Any accepted spelling (braces, URN prefix, no hyphens, upper case) in canonical form, else NULL.

    Nearly all ids are canonical already; only the others are taken apart.
    """
    bare = F.regexp_replace(text, r"urn:|uuid:", "")
    digits = F.lower(F.regexp_replace(bare, r"^[{}]+|[{}]+$|-", ""))
    return F.when(text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), text).otherwise(
        F.when(digits.rlike("^[0-9a-f]{32}$"), hex_to_uuid(digits))
    )


def api_key_digest(key: Column) -> Column:
    return F.sha2(key, 256)
