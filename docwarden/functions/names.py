"""Names of documents and what is compared of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def output_name(text: Column) -> Column:
    """Name that is safe as a folder: lower case, other characters as single dashes, none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), "-{2,}", "-")
    trimmed = F.regexp_replace(dashed, r"^[-._]+|[-._]+$", "")
    return F.when(trimmed == "", F.lit("unnamed-skill")).otherwise(trimmed)


def similar_form(text: Column) -> Column:
    """Form in which names are compared: lower case, other characters than letters and digits as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def similar_form_of(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.strip().lower()).strip("-")


def finding_id(*parts: Column) -> Column:
    """First 16 digits of the SHA-256 of the parts joined by bars; null is spelled None."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)
