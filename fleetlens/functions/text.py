"""Text identity rules: logins, canonical category keys, cleaned identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"^\{[^{}]+\}$"  # an unresolved "{template}" is not an identifier


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_if_blank(value: Column | str) -> Column:
    """Text with outer spaces removed; blank becomes null.

    ``nullif`` mentions its input once. Helpers that repeat their input double the
    expression each time they are nested, until it is too large to compile.
    """
    return F.nullif(F.trim(as_col(value).cast("string")), F.lit(""))


def strip_all(value: Column | str) -> Column:
    """Remove every kind of leading and trailing white space, not only spaces."""
    return F.regexp_replace(as_col(value).cast("string"), r"^\s+|\s+$", "")


def login_norm(value: Column | str) -> Column:
    return F.lower(F.trim(as_col(value)))


def has_text(value: Column | str) -> Column:
    """True for a non-null value with at least one non-space character, never null."""
    return F.coalesce(F.length(F.trim(as_col(value).cast("string"))) > 0, F.lit(False))


def canonical(value: Column | str) -> Column:
    """Join key for categories and message types: ``Visual Recipes`` -> ``visual_recipes``."""
    text = F.translate(F.lower(F.trim(as_col(value))), " -", "__")
    return F.regexp_replace(text, "_+", "_")


def clean_identifier(value: Column | str) -> Column:
    """Trimmed identifier; blanks and ``{placeholders}`` become null."""
    text = F.regexp_replace(F.trim(as_col(value).cast("string")), PLACEHOLDER, "")
    return F.nullif(text, F.lit(""))


def first_text(*values: Column | str) -> Column:
    """First non-blank of several columns, in order."""
    return F.coalesce(*[null_if_blank(v) for v in values])


def slug(name: str) -> str:
    """Driver-side token for configuration keys (column names, module names)."""
    return re.sub(r"[^A-Za-z0-9]+", "_", str(name).strip()).strip("_")


def sanitize_name(name: str) -> str:
    """Column-name form: other characters to ``_``, runs collapsed, lower case."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]+", "_", name)).strip("_").lower()


def path_segment(url: Column | str, marker: str) -> Column:
    """Path component right after ``marker``, ignoring query string and fragment."""
    path = F.substring_index(F.substring_index(as_col(url).cast("string"), "?", 1), "#", 1)
    after = F.split_part(F.split_part(path, F.lit(marker), F.lit(2)), F.lit("/"), F.lit(1))
    return null_if_blank(after)


def row_id(*columns: Column | str) -> Column:
    """Stable md5 id over ``|``-joined keys (null keys are skipped by concat_ws)."""
    return F.md5(F.concat_ws("|", *[as_col(c) for c in columns]))
