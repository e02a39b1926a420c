"""Licence profile vocabulary: groups, filters and the normalised profile key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import as_col

# Licence profiles by group.
LICENSE_GROUPS = {
    "license_creator": [
        "DATA_SCIENTIST",
        "DATA_ANALYST",
        "DESIGNER",
        "VISUAL_DESIGNER",
        "DATA_DESIGNER",
        "ADVANCED_ANALYTICS_DESIGNER",
        "FULL_DESIGNER",
    ],
    "license_consumer": ["READER", "EXPLORER", "AI_CONSUMER", "AI_ACCESS_USER", "GOVERNANCE_MANAGER"],
    "license_admin": ["PLATFORM_ADMIN", "TECHNICAL_ACCOUNT"],
}
GROUP_LABELS = {
    "license_creator": "Creator Licenses",
    "license_consumer": "Consumer Licenses",
    "license_admin": "Admin Licenses",
}
OTHER_LABEL = "Other Licenses"
FILTER_ALIASES = {
    "exclude_consumer": "no_consumer",
    "exclude-consumer": "no_consumer",
    "non_consumer": "no_consumer",
    "non-consumer": "no_consumer",
    "exclude_readers": "no_consumer",
    "creator": "license_creator",
    "creators": "license_creator",
    "consumer": "license_consumer",
    "consumers": "license_consumer",
}


def _profile_key(profile: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(as_col(profile))), F.lit(""))


def license_filter(profile: Column | str, name: str | None = None) -> Column:
    """Boolean column for a named licence filter; an unknown name keeps everything."""
    name = FILTER_ALIASES.get((name or "").strip().lower(), (name or "").strip().lower())
    key = _profile_key(profile)
    if name in LICENSE_GROUPS:
        return key.isin(LICENSE_GROUPS[name])
    if name == "no_consumer":
        return ~key.isin(LICENSE_GROUPS["license_consumer"])
    if name == "license_other":
        return ~key.isin([p for group in LICENSE_GROUPS.values() for p in group])
    return F.lit(True)


def license_group(profile: Column | str) -> Column:
    key = _profile_key(profile)
    label = F.lit(OTHER_LABEL)
    for group, profiles in LICENSE_GROUPS.items():
        label = F.when(key.isin(profiles), GROUP_LABELS[group]).otherwise(label)
    return label


def normalize_profile(profile: Column | str) -> Column:
    """Spelling-insensitive profile key: upper case, letters and digits only."""
    text = F.coalesce(F.trim(as_col(profile)), F.lit("UNKNOWN"))
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))
