"""Column contracts of the normalised layer. Types are assigned by column name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Columns typed by name, everything else is stripped text.
DATETIME_COLUMNS = [
    "timestamp", "date", "run_timestamp", "dssstartuptimestamp", "creationdate", "lastsuccessfullogin", "lastfailedlogin",
    "last_session_activity", "lastsessionactivity", "npssurveysettings_nextaction", "atsurveysettings_nextaction",
    "first_commit_date", "last_commit_date", "creationtag_lastmodifiedon", "project_versiontag_lastmodifiedon",
    "project_creationtag_lastmodifiedon", "dataset_versiontag_lastmodifiedon", "dataset_creationtag_lastmodifiedon",
    "recipes_versiontag_lastmodifiedon", "recipes_creationtag_lastmodifiedon", "agents_versions_versiontag_lastmodifiedon",
    "agents_versions_creationtag_lastmodifiedon", "knowledge_banks_versiontag_lastmodifiedon",
    "knowledge_banks_creationtag_lastmodifiedon", "scenarios_start", "scenarios_nextrun", "scenarios_createdon",
    "scenarios_lastmodifiedon", "trial_granted_on", "trial_expires_on",
]
NUMERIC_COLUMNS = [
    "level_1_size", "level_2_size", "level_3_size", "size", "used", "available", "used_pct", "calltime", "osversion",
    "project_versiontag_versionnumber", "project_creationtag_versionnumber", "dataset_versiontag_versionnumber",
    "dataset_creationtag_versionnumber", "recipes_maxrunningactivities", "recipes_versiontag_versionnumber",
    "recipes_creationtag_versionnumber", "knowledge_banks_versiontag_versionnumber", "knowledge_banks_creationtag_versionnumber",
    "agents_versions_versiontag_versionnumber", "agents_versions_creationtag_versionnumber", "viewing_actions_count",
    "developing_actions_count",
]
BOOLEAN_COLUMNS = [
    "project_tutorialproject", "dataset_managed", "dataset_featuregroup", "recipes_neverrecomputeexistingpartitions",
    "recipes_redispatchpartitioning", "recipes_params_enginerecommended", "scenarios_active", "scenarios_unavailable",
    "scenarios_markedastest", "scenarios_running", "enabled", "addon_enabled", "has_license", "valid", "expired", "community",
    "trial_exists", "trial_valid", "trial_expired", "trial_illegal", "is_mau_eligible",
]
UPPER_COLUMNS = ["severity", "msgtypebase", "activity_category", "authsource", "sourcetype", "dataset_type", "nodetype", "rawnodetype"]

PARTITION_COLUMNS = ["category", "module", "instance_name", "year", "month", "day"]


def union_contract(*lists: list[str]) -> list[str]:
    """Base list plus per-module variant, first occurrence kept."""
    return list(dict.fromkeys(c for columns in lists for c in columns))


@dataclass(frozen=True)
class Contracts:
    """Required columns by (category, module), with variants of a base.

    The lists are data of an installation: a table with one row per column (category, module,
    variant or null, position, column_name), as many rows as all contracts have columns.
    """

    lists: dict[tuple[str, str, str | None], list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, table: DataFrame) -> Contracts:
        rows = table.select("category", "module", "variant", "position", "column_name").collect()
        lists: dict[tuple[str, str, str | None], list[str]] = {}
        for row in sorted(rows, key=lambda r: r.position):
            lists.setdefault((row.category, row.module, row.variant), []).append(row.column_name)
        return cls(lists)

    def required(self, category: str, module: str, *, base: tuple[str, str] | None = None, variant: str | None = None) -> list[str] | None:
        """Columns of the base, then those only the variant has; None where neither is known.

        ``base`` names another (category, module) whose list the module shares.
        """
        own = base or (category, module)
        found = [self.lists.get((*own, None)), self.lists.get((*own, variant)) if variant else None]
        present = [columns for columns in found if columns is not None]
        return union_contract(*present) if present else None
