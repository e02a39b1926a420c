"""Build oracle statements from shared, named sub-queries.

``sql(body)`` prefixes ``body`` with every named sub-query it mentions, directly or
through another one, so each registered statement is self-contained.
"""

from __future__ import annotations

import re

from checks.adapters import ADAPTERS, duckdb_sql
from fleetlens.functions.entitlement import GROUP_LABELS, LICENSE_GROUPS, OTHER_LABEL
from fleetlens.plans import dims

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
RECENT = "timestamp >= TIMESTAMP '2024-01-01 00:00:00'"


def values(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def canon(c: str) -> str:
    return f"regexp_replace(replace(replace(lower(trim({c})), ' ', '_'), '-', '_'), '_+', '_', 'g')"


def blank_null(c: str) -> str:
    return f"nullif(trim({c}), '')"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def group_case(c: str) -> str:
    whens = " ".join(
        f"WHEN upper(trim(coalesce({c}, ''))) IN {in_list(LICENSE_GROUPS[g])} THEN '{label}'" for g, label in GROUP_LABELS.items()
    )
    return f"CASE {whens} ELSE '{OTHER_LABEL}' END"


def norm_profile(c: str) -> str:
    return f"upper(regexp_replace(coalesce(trim({c}), 'UNKNOWN'), '[^A-Za-z0-9]+', '', 'g'))"


CTES: dict[str, str] = {name: duckdb_sql(name) for name in ADAPTERS}

CTES["d_capability"] = values(
    dims.capability_rows(),
    ["activity_category", "capability", "capability_order", "category_order", "capability_label", "category_label", "is_dev_activity"],
)
CTES["d_event_class"] = values(dims.event_class_rows(), ["msgtype", "activity_class", "is_meaningful_activity"])


def sql(body: str) -> str:
    ordered: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for name in CTES:
            if name in stack or name in ordered:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name], (*stack, name))
                ordered.append(name)

    visit(body, ())
    if not ordered:
        return body
    prefix = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in ordered)
    return f"WITH {prefix}\n{body.strip()}"
