"""Fixed dimension rows and configuration tables.

These lists are part of the semantics (they decide which rows count as what), are
bounded by construction, and are the only frames the library broadcasts by hint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.text import slug

# Capability -> (order, label, is development, [(category, label), ...]).
CAPABILITIES = [
    ("advanced_analytics_ml", 1, "Advanced Analytics & ML", False, [
        ("statistic_analytics", "Statistics & Analytics"),
        ("mlops", "Machine Learning & Operations"),
    ]),
    ("apis_integration", 2, "APIs & Integration", False, [
        ("apis", "APIs"),
    ]),
    ("applications_delivery", 3, "Applications & Delivery", False, [
        ("application_designer", "Application Designer"),
        ("webapps", "Web Applications"),
        ("charts_dashboard", "Charts & Dashboards"),
        ("workspaces", "Workspaces"),
    ]),
    ("automation_orchestration", 4, "Automation & Orchestration", False, [
        ("automation", "Automation"),
        ("deployer", "Deployer"),
        ("scenarios", "Scenarios"),
    ]),
    ("data_engineering", 5, "Data Engineering", True, [
        ("coding", "Coding"),
        ("misc_recipes", "Misc Recipes"),
        ("visual_recipes", "Visual Recipes"),
        ("prepare", "Prepare"),
    ]),
    ("project_maintenance", 6, "Project Maintenance", True, [
        ("projects", "Projects"),
        ("flow", "Flow"),
        ("datasets", "Datasets"),
        ("dataset", "Datasets"),
        ("folders", "Folders"),
        ("wiki_artical_discussions", "Wiki / Articles / Discussions"),
        ("git", "Git"),
    ]),
    ("genai_llm", 7, "GenAI & LLM", False, [
        ("genai_llm", "Generative AI & LLM"),
    ]),
    ("uncategorized", 99, "Uncategorized", False, [
        ("administration", "Administration"),
        ("containers", "Containers"),
        ("govern", "Governance"),
        ("plugins", "Plugins"),
        ("reading_listing", "Reading & Listing"),
        ("user_maintenance", "User Maintenance"),
        ("other", "Other"),
    ]),
]

# Message types by activity class.
EVENT_CLASSES = {
    "meaningful_action": [
        "sql-query-start",
        "sql-notebook-execute",
        "sql-notebook-save",
        "recipe-save",
        "recipe-create",
        "recipe-delete",
        "recipe-edit-in-notebook",
        "notebook-create",
        "dataset-create",
        "dataset-save",
        "dataset-save-schema",
        "dataset-editable-save",
        "dataset-delete",
        "dataset-rename",
        "dataset-export",
        "dataset-upload-create-uploadbox",
        "dataset-upload-add-file-uploadbox",
        "dataset-upload-add-file",
        "dataset-upload-remove-file",
        "dataset-table-ddl",
        "code-studio-object-create",
        "code-studio-template-create",
        "code-studio-template-save",
        "code-studio-template-delete",
        "code-studio-template-export",
        "code-studio-object-open-file",
        "code-studio-object-restart",
        "code-studio-object-stop",
        "code-studio-object-try-restart-server",
        "code-studio-template-build",
        "jupyter-git-commit-file",
        "jupyter-git-commit-checkpoint",
        "start-project-explanation",
        "start-dataset-explanation",
        "start-code-explanation",
    ],
    "polling_status": [
        "code-studio-protected-view",
        "code-studio-object-state",
        "code-studio-backend",
        "code-studio-current-users",
        "code-studio-template-logs",
        "code-studio-standalone-view",
        "code-studio-template-usage",
        "mlflow-experiments-search",
        "jupyter-notebook-sessions",
        "sql-query-verify",
        "sql-query-fetch",
        "sql-query-started",
        "dataset-compute-status",
        "dataset-test",
        "dataset-detect-partitioning",
        "recipe-check-notebook-edition",
    ],
    "system_unattributed": [
        "jupyter-create-kernel-context",
        "jupyter-delete-kernel-context",
    ],
}

# Verb bases and words that decide whether a UI action develops something.
MUTATING_BASES = [
    "action", "add", "admin", "create", "delete", "edit", "import", "run", "save", "update", "upload",
]
ACTION_WORDS = [
    "save", "create", "analysis", "clear", "run", "edit", "update", "upload", "import", "export",
    "build", "train", "deploy", "publish", "execute", "compute", "recipe", "scenario", "notebook",
    "webapp", "dashboard", "api", "app", "flow", "plugin", "code-env", "codeenv", "settings",
    "rename", "delete", "move", "copy", "duplicate", "sync", "git", "commit", "schema", "partition",
]
REMOVE_WORDS = [
    "list", "dataset-clear-samples", "dataset-save-schema", "project-save-variables", "get", "read",
    "open", "preview", "view", "explore", "sample", "status", "summary", "timeline", "search",
    "recent", "details", "read-meta", "read-data", "read-schema",
]

# Modules feeding the development and the object activity facts.
DEVELOPMENT_MODULES = ["dataset", "visual_recipes", "coding", "mlops", "genai_llm"]
OBJECT_MODULES = ["datasets", "visual_recipes", "apis", "webapps", "charts_dashboard", "application_designer"]

# Licence profiles with a column of their own in the wide limits table.
LICENSE_PROFILES = [
    "full_designer", "designer", "full_user", "regular_user", "power_user",
    "advanced_analytics_designer", "data_designer", "data_engineer", "data_analyst",
    "data_scientist", "statistician", "analyst", "business_analyst", "business_user",
    "designer_expert", "governance_manager", "governance_user", "reader", "viewer",
    "ai_consumer", "ai_access_user", "ai_governance_user", "discoverer", "explorer", "monitor",
    "technical_account", "administrator", "admin", "project_admin", "no_code_app_builder",
    "no_code_designer",
]

# Product vocabulary. A packaged application is called plainly "application".
PRODUCT_TYPES = [
    "agent_tool", "api_service", "api_endpoint", "agent", "dashboard", "insight",
    "retrieval_augmented_llm", "saved_model", "web_application", "application",
]
STATIC_PRODUCT_TYPES = ["api_endpoint", "agent", "dashboard", "web_application", "application"]
CONSUMPTION_TYPES = [
    "agent_tool", "api_service", "dashboard", "application", "insight",
    "retrieval_augmented_llm", "saved_model", "web_application",
]


def literal_table(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """Constant table held in the plan itself, so Catalyst knows its size; larger dimensions come from storage."""
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in columns.items()])
    arrays = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def unique_keys(rows: list[tuple], what: str) -> list[tuple]:
    """Reject two rows whose first field is the same key after normalisation."""
    seen: set[str] = set()
    for row in rows:
        key = slug(row[0]).lower()
        if key in seen:
            raise ValueError(f"duplicate {what} key: {key}")
        seen.add(key)
    return rows


def capability_rows() -> list[tuple]:
    return [
        (category, capability, order, position, label, category_label, is_dev)
        for capability, order, label, is_dev, categories in CAPABILITIES
        for position, (category, category_label) in enumerate(categories, start=1)
    ]


def event_class_rows() -> list[tuple]:
    return [
        (slug(msgtype), name, name == "meaningful_action")
        for name, msgtypes in EVENT_CLASSES.items()
        for msgtype in msgtypes
    ]


def dim_capability(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Category to capability; pass ``rows`` to use another taxonomy."""
    columns = {
        "activity_category": "string",
        "capability": "string",
        "capability_order": "int",
        "category_order": "int",
        "capability_label": "string",
        "category_label": "string",
        "is_dev_activity": "boolean",
    }
    return literal_table(spark, columns, unique_keys(rows or capability_rows(), "category"))


def dim_event_class(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Message type to activity class and whether it counts as meaningful."""
    columns = {"msgtype": "string", "activity_class": "string", "is_meaningful_activity": "boolean"}
    return literal_table(spark, columns, unique_keys(rows or event_class_rows(), "msgtype"))
