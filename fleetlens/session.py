"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or the shape of plans. They are runtime SQL
# settings, so they can also be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Partition values stay as written: month 01 is not 1 and instance 007 is not 7.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Longer generated methods are never compiled by HotSpot. Rules with many cases (object identity) made such
    # methods, and their rows were interpreted; above the limit Spark generates smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())
