"""Session defaults: UTC, ANSI errors, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the query semantics rely on; performance settings stay with the caller.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "gristmill", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster pass its own master and partitions."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
