"""A session with the engine's defaults; an existing session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime re-planning, Arrow transfer and UTC; partition sizes are left to adaptive execution.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def share_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package, whatever folder or path the driver was started with.

    On a cluster the package is installed or sent with the job; a folder that is not there is passed over.
    """
    import os

    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
