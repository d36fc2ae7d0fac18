"""Session defaults. A session that already exists keeps its own settings."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and skew-join splitting on."""
    # Workers run the interpreter of the driver, not whatever wrapper comes first on the path.
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
