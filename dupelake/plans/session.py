"""Session helpers for local runs, tests and the benchmark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_code() -> None:
    """Send the package's functions with the tasks, for sessions started without ``--py-files``."""
    cloudpickle.register_pickle_by_value(sys.modules["dupelake"])


def local_session(cores: int | str = "*", name: str = "dupelake", partitions: int = 8, **conf) -> SparkSession:
    ship_code()
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
