"""A Spark session for local work; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local(cores: str = "*", memory: str = "4g", **conf) -> SparkSession:
    os.environ["PYTHONPATH"] = ":".join([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(":"))])
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",  # of sources written in Python
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where that is unset and Spark runs in one process, a temporary folder serves; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fixwave-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
