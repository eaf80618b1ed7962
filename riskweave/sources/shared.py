"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder for files that tasks write and the driver reads, or the other way round: in ``spark.checkpoint.dir``, or, where
    that is unset and the session is local, a temporary one."""
    found = urlsplit(spark.conf.get("spark.checkpoint.dir", None) or "")
    if found.path and found.scheme in ("", "file"):
        Path(found.path).mkdir(parents=True, exist_ok=True)
        return tempfile.mkdtemp(prefix="riskweave-", dir=found.path)
    if not spark.sparkContext.master.startswith("local"):
        raise OSError("set spark.checkpoint.dir to a mounted folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="riskweave-")
