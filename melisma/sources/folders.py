"""Folders that all machines of a session see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where that is unset, the warehouse on a cluster, a temporary one in a single
    process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="melisma-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/melisma-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_folder(spark: SparkSession, kind: str = "plans") -> str:
    """The name of a new folder there."""
    return f"{shared_top(spark)}/{kind}/{uuid.uuid4().hex}"
