"""Sends this package to the executors, so that Python tasks find it wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once; one that was submitted as a file is there already."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_incidara_shipped", False) or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="incidara-"), "incidara.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._incidara_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose session's executors have the package."""
    ship(df.sparkSession)
    return df
