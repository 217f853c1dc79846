"""The package's code, sent to the executors once per application as a Python archive.

Objects in broadcasts and caches that live as long as a Python worker need importable modules there.
"""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

import sitequarry
from sitequarry.operators.lineage import checkpoint_root

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package on the executors' path; the archive lies in the shared checkpoint folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(sitequarry.__file__)
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{checkpoint_root(spark)}/sitequarry-{context.applicationId}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(archive.getvalue())
    stream.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)
