"""tidymer: Spark-native operators on sequences, vectors, profiles and graphs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


#: Bytes of an Arrow batch, where the session sets none: ten thousand rows of long texts would take hundreds of megabytes in the JVM and in Python.
BATCH = "4m"


def ship(spark) -> None:
    """Send this package to the executors' Python, once for a context, so that it need not be installed there; bound Arrow batches by bytes."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if getattr(sc, "_tidymer_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="tidymer-"), "tidymer.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    sc._tidymer_shipped = True
