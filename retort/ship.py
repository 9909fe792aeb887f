"""Makes this package importable on the executors of a session that was started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


#: Rows and bytes of an Arrow batch where the session has Spark's defaults; texts can be long, and a batch is held whole.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session once, which executors fetch from the driver, and bounds Arrow batches."""
    for setting, (default, ours) in ARROW_LIMITS.items():
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, ours)
    context = spark.sparkContext
    if getattr(context, "_retort_shipped", False):
        return
    place = Path(tempfile.mkdtemp(prefix="retort-ship-")) / "retort_package.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_ROOT / "retort"):
            for name in sorted(names):
                if name.endswith((".py", ".txt")):
                    full = Path(folder) / name
                    archive.write(full, full.relative_to(_ROOT))
    context.addPyFile(str(place))
    context._retort_shipped = True
