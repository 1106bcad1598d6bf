"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH, PLAN_TEXT = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.maxPlanStringLength"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: the driver serves it to them once per context.

    Where the session keeps Spark's own number of rows in an Arrow batch, it is lowered, as texts
    are long, and so is the length of plans' texts, as plans with tables as literals are kept.
    """
    if spark.conf.get(PLAN_TEXT) == "2147483632b":  # as Spark has it
        spark.conf.set(PLAN_TEXT, "100000")
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    context = spark.sparkContext
    if not getattr(context, "_evidra_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="evidra-code-")) / "evidra_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._evidra_shipped = True
    return spark
