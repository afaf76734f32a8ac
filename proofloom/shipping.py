"""The package's code on the executors, wherever the driver imported it from."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark's file server once per application, so Python workers need no installed copy."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    with tempfile.NamedTemporaryFile(prefix="proofloom-", suffix=".zip", delete=False) as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(f.name)
    _shipped.add(app)
