"""Make this package importable where Python workers run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to every executor, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_mercato_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="mercato-ship-")) / "mercato_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._mercato_shipped = True
