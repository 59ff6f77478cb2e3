"""Sends this package to the executors, so that Python functions of operators find it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application; what is sent is the code of the running driver."""
    sc = spark.sparkContext
    if getattr(sc, "_reelforge_shipped", None) is None:
        top = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="reelforge-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        sc.addPyFile(str(packed))
        sc._reelforge_shipped = packed
