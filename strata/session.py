"""Session helpers shared by every entry point."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session.

    Python workers import the parse functions by name.  ``addPyFile`` makes
    that work on a cluster where the package is not installed.
    """
    context = spark.sparkContext
    if getattr(context, "_strata_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="strata-ship-")) / "strata_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = Path(folder) / name
                    out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(archive))
    context._strata_shipped = True
