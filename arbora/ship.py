"""Ships this package to the executors, so that functions run there can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package, served by Spark itself."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="arbora-")) / "arbora-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"{here.name}/{f.relative_to(here)}")
        spark.sparkContext.addPyFile(str(path))
