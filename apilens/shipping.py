"""Make this package importable on executors."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.cache
def package_archive() -> str:
    """The package as a zip file on the driver's disk, from where Spark hands it to executors."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="apilens-package-")) / "apilens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    return str(archive)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of the session's application, once."""
    application = spark.conf.get("spark.app.id", "")
    if application not in _SHIPPED:
        spark.addArtifacts(package_archive(), pyfile=True)
        _SHIPPED.add(application)
    return spark
