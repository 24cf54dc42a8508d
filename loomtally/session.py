"""Session settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC clocks, and the last of repeated keys in a JSON object."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; a local one only where none is named (tests)."""
    from tempfile import mkdtemp
    from uuid import uuid4

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + mkdtemp(prefix="loomtally-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/loomtally/{name}-{uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package once per application, for tasks that run Python."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_loomtally_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="loomtally-"))
    shutil.copytree(package, folder / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "tree", package.name))
    sc._loomtally_shipped = True
