"""Session factory: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """An existing session, or a new one with the settings that the operators assume.

    Keyword names use two underscores for a dot, e.g. ``spark__driver__memory="8g"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that do not have it installed."""
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/spanloom", "zip", root, "spanloom")
    spark.sparkContext.addPyFile(archive)
