"""The Spark session that the engine's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, because results are compared with engines that know no session zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("chatloom").config(map=SETTINGS | (settings or {}))
    return (builder.master(master) if master else builder).getOrCreate()
