"""Session settings the jobs rely on."""

from pyspark.sql import SparkSession

# Half-open date ranges and ISO weeks are computed in one explicit zone; joins
# that meet a hot key are split by AQE at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name="brisktill", master=None, **overrides) -> SparkSession:
    """A session with the settings above; `overrides` use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    settings.update({key.replace("__", "."): str(value) for key, value in overrides.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
