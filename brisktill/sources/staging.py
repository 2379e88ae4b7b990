"""Intermediate tables that several results are computed from."""

import tempfile
import uuid

from pyspark.sql import Observation

_FOLDER = "spark.checkpoint.dir"


def _folder(spark):
    folder = spark.conf.get(_FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_FOLDER} to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brisktill-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark):
    """A fresh path in the shared folder."""
    return f"{_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df):
    """Compute `df` once, as a table in the cluster's shared checkpoint folder, and go on from there.

    Unlike a cached frame the table outlives lost executors, and unlike an RDD
    checkpoint it is columnar: later reads take only the columns they need and
    its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_counting(df, counts):
    """`staged`, and a dict of the aggregates `counts` (name -> column) over its rows, taken by the same write.

    The tasks that write the rows count them, and Spark adds up each finished
    task once, so a task that is run again counts once. A count that no row
    was seen for is 0.
    """
    seen = Observation()
    table = staged(df.observe(seen, *[column.alias(name) for name, column in counts.items()]))
    found = seen.get
    return table, {name: found.get(name) or 0 for name in counts}
