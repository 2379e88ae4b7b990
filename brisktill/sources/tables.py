"""Reading and writing tables, and publishing a consistent set of them."""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ..schemas import TABLES

_VERSIONS = "_versions"
_CLAIMS = "_claims"
_VERSION_SCHEMA = "version long, tables map<string, array<string>>"


def read_table(spark, path, name, fmt="parquet"):
    """A table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def read_tables(spark, root, names=tuple(TABLES), fmt="parquet"):
    return {name: read_table(spark, f"{root}/{name}", name, fmt) for name in names}


def read_jdbc(spark, url, name, bounds=None, partitions=64, **options):
    """A table over JDBC, cut by id range into parallel reads when `bounds` (low, high) is given.

    The driver for the database has to be on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if bounds:
        low, high = bounds
        reader = reader.options(
            partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=partitions
        )
    return reader.load()


def append_rows(df, path, fmt="parquet"):
    df.write.mode("append").format(fmt).save(path)


def write_json(df, path):
    """Rows as JSON documents, nested columns included."""
    df.write.mode("errorifexists").json(path)


def as_json(df, name="document"):
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def published_version(spark, root):
    """The newest published version, or None before the first."""
    path = f"{root}/{_VERSIONS}"
    if not _exists(spark, path):
        return None
    folder, files = _hadoop(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    for version in sorted((int(name) for name in names if name.isdigit()), reverse=True):
        if _exists(spark, f"{path}/{version}/_SUCCESS"):
            return version
    return None


def _entry(spark, root, version):
    return spark.read.schema(_VERSION_SCHEMA).json(f"{root}/{_VERSIONS}/{version}").first()["tables"]


def read_published(spark, root, version=None):
    """The tables of a published version, the newest by default."""
    version = published_version(spark, root) if version is None else version
    listed = _entry(spark, root, version)
    return {name: spark.read.parquet(*[f"{root}/{path}" for path in paths]) for name, paths in listed.items()}


class VersionTaken(RuntimeError):
    """Another writer is publishing, or has published, this version."""


def _claim(spark, root, version, owner, takeover):
    """Take the version for `owner` by a marker that only one writer can create."""
    target, files = _hadoop(spark, f"{root}/{_CLAIMS}/{version}")
    try:
        out = files.create(target, takeover)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        if spark.read.text(f"{root}/{_CLAIMS}/{version}").first()[0] == owner:
            return
        raise VersionTaken(f"version {version} of {root} is another writer's") from None
    out.write(owner.encode())
    out.close()


def publish(spark, root, replaced, appended=None, version=None, owner=None, takeover=False):
    """Write tables to a fresh version and only then announce it.

    `replaced` tables are written whole; of `appended` tables only the new rows
    are written, next to the files the version before points at. Tables named
    in neither stay as they were. Readers see all of a version or none of it: it
    counts once its entry exists, and the entry is written last. A failed
    attempt leaves files nobody reads; trying the same version again replaces
    them, and a version that is already announced is left alone.

    A version belongs to the writer that claims it first, by a marker made before
    anything is written; a second writer gets `VersionTaken` and has written
    nothing. Without a version each call is a writer of its own, and `takeover` takes the next version from one
    that broke off; with a version the writer is `owner`, or whoever names the
    version, and may try again. The store has to create files exclusively (HDFS and local files do).
    """
    owner = owner or (uuid.uuid4().hex if version is None else f"version {version}")
    last = published_version(spark, root) if version is None else _before(spark, root, version)
    if version is None:
        version = (last or 0) + 1
    if _exists(spark, f"{root}/{_VERSIONS}/{version}/_SUCCESS"):
        return version
    _claim(spark, root, version, owner, takeover)
    paths = dict(_entry(spark, root, last)) if last else {}
    for name, df in {**replaced, **(appended or {})}.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
        kept = [] if name in replaced else list(paths.get(name, []))
        paths[name] = [*kept, f"{version}/{name}"]
    entry = spark.createDataFrame([(version, paths)], _VERSION_SCHEMA)
    entry.coalesce(1).write.mode("overwrite").json(f"{root}/{_VERSIONS}/{version}")
    return version


def _before(spark, root, version):
    newest = published_version(spark, root)
    return newest if newest is None or newest < version else version - 1


def compact(spark, root, names):
    """Publish tables again in one piece, after many versions have appended to them."""
    tables = read_published(spark, root)
    return publish(spark, root, {name: tables[name] for name in names})


def _hadoop(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, path):
    target, files = _hadoop(spark, path)
    return files.exists(target)
