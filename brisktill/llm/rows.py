"""Small helpers shared by the operators."""

import itertools

import pyarrow as pa
from pyspark.sql import functions as F

# Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value, body):
    """`body` of a column that is evaluated once for the row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def free_names(df, *names):
    """`names`, lengthened until none is a column of `df` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df, function, schema):
    """`mapInArrow` where `function` takes one batch and returns a list of columns in the order of `schema`.

    Batches hold a bounded number of rows; an empty partition gives no rows.
    """
    names = [field.name for field in schema]
    types = [_arrow(field.dataType) for field in schema]

    def run(batches):
        work = function()
        for batch in batches:
            if batch.num_rows:
                columns = [
                    c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(work(batch), types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(values, size):
    """Consecutive lists of `size` values, the last one shorter."""
    values = iter(values)
    while part := list(itertools.islice(values, size)):
        yield part
