"""Helpers the operators of this folder share."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from pressline.session import work_folder

Batches = Iterator[pa.RecordBatch]
SLICE_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once per application, so that no executor needs an installed copy."""
    _shipped(spark.sparkContext.applicationId, spark.sparkContext)


@functools.lru_cache(maxsize=8)
def _shipped(application: str, context) -> str:
    import pressline

    root = os.path.dirname(os.path.abspath(pressline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pressline-code-"), "pressline_code.zip")
    with zipfile.ZipFile(path, "w") as made:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    made.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; the operators' code is sent along before anything runs on it."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table below the shared folder and reads it: later plans know its size, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def plus(df: DataFrame, *fields: tuple[str, DataType]) -> StructType:
    """The schema of ``df`` with more fields; ``df.schema`` itself stays as it is."""
    return StructType([*df.schema.fields, *[StructField(name, kind) for name, kind in fields]])


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of an Arrow column one at a time; no second copy of the whole batch."""
    return (x.as_py() for x in column)


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """A ``mapInArrow`` function from a function on a few rows: a batch is handed over in slices, so little of what is made of
    it is held at a time."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield make(batch.slice(start, SLICE_ROWS))

    return run


def by_whole_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """As ``by_batch`` without slices, for work that is cheaper on many rows."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run
