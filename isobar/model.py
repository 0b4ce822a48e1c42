"""The data model: tables and meshes as DataFrames.

A table is a DataFrame. A mesh is a long DataFrame with a row for each time step and cell: step, time, the
indices k, j, i, the coordinates z, y, x (kept beside the indices: they compress to next to nothing in
columnar files, and no operator needs a join to see them) and a column for each variable. Missing values
are NULL; fill values become NULL at the scan and return only on export. Attributes of a variable (units,
calendar, fill value ...) are in the metadata of its field.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type codes of typed CSV headers (fixed values).
TYPE_CODES: dict[int, T.DataType] = {
    1: T.ByteType(), 2: T.ShortType(), 3: T.IntegerType(), 4: T.LongType(), 5: T.ShortType(), 6: T.IntegerType(), 7: T.LongType(),
    8: T.DecimalType(20, 0), 9: T.LongType(), 10: T.DecimalType(20, 0), 11: T.FloatType(), 12: T.DoubleType(), 13: T.StringType(),
}
CODE_OF = {"tinyint": 1, "smallint": 5, "int": 3, "bigint": 7, "float": 11, "double": 12, "string": 13, "decimal(20,0)": 8, "boolean": 1}

INDEX = ["step", "k", "j", "i"]


@dataclass(frozen=True)
class Axes:
    """Names of a mesh's index and coordinate columns."""

    step: str = "step"
    time: str = "time"
    k: str = "k"
    j: str = "j"
    i: str = "i"
    z: str = "z"
    y: str = "y"
    x: str = "x"


AXES = Axes()


def with_attributes(df: DataFrame, name: str, **attributes: object) -> DataFrame:
    """Adds attributes to a column's metadata."""
    held = df.schema[name].metadata or {}
    return df.withColumn(name, F.col(name).alias(name, metadata={**held, **attributes}))


def attributes(df: DataFrame, name: str) -> dict:
    return dict(df.schema[name].metadata or {})


def by_step(df: DataFrame, step: str = "step") -> DataFrame:
    """Deal rows by step once; every window whose partition includes the step then needs no further shuffle."""
    return df.repartition(step)


def block_distribute(df: DataFrame, column: Column | str, start: int, end: int, stride: int = 1) -> DataFrame:
    """The steps start to end (inclusive) by a stride, dealt by step."""
    c = F.col(column) if isinstance(column, str) else column
    kept = df.where((c >= start) & (c <= end) & ((c - start) % stride == 0))
    return kept.repartition(c)


def space_time_distribute(df: DataFrame, i_block: int, j_block: int, t_block: int | None = None, axes: Axes = AXES) -> DataFrame:
    """Deal rows by blocks of cells, and of steps if t_block is given, for operators that need whole series of a cell."""
    keys = [F.floor(F.col(axes.i) / i_block), F.floor(F.col(axes.j) / j_block)]
    if t_block:
        keys.append(F.floor(F.col(axes.step) / t_block))
    return df.repartition(*keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set by setCheckpointDir.

    Where neither is set, a local session takes one of its own; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='isobar-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder of its own in shared_dir(), which goes when the driver ends."""
    path = f"{shared_dir(spark)}/isobar-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
