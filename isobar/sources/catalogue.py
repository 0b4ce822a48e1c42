"""A table of what NetCDF files hold, read from their headers and time axes alone.

A collection of many files is planned from this table instead of its files: executors open each file once, by ranged
reads, and what they find is kept by name, size and date. A later catalogue reads only files that are new or have changed.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.sources import netcdf3

SCHEMA = "file string, size long, modified long, t_axis string, steps long, times array<double>, units string, calendar string, variables array<string>, bytes_read long"
KEY = ["file", "size", "modified", "t_axis"]
#: Bytes that a read of a header or of an axis asks for at once.
READ_BYTES = 8192


class Counted(io.RawIOBase):
    """A file that counts the bytes read from it."""

    def __init__(self, raw):
        self.raw, self.count = raw, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = os.SEEK_SET) -> int:
        self.raw.seek(at, whence)
        return self.raw.tell()

    def tell(self) -> int:
        return self.raw.tell()

    def readinto(self, into) -> int:
        got = self.raw.read(len(into))
        into[: len(got)] = got
        self.count += len(got)
        return len(got)


def plain(path: str) -> str:
    """A path without the scheme of local files, however it is written."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def open_at(path: str) -> Counted:
    """A file on a mount, or on any store that pyarrow knows (hdfs, s3, gs, abfs), for ranged reads."""
    path = plain(path)
    if "://" not in path:
        return Counted(open(path, "rb", buffering=0))
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return Counted(where.open_input_file(name))


def time_axis(f, h: netcdf3.File, t: str) -> tuple[int, np.ndarray]:
    """Steps of a file and their times; a file without the axis is one step without a time."""
    if t in h.variables:
        times = netcdf3.native(netcdf3.read_slab(f, h, h.variables[t])).astype(float).ravel()
        return len(times), times
    return (h.records if h.dims.get(t) == 0 else h.dims.get(t, 1)), np.zeros(0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, size, modified, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counted = open_at(file)
            with counted.raw, io.BufferedReader(counted, READ_BYTES) as f:
                h = netcdf3.read_header(f)
                steps, times = time_axis(f, h, t)
                said = h.variables[t].attributes if t in h.variables else {}
                rows.append((file, size, modified, t, steps, times.tolist(), str(said.get("units", "")), str(said.get("calendar", "standard")), list(h.variables), counted.count))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=names)


def listing(spark: SparkSession, path: str, t: str = "time", files_regex: str | None = None) -> DataFrame:
    """Rows (file, size, modified, t_axis) of the files that Spark finds under a path or pattern; no file is opened."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.lit(t).alias("t_axis"))
    return found.where(F.col("file").rlike(files_regex)) if files_regex else found


def catalogue(spark: SparkSession, path: str, folder: str | None = None, t: str = "time", files_regex: str | None = None) -> DataFrame:
    """A row for each file: its steps, times, units, calendar and variables, and the bytes that were read to tell.

    With `folder`, a shared folder of this catalogue, files known there by name, size, date and time axis are not opened again, and what is
    found of others is added to it. Files that are gone, and earlier states of a file, stay in the folder but are not returned.
    No files give no rows; a file that is not NetCDF classic is an error.
    """
    listed = listing(spark, path, t, files_regex)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # names are small, but opening is slow: deal them widely
    read = lambda files: files.repartition(parts, "file").mapInArrow(_describe, SCHEMA)
    if folder is None:
        return read(listed)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    known = spark.read.schema(SCHEMA).parquet(folder) if held else spark.createDataFrame([], SCHEMA)
    read(listed.join(known, KEY, "left_anti")).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder).join(listed, KEY, "left_semi").dropDuplicates(KEY)  # two that ran at once may have added the same


def held_axes(folder: str, t: str) -> dict[tuple[str, int, int], tuple[int, np.ndarray]]:
    """Steps and times by (path, size, modified) of a catalogue's folder, for the planning of a scan: eight bytes a step."""
    import pyarrow.dataset as ds

    path = plain(folder)
    if "://" in path:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
        table = ds.dataset(name, filesystem=where, format="parquet").to_table(columns=[*KEY, "steps", "times"])
    else:
        table = ds.dataset(path, format="parquet").to_table(columns=[*KEY, "steps", "times"])
    return {(plain(r["file"]), r["size"], r["modified"]): (r["steps"], np.array(r["times"], dtype=float)) for r in table.to_pylist() if r["t_axis"] == t}


def read_time_axis(spark: SparkSession, path: str, t: str = "time", folder: str | None = None) -> DataFrame:
    """(file, step in the file, time, units, calendar) of each file, in parallel, from headers and time axes alone."""
    return catalogue(spark, path, folder, t).select("file", F.posexplode("times").alias("step", "time"), "units", "calendar").select("file", F.col("step").cast("long"), "time", "units", "calendar")
