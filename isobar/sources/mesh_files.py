"""Mesh files that appear whole or not at all: a data source that writes NetCDF and VTK files from executors.

A task writes into a folder of its own attempt, under a hidden folder of the job. Only when all tasks are done
does the driver move the files of the attempts that count into place; a failed or repeated attempt leaves
nothing, as the job's hidden folder goes at the end either way.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from isobar.sources import netcdf3, shapes
from isobar.sources.meshes import layout_key

INDEX = ["step", "time", "k", "j", "i", "z", "y", "x"]
SUFFIX = {"netcdf3": ".nc", "vtk": ".vtk"}
#: Readers pass over names that begin with an underscore.
STAGED, DONE = "_staged-", "_SUCCESS"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs), and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    """What a task attempt has staged."""

    folder: str = ""
    names: list[str] = field(default_factory=list)


class MeshWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "netcdf3"), overwrite
        if self.kind not in SUFFIX:
            raise ValueError(f"unknown kind {self.kind}")
        self.variables = [v.strip() for v in options["variables"].split(",")]
        self.units, self.calendar = options.get("units", "days since 1970-01-01"), options.get("calendar", "standard")
        self.fill = float(options.get("fill", "1e20"))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = place(self.path)
        done = Written(f"{root}/{STAGED}{self.job}/{TaskContext.get().taskAttemptId()}")
        for name, rows in self._files(iterator):
            if name in done.names:
                raise ValueError(f"the rows of {name} do not follow each other")
            if not done.names:
                files.create_dir(done.folder, recursive=True)
            with files.open_output_stream(f"{done.folder}/{name}") as out:
                out.write(self._content(rows))
            done.names.append(name)
        return done

    def _files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pd.DataFrame]]:
        """The rows of one file after another; one file's rows are held at a time."""
        held: list[pa.RecordBatch] = []
        now = ""
        for batch in batches:
            if not batch.num_rows:
                continue
            names = self._names(batch)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and names[a] != now:
                    yield now, pa.Table.from_batches(held).to_pandas()
                    held = []
                now = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield now, pa.Table.from_batches(held).to_pandas()

    def _names(self, batch: pa.RecordBatch) -> np.ndarray:
        file = batch.column(batch.schema.get_field_index("file")).to_pylist()
        if None in file:
            raise ValueError("a row names no file")
        if self.kind == "vtk":  # holds one step
            steps = batch.column(batch.schema.get_field_index("step")).to_pylist()
            file = [f"{f}_{s:06d}" for f, s in zip(file, steps, strict=True)]
        return np.array([f + SUFFIX[self.kind] for f in file], dtype=object)

    def _content(self, rows: pd.DataFrame) -> bytes:
        rows = rows.sort_values(["step", "k", "j", "i"])
        if self.kind == "vtk":
            return shapes.vtk_text(rows, self.variables).encode()
        return netcdf3.grid_file(rows, self.variables, self.units, self.calendar, self.fill)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        try:
            staged = [(m.folder, n) for m in messages if m for n in m.names]
            names = [n for _, n in staged]
            twice = sorted(n for n, c in Counter(names).items() if c > 1)
            if twice:
                raise ValueError(f"rows of one file lie in several tasks: {twice[:5]}")
            there = self._there(files, root)
            if not self.overwrite and there & set(names):
                raise FileExistsError(f"already there: {sorted(there & set(names))[:5]}")
            files.create_dir(root, recursive=True)
            for folder, n in staged:
                files.move(f"{folder}/{n}", f"{root}/{n}")
            for n in there - set(names) if self.overwrite else ():
                files.delete_file(f"{root}/{n}")
            with files.open_output_stream(f"{root}/{DONE}"):
                pass
        finally:
            self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _there(self, files: fs.FileSystem, root: str) -> set[str]:
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name for f in found if f.is_file and f.base_name.endswith(SUFFIX[self.kind])}

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        at = f"{root}/{STAGED}{self.job}"
        if files.get_file_info(at).type == fs.FileType.Directory:
            files.delete_dir(at)


class MeshFiles(DataSource):
    """Write with `df.write.format("mesh_files")`; rows name their file in the column `file` and lie together."""

    @classmethod
    def name(cls) -> str:
        return "mesh_files"

    def writer(self, schema: StructType, overwrite: bool) -> MeshWriter:
        return MeshWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshFiles)


def write_files(df: DataFrame, path: str, variables: list[str], kind: str = "netcdf3", layout: str = "number_of_steps", overwrite: bool = False, steps_per_file: int = 128, first_step: int = 0, units: str = "days since 1970-01-01", calendar: str = "standard", fill: float = 1e20) -> None:
    """Writes a mesh as files named by their layout (NetCDF), or by layout and step (VTK, a step a file).

    Rows are dealt by what a file holds and sorted, so a task holds one file at a time: choose a layout whose files fit
    a task. Without overwrite a file that is already there fails the job, and nothing changes; with it, what the folder held goes.
    Missing values become the fill value (NetCDF) or nan (VTK); an empty mesh writes no file.
    """
    register(df.sparkSession)
    keyed = df.select(*INDEX, *variables).withColumn("file", layout_key(layout, steps_per_file, first_step, units, calendar))
    unit = ["file", "step"] if kind == "vtk" else ["file"]
    dealt = keyed.repartition(*unit).sortWithinPartitions("file", "step", "k", "j", "i")
    options = {"kind": kind, "variables": ",".join(variables), "units": units, "calendar": calendar, "fill": repr(float(fill))}
    dealt.write.format("mesh_files").options(**options).mode("overwrite" if overwrite else "append").save(path)
