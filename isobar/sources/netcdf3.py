"""NetCDF classic files (versions 1, 2 and 5): reading as a Spark data source, and writing.

The format is that of the public NetCDF classic specification. NetCDF-4 files are HDF5, which needs a library
that is not required here; they are refused with a clear message.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Type codes of the format (fixed values).
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: str
    begin: int
    attributes: dict
    record: bool


@dataclass
class File:
    dims: dict[str, int] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0


def read_header(f: BinaryIO) -> File:
    magic = f.read(4)
    if magic[:3] != b"CDF":
        raise ValueError("this is HDF5 (NetCDF-4); convert it to NetCDF classic" if magic == b"\x89HDF" else "not a NetCDF file")
    version = magic[3]
    wide = version == 5
    number = lambda: int.from_bytes(f.read(8 if wide else 4), "big")
    small = lambda: int.from_bytes(f.read(4), "big")

    def name() -> str:
        n = number()
        text = f.read(n).decode()
        f.read(-n % 4)
        return text

    def attributes() -> dict:
        tag, n = small(), number()
        out = {}
        for _ in range(n if tag == 12 else 0):
            key, kind, count = name(), KINDS[small()], number()
            raw = f.read(count * np.dtype(kind).itemsize)
            f.read(-len(raw) % 4)
            if kind == "S1":
                out[key] = raw.decode(errors="replace").rstrip("\0")
            else:
                values = np.frombuffer(raw, dtype=kind).tolist()
                out[key] = values[0] if len(values) == 1 else values
        return out

    out = File()
    records = number()
    tag, n = small(), number()
    names = []
    for _ in range(n if tag == 10 else 0):
        key = name()
        out.dims[key] = number()
        names.append(key)
    out.attributes = attributes()
    tag, n = small(), number()
    for _ in range(n if tag == 11 else 0):
        key = name()
        dims = tuple(names[number()] for _ in range(number()))
        held, kind = attributes(), KINDS[small()]
        number()  # the stated size, which overflows for large variables
        begin = int.from_bytes(f.read(4 if version == 1 else 8), "big")
        out.variables[key] = Variable(key, dims, kind, begin, held, bool(dims) and out.dims[dims[0]] == 0)
    sizes = [slab_bytes(out, v) for v in out.variables.values() if v.record]
    out.record_size = sum(s + -s % 4 for s in sizes) if len(sizes) > 1 else sum(sizes)
    f.seek(0, os.SEEK_END)
    unknown = records == (1 << (64 if wide else 32)) - 1
    if unknown and out.record_size:
        first = min(v.begin for v in out.variables.values() if v.record)
        records = (f.tell() - first) // out.record_size
    out.records = 0 if unknown and not out.record_size else records
    return out


def shape(h: File, v: Variable) -> tuple[int, ...]:
    return tuple(h.records if h.dims[d] == 0 else h.dims[d] for d in v.dims)


def slab_bytes(h: File, v: Variable) -> int:
    return int(np.prod([h.dims[d] for d in (v.dims[1:] if v.record else v.dims)], dtype=np.int64)) * np.dtype(v.kind).itemsize


def read_slab(f: BinaryIO, h: File, v: Variable, record: int | None = None) -> np.ndarray:
    """A whole variable, or one index of its first dimension."""
    dims = shape(h, v)
    size = np.dtype(v.kind).itemsize
    if record is None:
        if v.record:
            return np.stack([read_slab(f, h, v, r) for r in range(h.records)]) if h.records else np.zeros(dims, v.kind[-2:])
        f.seek(v.begin)
        flat = np.frombuffer(f.read(int(np.prod(dims, dtype=np.int64)) * size), dtype=v.kind)
        return flat.reshape(dims)
    inner = int(np.prod(dims[1:], dtype=np.int64))
    f.seek(v.begin + record * (h.record_size if v.record else inner * size))
    return np.frombuffer(f.read(inner * size), dtype=v.kind).reshape(dims[1:])


def native(a: np.ndarray) -> np.ndarray:
    return a.astype(a.dtype.newbyteorder("="))


def read_rows(f: BinaryIO, h: File, v: Variable, record: int | None, levels: Sequence[int], low: int, high: int) -> np.ndarray:
    """Rows low to high of some levels of a variable over (y, x) or (z, y, x), of one index of the dimension before these if `record` is given.

    Reads the bytes of these rows and no others.
    """
    dims = shape(h, v)[0 if record is None else 1 :]
    size, width = np.dtype(v.kind).itemsize, dims[-1]
    start = v.begin + (0 if record is None else record * (h.record_size if v.record else int(np.prod(dims, dtype=np.int64)) * size))
    out = []
    for k in levels:
        f.seek(start + (k * dims[-2] + low) * width * size)
        out.append(np.frombuffer(f.read((high - low) * width * size), dtype=v.kind).reshape(high - low, width))
    return np.stack(out)


TESTS = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
COORDINATES = ("step", "time", "z", "y", "x")


def bounds(text: str) -> list[tuple[str, str, float]]:
    """Tests (coordinate, sign, number) of a text like `y >= -30; y < 30; step > 10`."""
    out = []
    for part in filter(None, map(str.strip, text.split(";"))):
        m = re.fullmatch(r"(\w+)\s*(<=|>=|<|>|=)\s*([-+.\deE]+)", part)
        if not m or m[1] not in COORDINATES:
            raise ValueError(f"bounds: {part!r}")
        out.append((m[1], m[2], float(m[3])))
    return out


def admitted(tests: Sequence[tuple[str, str, float]], column: str, values: np.ndarray) -> np.ndarray:
    """Which values of an axis or of the steps pass the tests (column, sign, number) on it."""
    out = np.ones(len(values), dtype=bool)
    for name, test, value in tests:
        if name == column:
            out &= TESTS[test](values, value)
    return out


def cells(
    f: BinaryIO, h: File, variables: list[str], t: str, z: str | None, y: str, x: str, first_step: int, steps: range, t_values: list[float] | None = None, tests: Sequence[tuple[str, str, float]] = ()
) -> Iterator[pa.RecordBatch]:
    """Rows of a mesh, a batch for each step. Fill values become null. Steps, levels and rows that the tests exclude are not read."""
    axis = lambda n: native(read_slab(f, h, h.variables[n])).astype(float) if n and n in h.variables else np.zeros(1)
    xs, ys, zs = axis(x), axis(y), axis(z) if z else np.zeros(1)
    times = np.array(t_values, dtype=float) if t_values else axis(t)
    ks, js, own_i = (np.flatnonzero(admitted(tests, c, values)) for c, values in (("z", zs), ("y", ys), ("x", xs)))
    if not (len(ks) and len(js) and len(own_i)):
        return
    k, j, i = (a.ravel() for a in np.meshgrid(ks, js, own_i, indexing="ij"))
    low, high = int(js[0]), int(js[-1]) + 1
    for s in steps:
        time = times[s] if s < len(times) else float(s)
        if not (admitted(tests, "time", np.array([time])) & admitted(tests, "step", np.array([first_step + s])))[0]:
            continue
        columns: dict[str, pa.Array] = {
            "step": pa.array(np.full(len(k), first_step + s)), "time": pa.array(np.full(len(k), time)),
            "k": pa.array(k), "j": pa.array(j), "i": pa.array(i), "z": pa.array(zs[k]), "y": pa.array(ys[j]), "x": pa.array(xs[i]),
        }
        for name in variables:
            v = h.variables[name]
            moves = bool(v.dims) and v.dims[0] == t
            own = [d for d in v.dims if d != t]
            if own in ([y, x], [z, y, x]) and own == list(v.dims[moves:]):
                block = native(read_rows(f, h, v, s if moves else None, ks.tolist() if z in own else [0], low, high)).astype(float)
                part = np.broadcast_to(block[:, js - low][:, :, own_i], (len(ks), len(js), len(own_i)))
            else:
                a = native(read_slab(f, h, v, s) if moves else read_slab(f, h, v)).astype(float)
                full = np.broadcast_to(a if z in own or len(own) < 2 else a[None], (len(zs), len(ys), len(xs)))
                part = full[np.ix_(ks, js, own_i)]
            flat = part.ravel()
            fill = v.attributes.get("_FillValue", v.attributes.get("missing_value"))
            gone = np.isnan(flat) if fill is None else np.isnan(flat) | (np.abs(flat - float(fill)) <= 1e-6 * abs(float(fill)))
            columns[name] = pa.array(flat, mask=gone)
        yield pa.RecordBatch.from_pydict(columns)


def ddl(variables: list[str]) -> str:
    return "step long, time double, k long, j long, i long, z double, y double, x double" + "".join(f", `{v}` double" for v in variables)


class Block(InputPartition):
    def __init__(self, path: str, first_step: int, low: int, high: int):
        self.path, self.first_step, self.low, self.high = path, first_step, low, high


class NetCDF3Reader(DataSourceReader):
    """Bounds are an option rather than pushed filters: this Spark keeps the filters of one query for the next query without any on the same DataFrame."""

    def __init__(self, options: dict):
        self.o, self.tests = options, bounds(options.get("bounds", ""))

    def files(self) -> list[str]:
        return list_files(self.o["path"], self.o.get("files_regex"))

    def known(self, t: str) -> dict:
        if "catalogue" not in self.o:
            return {}
        from isobar.sources import catalogue

        return catalogue.held_axes(self.o["catalogue"], t)

    def partitions(self) -> list[Block]:
        """A block of steps of a file each; steps number the files' times in order of their names.

        Files that the catalogue knows are not opened here, and blocks whose times the bounds exclude are left out.
        """
        out, at = [], 0
        size = int(self.o.get("steps_per_partition", "16"))
        low, high = int(self.o.get("first_step", "0")), int(self.o.get("last_step", str(1 << 62)))
        t = self.o.get("t_axis_variable", "time")
        known = self.known(t)
        for path in self.files():
            told = os.stat(path)
            n, times = known.get((path, told.st_size, told.st_mtime_ns // 1_000_000), (None, ()))
            if n is None:
                with open(path, "rb") as f:
                    h = read_header(f)
                n = h.records if h.dims.get(t) == 0 else h.dims.get(t, 1)
            for a in range(0, n, size):
                b = min(n, a + size)
                first, last = max(a, low - at), min(b, high - at + 1)
                if first >= last:
                    continue
                fine = admitted(self.tests, "step", np.arange(at + first, at + last))
                if len(times) == n:
                    fine &= admitted(self.tests, "time", times[first:last])
                if fine.any():
                    out.append(Block(path, at, first, last))
            at += n
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            h = read_header(f)
            names = [v for v in self.o.get("variables", "").split(",") if v]
            axes = [self.o.get(f"{a}_axis_variable", d) for a, d in (("t", "time"), ("z", ""), ("y", "lat"), ("x", "lon"))]
            yield from cells(f, h, names, axes[0], axes[1] or None, axes[2], axes[3], partition.first_step, range(partition.low, partition.high), tests=self.tests)


class NetCDF3Source(DataSource):
    """spark.read.format("netcdf3").option("path", ...).option("variables", "a,b").load()

    Options: path (a file, pattern or folder, on a file system that the executors mount), files_regex, variables,
    t_axis_variable (time), z_axis_variable (none), y_axis_variable (lat), x_axis_variable (lon),
    first_step, last_step, steps_per_partition (16), catalogue (the folder of a `catalogue.catalogue` of these files), bounds (like `y >= -30; y < 30; time > 10`: other steps, levels and rows are not read).
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return ddl([v for v in self.options.get("variables", "").split(",") if v])

    def reader(self, schema: object) -> NetCDF3Reader:
        return NetCDF3Reader(dict(self.options))


def list_files(path: str, regex: str | None = None) -> list[str]:
    path = path.removeprefix("file://")
    found = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    shown = (p for p in found if not os.path.basename(p).startswith("_"))  # the rest are marks of writers
    return sorted(p for p in shown if not regex or re.search(regex, p))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NetCDF3Source)


def read_anywhere(spark: SparkSession, path: str, variables: list[str], t: str = "time", z: str | None = None, y: str = "lat", x: str = "lon") -> DataFrame:
    """The same rows from any store that Spark reads: a file is a row of bytes (under 2 GB), parsed on an executor.

    Steps count from 0 in each file; `file` names it.
    """
    names = list(variables)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = BytesIO(content)
                h = read_header(f)
                n = shape(h, h.variables[t])[0] if t in h.variables else 1
                for rows in cells(f, h, names, t, z, y, x, 0, range(n)):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([name] * rows.num_rows)], names=[*rows.schema.names, "file"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ddl(names) + ", file string")


def read_arrays(spark: SparkSession, path: str, variables: list[str], t: str = "time") -> DataFrame:
    """1-D time-varying arrays: (file, step, time, variables); variables with more dimensions are arrays."""
    names = list(variables)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = BytesIO(content)
                h = read_header(f)
                times = native(read_slab(f, h, h.variables[t])).astype(float)
                cols = {"file": pa.array([name] * len(times)), "step": pa.array(np.arange(len(times))), "time": pa.array(times)}
                for v in names:
                    a = native(read_slab(f, h, h.variables[v])).astype(float)
                    cols[v] = pa.array(list(a.reshape(len(times), -1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, step long, time double" + "".join(f", `{v}` array<double>" for v in names))


# Staggering of the Arakawa C grid (fixed values): the suffix of a dimension that lies on faces.
STAGGERED = {"bottom_top_stag": "k", "south_north_stag": "j", "west_east_stag": "i"}


def read_staggered(spark: SparkSession, path: str, variables: list[str], t: str = "Time") -> dict[str, DataFrame]:
    """Variables on a staggered grid, one table for each: (file, step, k, j, i, value); attributes tell cell and face centerings by their dimensions."""

    def one(name: str) -> DataFrame:
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    f = BytesIO(content)
                    h = read_header(f)
                    v = h.variables[name]
                    for s in range(shape(h, v)[0]):
                        a = native(read_slab(f, h, v, s)).astype(float)
                        a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                        k, j, i = (x.ravel() for x in np.meshgrid(*map(np.arange, a.shape), indexing="ij"))
                        centering = "".join(STAGGERED.get(d, "") for d in v.dims) or "cell"
                        yield pa.RecordBatch.from_pydict({"file": [file] * a.size, "step": np.full(a.size, s), "k": k, "j": j, "i": i, name: a.ravel(), "centering": [centering] * a.size})

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, f"file string, step long, k long, j long, i long, `{name}` double, centering string")

    return {v: one(v) for v in variables}


def encode(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """The content of a NetCDF classic file (version 2) of fixed dimensions."""
    out = bytearray(b"CDF\x02" + (0).to_bytes(4, "big"))
    put = lambda n, size=4: out.extend(int(n).to_bytes(size, "big"))

    def text(s: str) -> None:
        raw = s.encode()
        put(len(raw))
        out.extend(raw + b"\0" * (-len(raw) % 4))

    def attrs(held: dict) -> None:
        put(12 if held else 0)
        put(len(held))
        for k, v in held.items():
            text(k)
            if isinstance(v, str):
                put(2)
                text(v)
            else:
                put(6)
                values = np.atleast_1d(np.asarray(v, dtype=">f8"))
                put(len(values))
                out.extend(values.tobytes())

    names = list(dims)
    put(10 if dims else 0)
    put(len(dims))
    for k, n in dims.items():
        text(k)
        put(n)
    attrs(attributes or {})
    put(11 if variables else 0)
    put(len(variables))
    places, blobs = {}, {}
    for k, (own, data, held) in variables.items():
        kind = {"i": "i4" if data.dtype.itemsize >= 4 else f"i{data.dtype.itemsize}", "u": "i4", "f": f"f{max(4, data.dtype.itemsize)}", "b": "i1"}[data.dtype.kind]
        blob = data.astype(f">{kind}").tobytes()
        text(k)
        put(len(own))
        for d in own:
            put(names.index(d))
        attrs(held)
        put(CODES[kind])
        put(len(blob) + -len(blob) % 4)
        places[k] = len(out)
        put(0, 8)
        blobs[k] = blob + b"\0" * (-len(blob) % 4)
    for k, blob in blobs.items():
        out[places[k] : places[k] + 8] = len(out).to_bytes(8, "big")
        out.extend(blob)
    return bytes(out)


def write_file(path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> None:
    """A NetCDF classic file (version 2) of fixed dimensions."""
    with open(path, "wb") as f:
        f.write(encode(dims, variables, attributes))


def grid_file(p: pd.DataFrame, variables: list[str], t_units: str, calendar: str, fill: float) -> bytes:
    """The content of a NetCDF file of the mesh rows p, sorted by step and cell; cells without a row or a value hold the fill value."""
    steps, times = np.unique(p["step"]), p.groupby("step")["time"].first().to_numpy()
    nk, nj, ni = (int(p[c].max()) + 1 for c in ("k", "j", "i"))
    at = (np.searchsorted(steps, p["step"]), p["k"].to_numpy(), p["j"].to_numpy(), p["i"].to_numpy())
    axis = lambda c, idx, n: p.groupby(idx)[c].first().reindex(range(n)).to_numpy(dtype=float)
    held = {"time": (("time",), times.astype(float), {"units": t_units, "calendar": calendar}), "lev": (("lev",), axis("z", "k", nk), {}), "lat": (("lat",), axis("y", "j", nj), {}), "lon": (("lon",), axis("x", "i", ni), {})}
    for v in variables:
        a = np.full((len(steps), nk, nj, ni), fill)
        a[at] = p[v].astype(float).fillna(fill).to_numpy()
        held[v] = (("time", "lev", "lat", "lon"), a, {"_FillValue": fill})
    return encode({"time": len(steps), "lev": nk, "lat": nj, "lon": ni}, held)


def export(df: DataFrame, folder: str, variables: list[str], file_key: str = "file", t_units: str = "days since 1970-01-01", calendar: str = "standard", fill: float = 1e20) -> DataFrame:
    """Writes a NetCDF file for each value of file_key into a folder that the executors share; returns the files written.

    A file is one group: choose a layout whose files fit a task.
    """
    names = list(variables)

    def one(t: pa.Table) -> pa.Table:
        p = t.to_pandas().sort_values(["step", "k", "j", "i"])
        path = os.path.join(folder, f"{p[file_key].iloc[0]}.nc")
        with open(path, "wb") as f:
            f.write(grid_file(p, names, t_units, calendar, fill))
        return pa.table({"path": [path], "steps": [p["step"].nunique()]})

    os.makedirs(folder, exist_ok=True)
    return df.groupBy(file_key).applyInArrow(one, "path string, steps long")
