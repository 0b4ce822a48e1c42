"""Tables in typed CSV, Parquet, binary and spreadsheet files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.model import CODE_OF, TYPE_CODES
from isobar.operators.table import numbered

#: Rows of a sheet below its header, and of a 1-D file that the driver writes.
SHEET_ROWS, NETCDF_ROWS = 1_048_575, 10_000_000

HEADER = re.compile(r'\s*"?(?P<name>(?:[^"\\]|\\.)*?)\((?P<code>\d+)\)"?\s*(?:,|$)')


def parse_header(line: str) -> T.StructType:
    """The schema of a header of `"name(code)"` columns."""
    fields, at = [], 0
    line = line.strip()
    while at < len(line):
        m = HEADER.match(line, at)
        if not m or int(m["code"]) not in TYPE_CODES:
            raise ValueError(f"cannot read column definition {line[at:]!r}")
        fields.append(T.StructField(m["name"], TYPE_CODES[int(m["code"])], True, {"type_code": int(m["code"])}))
        at = m.end()
    if not fields:
        raise ValueError("no column definitions")
    return T.StructType(fields)


def header_of(schema: T.StructType) -> str:
    return ",".join(f'"{f.name}({(f.metadata or {}).get("type_code") or CODE_OF[f.dataType.simpleString()]})"' for f in schema.fields)


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (or folder of files with the same header) whose header holds type codes; lines that start with # are comments.

    The header is read by Spark, so that any store will do; the rows are parsed with its schema, without inference.
    """
    first = spark.read.text(path).where("value not like '#%' and length(trim(value)) > 0").limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    schema = parse_header(first[0]["value"])
    # mode FAILFAST: a row that does not fit its definitions is an error; the header is the line Spark skips
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("comment", "#").option("escape", "\\").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def write_typed_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Typed CSV: each part file has its own header line."""
    names = header_of(df.schema).replace('"', "").split(",")
    df.toDF(*names).write.mode("overwrite").option("header", header).option("escape", "\\").option("quoteAll", False).csv(path)


def read_table(spark: SparkSession, path: str, file_format: str = "auto", index_column: str | None = None, original_ids: list[str] | None = None) -> DataFrame:
    """A table by its format (csv, parquet; bin is Parquet here); dealt by an index column if given; original_ids (an order) adds the row number."""
    kind = file_format if file_format != "auto" else ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    out = read_typed_csv(spark, path) if kind == "csv" else spark.read.parquet(path)
    if original_ids is not None:
        out = numbered(out, original_ids, "original_ids")
    return out.repartition(index_column) if index_column else out


def _whole(df: DataFrame, most: int) -> pd.DataFrame:
    """A small table on the driver; a larger one is an error, never cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write csv or parquet")
    return df.toPandas()


def write_table(df: DataFrame, path: str, output_format: str = "auto") -> None:
    """csv, parquet or bin (Parquet), xlsx (needs openpyxl; small tables) or netcdf (1-D variables; small tables)."""
    kind = output_format if output_format != "auto" else {"csv": "csv", "xlsx": "xlsx", "nc": "netcdf"}.get(path.rsplit(".", 1)[-1], "parquet")
    if kind == "csv":
        write_typed_csv(df, path)
    elif kind == "xlsx":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("spreadsheets need openpyxl") from e
        _whole(df, SHEET_ROWS).to_excel(path, index=False)
    elif kind == "netcdf":
        from isobar.sources.netcdf3 import write_file

        pdf = _whole(df, NETCDF_ROWS)
        write_file(path, {"row": len(pdf)}, {c: (("row",), pdf[c].to_numpy(), {}) for c in pdf.columns if pdf[c].dtype.kind in "iuf"})
    else:
        df.write.mode("overwrite").parquet(path)


def write_database(tables: dict[str, DataFrame], path: str, output_format: str = "parquet") -> None:
    """Each table of a collection in a folder of its own."""
    for name, df in tables.items():
        write_table(df, f"{path.rstrip('/')}/{name}" + (".csv" if output_format == "csv" else ""), output_format)


def read_parameters(spark: SparkSession, path: str, row_offset: int = 0, number_of_rows: int = -1) -> DataFrame:
    """A table of detector parameters (hwhm_latitude, min_water_vapor, min_component_area), or a range of its rows by row id."""
    df = read_table(spark, path)
    order = [c for c in ("row", "id") if c in df.columns] or df.columns
    out = numbered(df, order, "parameter_table_row")
    last = row_offset + number_of_rows - 1 if number_of_rows >= 0 else None
    return out.where(F.col("parameter_table_row") >= row_offset) if last is None else out.where(F.col("parameter_table_row").between(row_offset, last))
