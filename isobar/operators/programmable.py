"""User-defined operators and reductions, executives and caches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce as fold

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Operator:
    """Base of user operators: override transform (and schema, if it is to be known without a plan)."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.transform(self.transform)


class Pipeline(Operator):
    """Operators one after the other; one lazy plan."""

    def __init__(self, *stages: Callable[[DataFrame], DataFrame]):
        self.stages = stages

    def transform(self, df: DataFrame) -> DataFrame:
        return fold(lambda d, f: d.transform(f), self.stages, df)


def programmable(df: DataFrame, execute: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None) -> DataFrame:
    """A user's function of a group of rows (by keys), or of each batch of rows."""
    if by:
        return df.groupBy(*by).applyInPandas(execute, schema)

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield execute(part)

    return df.mapInPandas(each, schema)


def programmable_reduce(df: DataFrame, initialize: Callable[[pd.DataFrame], pd.DataFrame], combine: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None, finalize: Callable[[pd.DataFrame], pd.DataFrame] | None = None, fan: int = 16) -> DataFrame:
    """A user's reduction: initialize makes a partial result of rows, combine(left, right) merges two, finalize ends it.

    combine must be associative and commutative, since order is not known. Partial results travel as one binary
    value each. Batches are folded in each partition as they come, then by key, or without keys in a
    tree of `fan` partial results to a task. by are columns of df, and keys of the partial results' groups.
    """
    keys = by or []

    def first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in it:
            for k, own in part.groupby(keys, sort=False, dropna=False) if keys else [((), part)]:
                new = initialize(own)
                held[k] = combine(held[k], new) if k in held else new
        yield packed(held)

    def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in it:
            for k, blob in zip(part["k"], part["blob"], strict=True):
                new = pickle.loads(blob)
                held[k] = combine(held[k], new) if k in held else new
        yield packed(held)

    def packed(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"k": pd.Series([k if isinstance(k, bytes) else pickle.dumps(k) for k in held], dtype=object), "blob": pd.Series([pickle.dumps(v) for v in held.values()], dtype=object)})

    def last(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for blob in part["blob"]:
                yield finalize(pickle.loads(blob)) if finalize else pickle.loads(blob)

    out = df.mapInPandas(first, "k binary, blob binary")
    if keys:
        out = out.repartition("k").mapInPandas(merge, "k binary, blob binary")
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while True:
            out = out.repartition(parts).mapInPandas(merge, "k binary, blob binary")
            if parts == 1:
                break
            parts = -(-parts // fan)
    return out.mapInPandas(last, schema)


def model_inference(df: DataFrame, load: Callable[[], Callable[[object], object]], variable: str, result: str, preprocess: Callable | None = None, postprocess: Callable | None = None, step: str = "step", j: str = "j", i: str = "i") -> DataFrame:
    """A model applied to the field of each step: load() is called once a task and gives array -> array of the same shape.

    Torch models, ONNX sessions and plain functions serve alike; nothing is imported here.
    """
    import numpy as np

    schema = df.withColumn(result, F.lit(0.0)).schema
    held: list = []

    def one(t: pa.Table) -> pa.Table:
        if not held:
            held.append(load())
        jj, ii = t.column(j).to_numpy(), t.column(i).to_numpy()
        field = np.full((jj.max() + 1, ii.max() + 1), np.nan)
        field[jj, ii] = t.column(variable).to_numpy(zero_copy_only=False)
        x = preprocess(field) if preprocess else field
        y = held[0](x)
        y = np.asarray(postprocess(y) if postprocess else y)
        return t.append_column(result, pa.array(y[jj, ii].astype(float)))

    return df.groupBy(step).applyInArrow(one, schema)


def pad_to_multiple(field, multiple: int):  # noqa: ANN001, ANN201
    """A field padded at its far ends to a multiple of cells, as segmentation networks ask; the pad repeats the edge."""
    import numpy as np

    j, i = ((-n) % multiple for n in field.shape)
    return np.pad(np.nan_to_num(field), ((0, j), (0, i)), mode="edge")


def cached(df: DataFrame) -> DataFrame:
    """Keeps a dataset that several plans read, in memory and beyond it on disk."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def capture(df: DataFrame, most: int = 1_000_000) -> pd.DataFrame:
    """The dataset in the caller's hands; more rows than `most` are an error, not a surprise for the driver."""
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got
