"""What the operators of this subpackage share: staging, run-wise Arrow loops, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: A side with at most so many short rows (two or three longs each) may be broadcast: under 32 MB.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch that a function takes at a time; Spark itself bounds a batch's bytes (64 MB unless set otherwise).
BATCH_ROWS = 512
#: Rows that a task sends to Python at a time, at most, and bytes: an executor holds a batch of each of its tasks outside its heap, twice while it grows.
SENT_ROWS, SENT = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
SENT_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches. They stay so, as a lazy result reads them only when it runs."""
    for name, most in ((SENT, SENT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", SENT_BYTES)):
        held = int(spark.conf.get(name).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows, so that what is made of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


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


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        out.append(name)
    return out


def add_score(docs: DataFrame, text_col: str, score: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """docs with a double column `score` of each text, in one pass; `make` gives a task its function of a batch's texts."""
    bound_batches(docs.sparkSession)
    text, own = fresh(docs, "__text", "__score")
    kept = docs.drop(score)
    sent = text_col in kept.columns and isinstance(kept.schema[text_col].dataType, StringType)  # then the text is sent once
    rows = kept if sent else docs.withColumn(text, F.col(text_col).cast("string")).drop(score)
    text = text_col if sent else text

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text)
            told = pa.array(scores(batch.column(at)), pa.float64())
            keep = [i for i in range(batch.num_columns) if sent or i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), told], names=[*(batch.schema.names[i] for i in keep), own])

    return rows.mapInArrow(f, StructType([*kept.schema.fields, StructField(own, DoubleType())])).withColumnRenamed(own, score)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    ``drop`` removes a table that nothing reads any more; the rest, which lazy results still read, goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/isobar-{uuid.uuid4().hex}"
        self.n = 0
        where, files = self._at(self.base)
        files.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        held = self.spark.conf.get(SENT)
        self.spark.conf.set(SENT, str(min(int(held), SENT_ROWS) if int(held) > 0 else SENT_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SENT, held)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._isobar_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_isobar_path", None)
        if path:
            where, files = self._at(path)
            files.delete(where, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the table has at most BROADCAST_ROWS rows; else leave the join to AQE."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The runs of equal keys of batches sorted by a long key, also across batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        table = pa.Table.from_batches([batch])
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            k = int(keys[a])
            if held and k != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = k
            held.append(table.slice(int(a), int(b - a)))
    if held:
        yield held_key, pa.concat_tables(held)


def by_run(df: DataFrame, key: str, then: str | None, f: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """Deal rows by a long key, sort them, and stream each partition through f(batches)."""
    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(*([key, then] if then else [key])).mapInArrow(f, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned longs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n local nodes and links a-b, each node's smallest reachable node."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:  # point each node at the end of its chain
            to = root[root]
            if (to == root).all():
                break
            root = to


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component the smallest node.

    Alternates the two star operations of Kiveris et al. ("Connected components in MapReduce and
    beyond"): each is a minimum by node, combined before the shuffle, and a join with it. Nodes without
    links do not appear. A round's links are written to the shared folder, which cuts the lineage.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.keep(e, "links")
    n = e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small(least, 2 * n), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small(least, 2 * n), "a")
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(star, "links")
        # A star forest is reached when no node is both a centre and a member.
        centres, members = new.select(F.col("b").alias("a")).distinct(), new.groupBy("a").agg(F.count("*").alias("c"))
        open_ = members.join(small(centres, n), "a", "left_semi").limit(1).count() + members.where("c > 1").limit(1).count()
        scratch.drop(e)
        e, n = new, new.count()
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
