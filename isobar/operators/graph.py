"""Connected components of links between rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.model import shared_folder

#: Links that a task contracts together; bounds its memory.
TOGETHER = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a-b, and each node's smallest node within reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) contracted to links of each node with the smallest node that this task's links lead to."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, root = roots(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
        on = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(root[on])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes (longs) that have links with others, the component named by its smallest node.

    Tasks contract the links that they read to stars; each node then keeps its smallest neighbour, its other neighbours are linked to that one, and links go
    on to where their smaller node leads. A round at least halves the way to the smallest node, and where one task holds all links, one round does. A round
    is a table in the shared folder: a lost executor costs no earlier round.
    """
    spark, base = links.sparkSession, shared_folder(links.sparkSession)
    open_ = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    for n in range(rounds):
        stars = open_.mapInArrow(_stars, "a long, b long")  # a > b
        least = stars.groupBy("a").agg(F.min("b").alias("least"), F.count_distinct("b").alias("n"))
        # A node with one smaller neighbour keeps that link; of more, each is linked to the smallest.
        more = stars.join(least.where("n > 1"), "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least.select("a", F.col("least").alias("b")).unionByName(more.distinct()).write.parquet(f"{base}/{n}")
        open_ = spark.read.schema("a long, b long").parquet(f"{base}/{n}")
        twice = open_.groupBy("a").agg(F.count_distinct("b").alias("n")).where("n > 1").select("a")
        centres = open_.select(F.col("b").alias("a")).distinct()
        if not open_.join(twice.unionByName(centres), "a", "left_semi").limit(1).count():
            forest = open_.distinct()
            return forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(forest.select("b", "b").distinct().toDF("node", "component"))
        # A link goes on to where its centre leads: a star and the link of its centre may lie in unlike tasks, in every round.
        on = open_.join(centres, "a", "left_semi").groupBy("a").agg(F.min("b").alias("next")).withColumnRenamed("a", "b")
        open_ = open_.join(on, "b", "left").select("a", F.coalesce("next", "b").alias("b")).repartition(F.xxhash64("b"))  # stars of one centre meet in one task
    raise RuntimeError(f"components did not settle in {rounds} rounds")
