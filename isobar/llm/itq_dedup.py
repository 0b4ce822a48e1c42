"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Equal vectors are folded into one *node*, so copies are never compared with each other.
2. Iterative quantisation (Gong and Lazebnik, 2011) learns rotations of the principal components that balance
   and align their signs; the signs of all rotated components are a vector's binary code.
3. The code is cut into substrings, and each is the key of one Hamming table. A code is stored under its own
   substring and, where probes are worth their rows, also looked up under those at a distance of one bit.
   Codes that meet in a table are compared in full: only those within the Hamming radius go on.
4. What goes on is linked into families, whose original vectors are compared exactly, in double precision.

The width of a substring follows the number of nodes (a key holds about KEY_ROWS). Radius and number of tables
follow from pairs made to lie just at the threshold, around vectors of the fit sample, so that the tables find
the share RECALL of them, whatever direction the vectors have in common. Where this takes more than MOST_TABLES
tables, keys get shorter: the work grows, the recall stays.

Long keys and large families are cut into blocks, and each pair of blocks is a group of its own. Only codes
travel to the tables; a vector travels when it is folded, and once for each pair of blocks of its family.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, by_run, components, forest, runs, small
from isobar.llm.vectors import matrix, usable

#: Vectors (by hash) from which the rotations are learned, at most, and their components in all; all vectors are coded.
FIT_ROWS, FIT_VALUES = 10_000, 2_000_000
#: Pairs made at the threshold, of each kind.
PAIRS = 2_000
#: More lengths of vectors than this are an error: each has a model of its own.
MOST_DIMS = 16
KEY_ROWS, MOST_TABLES = 128, 64
#: The share of pairs at the threshold that the tables find, and that the Hamming radius lets through.
RECALL, WITHIN = 0.985, 0.998
#: Bits of a whole code: the first number of them that lets at most this share of unlike pairs through, else the last.
CODE_BITS, LET_THROUGH = (256, 512, 1024), 0.001
BLOCK, FAMILY_BLOCK = 256, 512


class Rotations:
    """A mean and projections to code bits, learned from unit vectors x; every `dim` bits are a rotation from another start."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0)
        z = x - self.mean
        _, axes = np.linalg.eigh(z.T @ z)
        self.axes = axes[:, ::-1]
        self.v = z @ self.axes
        self.held: list[np.ndarray] = []

    def projection(self, bits: int, steps: int = 30) -> np.ndarray:
        """Directions (columns) of at least `bits` bits."""
        dim = len(self.mean)
        while dim * len(self.held) < bits:
            r, _ = np.linalg.qr(np.random.default_rng(len(self.held)).normal(size=(dim, dim)))
            for _ in range(steps):
                b = np.where(self.v @ r >= 0, 1.0, -1.0)
                u, _, wt = np.linalg.svd(b.T @ self.v)
                r = (u @ wt).T
            self.held.append(self.axes @ r)
        return np.concatenate(self.held, axis=1)


def pairs_at(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of unit vectors with a cosine of just `least`, from vectors of x towards noise (kind 0) and towards other vectors of x (kind 1)."""
    draw = np.random.default_rng(1)
    a = x[draw.integers(0, len(x), 2 * PAIRS)]
    to = np.concatenate([draw.normal(size=(PAIRS, x.shape[1])), x[draw.integers(0, len(x), PAIRS)]])
    side = to - (to * a).sum(axis=1)[:, None] * a
    size = np.linalg.norm(side, axis=1)
    fine = size > 1e-9  # a vector has no direction towards itself
    if not fine.any():
        return x[:1], x[:1], np.zeros(1, dtype=np.int64)
    a, side = a[fine], side[fine] / size[fine][:, None]
    return a, least * a + np.sqrt(max(0.0, 1 - least * least)) * side, np.repeat([0, 1], PAIRS)[fine]


class Model:
    """Codes for vectors of one length: projection, substrings of `width` bits, how many tables, probes (0 or 1 bits) and radius."""

    def __init__(self, x: np.ndarray, least: float, n: int):
        rotations = Rotations(x)
        self.mean = rotations.mean
        near_a, near_b, kind = pairs_at(x, least)
        best, width = None, max(2, ceil(log2(max(2, n / KEY_ROWS)))) + 1
        while best is None and width > 1:
            width -= 1
            tried = MOST_TABLES // 4
            while best is None and tried <= MOST_TABLES:
                proj = rotations.projection(width * tried)
                unlike = ((near_a - self.mean) @ proj >= 0) ^ ((near_b - self.mean) @ proj >= 0)
                unlike = unlike[:, : width * tried].reshape(len(kind), tried, width).sum(axis=2)
                for probes in (0, 1):
                    met = np.logical_or.accumulate(unlike <= probes, axis=1)
                    share = np.min([met[kind == k].mean(axis=0) for k in np.unique(kind)], axis=0)  # the kind that is harder to find decides
                    tables = int(np.argmax(share >= RECALL)) + 1
                    rows = tables * (1 + probes * width / 2)
                    if share[-1] >= RECALL and (best is None or rows < best[0]):
                        best = rows, tables, probes
                tried *= 2
        if best is None:
            raise ValueError(f"no code finds pairs of a cosine of {least}")
        self.width, (_, self.tables, self.probes) = width, best
        other = np.random.default_rng(2).permutation(len(x))
        other = other[(x * x[other]).sum(axis=1) < least], np.flatnonzero((x * x[other]).sum(axis=1) < least)
        for bits in CODE_BITS:  # longer codes where the radius would let other pairs through
            self.proj = rotations.projection(max(bits, width * self.tables))[:, : max(bits, width * self.tables)]
            apart = self.apart(near_a, near_b)
            self.radius = int(max(np.quantile(apart[kind == k], WITHIN, method="higher") for k in np.unique(kind)))
            if (self.apart(x[other[0]], x[other[1]]) <= self.radius).sum() <= LET_THROUGH * len(x):
                break

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances of the codes of unit vectors."""
        return np.bitwise_count(packed(self.signs(a)) ^ packed(self.signs(b))).sum(axis=1, dtype=np.int64)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.proj >= 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The substring of each table."""
        cut = signs[:, : self.width * self.tables].reshape(len(signs), self.tables, self.width)
        return (cut * (1 << np.arange(self.width, dtype=np.int64))).sum(axis=2)


def packed(signs: np.ndarray) -> np.ndarray:
    b = np.packbits(signs, axis=1)
    b = np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))
    return np.ascontiguousarray(b).view(np.uint64)


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as unit vectors of doubles, scaled first so that no square overflows or vanishes."""
    x = matrix(column)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _code(models: dict[int, Model]):
    """For each node and table a row (tab, value, probe, node, code, dim): under its own key, and under its probes.

    Of two keys that differ by one bit, the code that has this bit unset looks up the other.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                model = models[int(dim)]
                signs = model.signs(unit(part.column(1)))
                keys, words = model.keys(signs), packed(signs)
                code = pa.array([w.tobytes() for w in words], pa.binary())
                node = part.column(0)
                for probe in range(-1, model.width if model.probes else 0):
                    who, tab = np.nonzero(keys >= 0 if probe < 0 else (keys >> probe) & 1 == 0)
                    value = keys[who, tab] | (0 if probe < 0 else 1 << probe)
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tab.astype(np.int32)), pa.array(value), pa.array(np.full(len(who), int(probe >= 0), dtype=np.int32)), node.take(at), code.take(at), pa.array(np.full(len(who), dim, dtype=np.int32))],
                        names=["tab", "value", "probe", "node", "code", "dim"],
                    )

    return f


def _within(radius: dict[int, int]):
    """Of each group of codes, links within the Hamming radius, as a spanning forest (a, b). Two probes are no pair: their own keys differ."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, "key"):
            node, own = t.column("node").to_numpy(), t.column("probe").to_numpy() == 0
            if len(node) < 2 or not own.any():
                continue
            words = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
            most = radius[int(t.column("dim")[0].as_py())]
            home = np.flatnonzero(own)
            step = max(1, 2_000_000 // max(1, words.size))
            a, b = [], []
            for at in range(0, len(home), step):
                here = home[at : at + step]
                apart = np.zeros((len(here), len(node)), dtype=np.uint16)
                for w in range(words.shape[1]):
                    apart += np.bitwise_count(words[here, w][:, None] ^ words[None, :, w])
                p, q = np.nonzero(apart <= most)
                keep = node[here[p]] != node[q]
                a.append(here[p[keep]])
                b.append(q[keep])
            _, place = np.unique(node, return_inverse=True)  # a node may be here as a probe and as itself
            names = np.unique(node)
            root = forest(len(names), place[np.concatenate(a)], place[np.concatenate(b)])
            told = np.flatnonzero(root != np.arange(len(names)))
            if len(told):
                yield pa.RecordBatch.from_arrays([pa.array(names[told]), pa.array(names[root[told]])], names=["a", "b"])

    return f


def _rerank(least: float):
    """Of each group of vectors, how many rows link to each node, and a spanning forest of all links: rows (a, b, links)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, "key"):
            node, side, copies = (t.column(n).to_numpy() for n in ("node", "side", "copies"))
            v = unit(t.column("v"))
            both = (side == 1).any()
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if both else np.arange(len(node))
            hit_p, hit_q = np.nonzero(v[p] @ v[q].T >= least - 1e-9)
            p, q = p[hit_p], q[hit_q]
            if not both:
                p, q = p[p < q], q[p < q]
            exact = np.einsum("ij,ij->i", v[p], v[q]) >= least
            p, q = p[exact], q[exact]
            if not len(p):
                continue
            links = np.bincount(p, copies[q], len(node)) + np.bincount(q, copies[p], len(node))
            order = np.argsort(node)
            place = np.empty(len(node), dtype=np.int64)
            place[order] = np.arange(len(node))
            root = order[forest(len(node), place[p], place[q])][place]
            told = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(node[root[told]]), pa.array(links[told].astype(np.int64))], names=["a", "b", "links"])

    return f


def in_blocks(rows: DataFrame, group: list[str], size: Column, block: int, node: str = "node") -> DataFrame:
    """Rows with key and side, once for each pair of blocks of their group; up to two blocks are one group, with all sides 0."""
    cut = rows.withColumn("__n", F.ceil(size / block)).withColumn("__own", F.pmod(F.xxhash64(node), F.col("__n")))
    other = F.when(F.col("__n") <= 2, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    cut = cut.withColumn("__other", F.explode(other))
    key = F.when(F.col("__other") < 0, F.xxhash64(*group)).otherwise(F.xxhash64(*group, F.least("__own", "__other"), F.greatest("__own", "__other")))
    side = F.when(F.col("__other") < 0, F.lit(0)).otherwise((F.col("__own") > F.col("__other")).cast("int"))
    return cut.withColumn("key", key).withColumn("side", side).drop("__n", "__own", "__other")


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Groups of vectors linked by a cosine of at least `least` (double precision).

    Returns one row for each row of vectors: the id, n_links (other rows linked directly),
    component_id (the smallest id reachable by links, itself included) and kept (id = component_id). No
    pair below `least` is linked; pairs at or above it are found with a probability of about RECALL times WITHIN at the
    threshold, and more above it. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and neither do vectors of unlike lengths. Equal vectors link. A
    repeated id is a row for each time, each linked by its own vector. Rows without an id link with nothing, and their
    component_id and kept are null. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    marks = lambda v: [F.xxhash64(v).alias("h0"), F.xxhash64(F.lit(7), v).alias("h1")]
    good = usable(vectors.where(F.col(id_col).isNotNull()), id_col, vec_col, as_it_is=True).select("id", "v", "dim", *marks("v"))
    folded = good.groupBy("h0", "h1").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    nodes = scratch.keep(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")
    counts = nodes.groupBy("dim").agg(F.count("*").alias("n")).limit(MOST_DIMS + 1).collect()
    if len(counts) > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} lengths")
    most = max([1, *(r["dim"] for r in counts)])
    sample = nodes.orderBy("h0", "h1").limit(max(1, min(FIT_ROWS, FIT_VALUES // most))).select("v", "dim").collect()
    models = {}
    for r in counts:
        x = np.array([s["v"] for s in sample if s["dim"] == r["dim"]], dtype=np.float64).reshape(-1, r["dim"])
        if len(x) < 2:  # too rare for the sample: random directions serve
            x = np.random.default_rng(r["dim"]).normal(size=(4 * r["dim"] + 2, r["dim"]))
        models[r["dim"]] = Model(x / np.linalg.norm(x, axis=1)[:, None], least, r["n"])

    at = scratch.keep(nodes.select("node", "v", "dim").mapInArrow(_code(models), "tab int, value long, probe int, node long, code binary, dim int"), "codes")
    key = ["tab", "value", "dim"]
    long = at.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > 2 * BLOCK)
    placed = at.join(small(scratch.keep(long, "long")), key, "left").withColumn("m", F.coalesce("m", F.lit(1).cast("long")))
    met = in_blocks(placed, key, F.col("m"), BLOCK).select("key", "node", "probe", "code", "dim")
    maybe = by_run(met, "key", None, _within({d: m.radius for d, m in models.items()}), "a long, b long").distinct()
    families = scratch.keep(components(maybe, scratch).withColumnRenamed("component", "family"), "families")
    scratch.drop(at)

    held = families.groupBy("family").agg(F.count("*").alias("m"))
    wanted = in_blocks(families.join(small(held), "family"), ["family"], F.col("m"), FAMILY_BLOCK).select("key", "side", "node")
    dealt = wanted.join(nodes.select("node", "copies", "v"), "node").select("key", "side", "node", "copies", "v")
    found = scratch.keep(by_run(dealt, "key", None, _rerank(least), "a long, b long, links long"), "found")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    comp = components(found.where("a <> b").select("a", "b"), scratch)
    lowest = comp.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("low"))
    comp = comp.join(lowest, "component").select("node", "low")
    answer = nodes.join(links, "node", "left").join(comp, "node", "left").where("copies > 1 or links > 0")
    answer = scratch.keep(answer.select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id")), "answer")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), *marks(vec_col))
    # rows that take no part have no node, and their vectors no equal among those that do
    out = rows.join(small(answer), (rows.h0 == answer.h0) & (rows.h1 == answer.h1) & rows.id.isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


#: Groups of `embeddings` at a cosine of 0.9, in DuckDB's SQL (all pairs: for small tables).
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
