"""Size-aware heavy-light Jaccard join on word shingles.

The sets are those of distinct k-word shingles of whole texts. Texts with equal sets are one *node*, so
copies are never expanded into pairs.

* Small sets enumerate their fixed-size subsets. Two sets of n and m elements link when they share at
  least o(n, m) elements; each set lists its subsets of every such size o, and sets that list a common
  subset meet.
* Large sets are put on inverted lists. A list does not belong to one shingle but to the shingles of a
  set in one of k ranges of hash values. k is one more than the most elements by which two linked sets of
  this size class can differ, so (by the pigeonhole principle) linked sets share at least one list.
  Lists of single shingles would grow with common passages; these grow mostly with sets that are alike.
  SPARE more ranges than that are made, so that linked sets share as many more lists. A set with few empty
  ranges leaves all of these, whose lists would hold a share of all sets of the class: what two sets lose
  so are ranges empty in both, no more than the few. Each set may also leave the longest of its long lists,
  half of the spare ones that remain, and linked sets still meet. That rids most texts of the lists that
  only a common passage made.
* The boundary is the size at which the listed subsets cost more rows than the inverted lists, taken
  from the size histogram of all documents.

Sets on a common list are compared by parity sketches, which bound the symmetric difference from below
and so never lose a link; what is left falls into families, in which whole sets are compared exactly.
Long lists and large families are cut into blocks, and each pair of blocks is a group of its own; lists that a
sample of nodes shows to be very long are never gathered, so that a task holds two blocks, or a list of
about HOT nodes before it is cut. No pair of documents is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, by_run, components, forest, mix, mix1, runs, signed, sliced, small

RATIO = 1.25
#: A set is never enumerated if its subsets would be more rows than this; whatever the table, inverted lists then cost less.
MOST_SUBSETS = 1_000_000
#: Spare ranges, as a share of the most elements by which linked sets differ; lists of more than LONG nodes are long.
SPARE, LONG = 0.25, 32
#: The low bits of a list's hash name its size class; the last name stands for subsets.
CLASS_BITS, SUBSETS = 127, 127
LIST_BLOCK = 1024
#: Lists of about HOT nodes or more, found by the sets of one node in EVERY, are dealt in blocks from the start.
HOT, EVERY = 8192, 32
FAMILY_BLOCK, FAMILY_BLOCK_MOST, FAMILY_BLOCKS = 64, 1024, 24
P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text.

    Words are what stands between ASCII white space, with A-Z lowered; fewer than k words are one
    shingle; no words (or null) give no shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(h))
    acc = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        acc *= P
        acc += h[j : len(h) - width + 1 + j]
    return np.unique(mix(acc + np.uint64(width)))


def node_of(s: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)))


def size_class(n: int) -> tuple[int, int, int]:
    """A set's class and the class's sizes [low, high)."""
    c, low, high = 0, 1, 2
    while n >= high:
        c, low, high = c + 1, high, max(high + 1, int(high * RATIO))
    return c, low, high


def ranges(top: int, num: int, den: int) -> tuple[int, int, int]:
    """For sets of less than top elements: the ranges of hash values, the most empty ones that a set leaves, and how many long lists it may leave."""
    most = 2 * (top - 1) * (den - num) // (den + num)
    spare = int(SPARE * most)
    empty = -(-3 * spare // 5)
    return most + 1 + spare, empty, (spare - empty) // 2


def tagged(hashes: np.ndarray, cls: int) -> np.ndarray:
    return ((hashes & ~np.uint64(CLASS_BITS)) | np.uint64(cls)).view(np.int64)


def lists_of(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The inverted lists of a large set, as signed hashes: those of its class, and of each larger one that it can link to."""
    classes = [size_class(len(s))]
    while den * len(s) >= num * classes[-1][2]:
        classes.append(size_class(classes[-1][2]))
    out = []
    mixed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(s + np.uint64(1)), dtype=np.uint64)])
    for cls, _, top in classes:
        k, empty, _ = ranges(top, num, den)
        part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        at = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
        seg = mixed[at[1:]] - mixed[at[:-1]]
        tag = mix(np.arange(k, dtype=np.uint64) + np.uint64(mix1(cls * 1_000_003 + 17)))
        held = at[1:] > at[:-1]
        out.append(tagged(mix(seg ^ tag)[held | (k - held.sum() > empty)], cls))
    return np.concatenate(out)


def subsets_of(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signed hashes of a small set's subsets of each size at which it can link."""
    n = len(s)
    least = -(-num * n // den)
    x = mix(s + np.uint64(1))
    total = np.add.reduce(x)
    out = []
    for gone in range(n - least + 1):
        gone_sum = np.array([np.add.reduce(x[list(g)]) if g else np.uint64(0) for g in combinations(range(n), gone)], dtype=np.uint64)
        out.append(mix((total - gone_sum) ^ np.uint64(mix1(n - gone + 7_000_003))))
    return tagged(np.concatenate(out), SUBSETS)


def sketch_of(s: np.ndarray) -> bytes:
    """Parities of the set's elements in a power of two of bits, at least as many as elements, at least 64."""
    bits = 64
    while bits < len(s):
        bits *= 2
    at = mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, bits: int) -> np.ndarray:
    """A sketch (words of 64 bits) at a smaller power of two of bits."""
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which sets enumerate subsets, of least total cost in rows.

    A subset costs a row. A list costs a row, and as many comparisons as unrelated sets of the class are
    expected on it (those whose range is empty in both).
    """
    best, at = None, 0
    total = lambda x: sum(c * cost_small(n, num, den) for n, c in sizes.items() if n <= x) + sum(c * cost_large(n, sizes, num, den) for n, c in sizes.items() if den * n >= num * (x + 1))
    for x in range(most_small(num, den) + 1):
        if best is None or total(x) < best:
            best, at = total(x), x
    return at


def most_small(num: int, den: int) -> int:
    """The size up to which a set has at most MOST_SUBSETS subsets to list."""
    n = 0
    while cost_small(n + 1, num, den) <= MOST_SUBSETS:
        n += 1
    return n


def cost_small(n: int, num: int, den: int) -> float:
    return sum(comb(n, d) for d in range(n - -(-num * n // den) + 1))


def cost_large(n: int, sizes: dict[int, int], num: int, den: int) -> float:
    _, low, high = size_class(n)
    k, _, _ = ranges(high, num, den)
    alike = sum(c for m, c in sizes.items() if low <= m < high)
    return k * (1 + alike * float(np.exp(-2 * n / k)))


def _scan(k: int, num: int, den: int, small_top: int):
    """Per document: its node and, once for each node and task, lists, sketch and (if small) the set."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            rows: dict[str, list] = {"id": [], "told": batch.column(2).to_pylist(), "node": [], "n": [], "lists": [], "sketch": [], "own": []}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(t, k)
                node = node_of(s) if len(s) and i is not None else None
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                rows["id"].append(i)
                rows["node"].append(node)
                rows["n"].append(len(s))
                rows["lists"].append(lists_of(s, num, den) if new and len(s) > small_top else None)
                rows["own"].append(s.view(np.int64) if new and len(s) <= small_top else None)
                rows["sketch"].append(sketch_of(s) if new else None)
            yield pa.RecordBatch.from_pydict(rows, schema=SCAN)

    return f


SCAN = pa.schema([("id", pa.int64()), ("told", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("lists", pa.list_(pa.int64())), ("sketch", pa.binary()), ("own", pa.list_(pa.int64()))])


def _light(num: int, den: int, x: int):
    """Rows (list, node) of the sets kept whole by _scan: subsets up to the boundary, lists from where they can meet larger sets."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.array(own, dtype=np.int64).view(np.uint64)
                n = len(s)
                for got in ([subsets_of(s, num, den)] if n <= x else []) + ([lists_of(s, num, den)] if den * n >= num * (x + 1) else []):
                    keys.append(got)
                    nodes.append(np.full(len(got), node, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["list", "node"])

    return f


def block_rows(members: np.ndarray, block: int, name: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, members) of each pair of blocks."""
    parts = [members[i : i + block] for i in range(0, len(members), block)]
    if len(parts) <= 2:
        yield name, members
        return
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            yield signed(mix1(name + i * 1_000_003 + j * 7)), np.concatenate([parts[i], parts[j]])


def _meet(blocks: bool):
    """From rows sorted by list, the lists of two nodes or more, equal ones once a task.

    First (blocks False) as rows (key, node, m): short lists under their own name and with m 0, long ones under
    their hash, with their size. Then (blocks True) cut into pairs of blocks, as rows (key, node, 0).
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()

        def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last list, perhaps not yet whole
            for batch in batches:
                k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(k):
                    continue
                cut = int(np.searchsorted(k, k[-1]))
                if cut or held and held[0][0][0] != k[-1]:
                    held.append((k[:cut], n[:cut]))
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append((k[cut:], n[cut:]))
            if held:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))

        for k, n in whole():
            edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, dtype=np.int64)
            many = np.flatnonzero(np.diff(edges) > 1)
            rows: list[tuple[int, np.ndarray, int]] = []
            for a, b in zip(edges[many], edges[many + 1], strict=True):
                members = np.unique(n[a:b])
                if len(members) < 2:
                    continue
                if not blocks and len(members) > LONG:
                    rows.append((int(k[a]), members, len(members)))
                    continue
                name = signed(int(mix(np.array([np.add.reduce(mix(members.view(np.uint64)))], dtype=np.uint64))[0]))
                if name not in told:
                    told.add(name)
                    rows += [(key, own, 0) for key, own in (block_rows(members, LIST_BLOCK, name) if blocks else [(name, members)])]
            if rows:
                sizes = [len(r[1]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], sizes), pa.int64()), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.repeat([r[2] for r in rows], sizes), pa.int64())], names=["key", "node", "m"])

    return f


def _alike(num: int, den: int):
    """Links (a, b) that the sketches of a group's sets allow, as a spanning forest."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for _, t in runs(batches, "key"):
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            order = np.lexsort((node, n))
            order = order[np.r_[True, node[order][1:] != node[order][:-1]]]
            node, n = node[order], n[order]
            raw = t.column("sketch").to_pylist()
            words = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
            a, b = [], []
            lens = np.array([len(w) for w in words])
            for width in np.unique(lens):
                # sets are sorted by size: compare those with this sketch length among themselves, and with the next length folded
                own = np.flatnonzero(lens == width)
                nxt = np.flatnonzero(lens == 2 * width)
                x = np.stack([words[i] for i in own])
                cand = np.r_[own, nxt]
                y = np.stack([words[i] for i in own] + [fold(words[i], int(width) * 64) for i in nxt])
                step = max(1, 4_000_000 // max(1, y.size))
                for at in range(0, len(own), step):
                    xs = own[at : at + step]
                    diff = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                    total = n[xs][:, None] + n[cand][None, :]
                    ok = (diff * (num + den) <= total * (den - num)) & (np.minimum(n[xs][:, None], n[cand][None, :]) * den >= np.maximum(n[xs][:, None], n[cand][None, :]) * num) & (xs[:, None] < cand[None, :])
                    p, q = np.nonzero(ok)
                    a.append(xs[p])
                    b.append(cand[q])
            root = forest(len(node), np.concatenate(a), np.concatenate(b))
            got = np.flatnonzero(root != np.arange(len(node)))
            out_a.append(node[got])
            out_b.append(node[root[got]])
            if sum(map(len, out_a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return f


def _sets(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingles(t, k) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "n", "own"])

    return f


def overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of sets[:first] with sets[first:] (of all with all, if first is 0), exactly.

    Counts by products of 0/1 blocks over the elements that two sets or more hold, so many columns at a time.
    """
    m = len(sets)
    every = np.concatenate(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.r_[True, every[1:] != every[:-1]]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    col, who = col[shared], who[shared]
    rows = first or m
    out = np.zeros((rows, m - first), dtype=np.float64)
    if len(col):
        col = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1
        width = max(256, 2_000_000 // m)
        for at in range(0, int(col[-1]) + 1, width):
            a, b = np.searchsorted(col, [at, at + width])
            block = np.zeros((m, width), dtype=np.float32)
            block[who[a:b], col[a:b] - at] = 1
            out += block[:rows] @ block[first:].T
    return out.astype(np.int64)


def _links(num: int, den: int):
    """Exact links of a group's sets, as a spanning forest (a, b)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, "key"):
            side, node, n = t.column("side").to_numpy(), t.column("node").to_numpy(), t.column("n").to_numpy()
            order = np.lexsort((node, side))
            raw = t.column("own").to_pylist()
            sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
            node, n, side = node[order], n[order], side[order]
            first = int((side == 0).sum()) if (side == 1).any() else 0
            both = overlaps(sets, first)
            total = (n[:first, None] + n[None, first:]) if first else (n[:, None] + n[None, :])
            p, q = np.nonzero(both * (num + den) >= num * total)
            root = forest(len(node), p, q + first)
            got = np.flatnonzero(root != np.arange(len(node)))
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(node[root[got]])], names=["a", "b"])

    return f


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Groups of texts linked by a Jaccard similarity of at least num/den of their k-word shingles.

    Returns one row for each row of docs: id, n_shingles (the set's size) and component_id (the smallest
    id reachable by links, the row's own included). Null and empty texts have no shingles, count 0 and are
    alone; so are rows without an id, whose component is null. A repeated id is a row for each time, each
    linked by its own text. An empty table gives an empty table. Other columns of docs are
    not read. Texts, shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("told", F.xxhash64("text"))
    top = most_small(num, den)
    scan = scratch.keep(source.mapInArrow(_scan(k, num, den, top), "id long, told long, node long, n long, lists array<long>, sketch binary, own array<long>"), "scan")

    sizes = {r["n"]: r["c"] for r in scan.where(f"n between 1 and {4 * top}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    x = boundary(sizes, num, den)

    def listed(sets: DataFrame) -> DataFrame:
        heavy = sets.where("lists is not null").select(F.explode("lists").alias("list"), "node")
        return heavy.unionByName(sets.where("own is not null").select("node", "own").mapInArrow(_light(num, den, x), "list long, node long"))

    # Where a node is repeated in other tasks, its lists are too: a list's nodes are counted once in each.
    seen = listed(scan.where(F.pmod(F.xxhash64("node"), F.lit(EVERY)) == 0)).distinct().groupBy("list").agg((F.count("*") * EVERY).alias("m"))
    hot = scratch.keep(seen.where(F.col("m") >= HOT), "hot")
    n_hot = hot.count()
    rows = listed(scan)
    cool = rows.join(small(hot, n_hot), "list", "left_anti") if n_hot else rows
    first = met_first = scratch.keep(by_run(cool, "list", None, _meet(False), "key long, node long, m long"), "lists")
    met_long = None
    if n_hot:
        met_long = scratch.keep(rows.join(small(hot, n_hot), "list").select(F.col("list").alias("key"), "node", "m").distinct(), "long")
        first = first.unionByName(met_long)
    # Each set leaves the longest of its long lists, as many of each size class as it may.
    may = [0] * (CLASS_BITS + 1)
    c, high = 0, 2
    while c < SUBSETS:
        may[c] = ranges(high, num, den)[2]
        c, _, high = size_class(high)
    cls = F.col("key").bitwiseAND(CLASS_BITS)
    place = F.row_number().over(W.partitionBy("node", cls).orderBy(F.desc("m"), "key"))
    kept = first.where("m > 0").withColumn("place", place).where(F.col("place") > F.element_at(F.array(*map(F.lit, may)), cls.cast("int") + 1)).select("key", "node", "m")
    long = by_run(kept.where(F.col("m") < HOT).select("key", "node"), "key", None, _meet(True), "key long, node long, m long")
    met = first.where("m = 0").unionByName(long).select("key", "node")
    if n_hot:
        blocks = F.ceil(F.col("m") / LIST_BLOCK)
        cut = kept.where(F.col("m") >= HOT).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> other")
        met = met.unionByName(cut.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node"))
    met = met.dropDuplicates(["key", "node"])
    sketches = scan.where("sketch is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    maybe = by_run(met.join(sketches, "node"), "key", None, _alike(num, den), "a long, b long").distinct()
    families = scratch.keep(components(maybe, scratch).withColumnRenamed("component", "family"), "families")
    for table in (hot, met_first, met_long):
        scratch.drop(table)

    nodes = scratch.keep(scan.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min_by("told", "id").alias("told"), F.count("*").alias("copies")), "nodes")
    wanted = scratch.keep(families.join(nodes, "node").select(F.col("least").alias("id"), "told", "node"), "wanted")
    text = source.join(small(wanted), ["id", "told"]).select("node", "text")
    sets = text.mapInArrow(_sets(k), "node long, n long, own binary").dropDuplicates(["node"])
    held = families.groupBy("family").agg(F.count("*").alias("m"))
    held = held.withColumn("blocks", F.ceil(F.col("m") / F.greatest(F.lit(FAMILY_BLOCK), F.least(F.lit(FAMILY_BLOCK_MOST), F.ceil(F.col("m") / FAMILY_BLOCKS)))))
    placed = families.join(small(held), "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # A family of one or two blocks is one group; of more, a group for each block and each pair of blocks.
    other = F.when(F.col("blocks") <= 2, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = placed.select("node", "family", "block", F.explode(other).alias("other")).select(
        "node",
        F.when(F.col("other") < 0, F.lit(0)).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
        F.when(F.col("other") < 0, F.xxhash64("family")).otherwise(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other"))).alias("key"),
    )
    links = by_run(dealt.join(sets, "node"), "key", None, _links(num, den), "a long, b long").distinct()
    joined = components(links, scratch)
    least = joined.join(nodes, "node", "left").groupBy("component").agg(F.min("least").alias("component_id"))
    told = joined.join(least, "component").select("node", "component_id")
    told = nodes.join(told, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), "copies").where("copies > 1 or component_id <> least").select("node", "component_id")
    told = scratch.keep(told, "told")
    for table in (families, nodes, wanted):
        scratch.drop(table)
    return scan.select("id", "node", "n").join(small(told), "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


#: Groups of `documents` on three-word shingles at 0.9, in DuckDB's SQL (pairs by common shingles: for small tables).
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
o AS (SELECT p.a, p.b FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b WHERE 100 * c >= 90 * (len(x.s) + len(y.s) - c)),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM g LEFT JOIN c ON c.a = doc_id
"""
