"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

Weights go down a tree (such as domain, language, source). At each node the budget is shared by weight; a
child that holds too little passes its shortage to its siblings, and only what all siblings together cannot hold
goes up to the parent's siblings. A leaf takes whole epochs of its documents and a token-prefix of one
more, each epoch in an order of its own from a seed.

The prefix needs no sort of a leaf: tokens are summed by ranges of the order's hash, and only the range in
which the budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from isobar.llm.common import fresh
from pyspark.sql import functions as F

#: Leaves are categories, planned on the driver; more of them than this is an error.
MOST_LEAVES = 100_000
#: Documents of a leaf in one range of the order, and the most ranges of a leaf.
RANGE_ROWS, MOST_RANGES = 500, 1 << 16


def share(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of a budget for children (weight, capacity): by weight, shortages again by weight among the rest.

    Children without weight get something only when those with weight are full.
    """
    out = [0.0] * len(children)
    for weighted in (True, False):
        open_ = [i for i, (w, cap) in enumerate(children) if (w > 0) == weighted and cap > 0]
        left = budget - sum(out)
        while open_ and left > 1e-9:
            total = sum(children[i][0] if weighted else 1.0 for i in open_)
            full = [i for i in open_ if left * (children[i][0] if weighted else 1.0) / total >= children[i][1]]
            for i in full or open_:
                out[i] = children[i][1] if full else left * (children[i][0] if weighted else 1.0) / total
            if not full:
                break
            open_ = [i for i in open_ if i not in full]
            left = budget - sum(out)
    return out


def budgets(tokens: dict[tuple[str, ...], int], weight: Callable[[tuple[str, ...]], float], budget: float, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens to take from each leaf; weight gives a node's weight among its siblings by its path."""
    out: dict[tuple[str, ...], int] = {}

    def down(prefix: tuple[str, ...], leaves: list[tuple[str, ...]], amount: float) -> None:
        if len(leaves) == 1 and len(prefix) == len(leaves[0]):
            out[prefix] = int(round(min(amount, tokens[prefix] * max_epochs)))
            return
        below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for leaf in leaves:
            below.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        nodes = sorted(below)
        for node, got in zip(nodes, share(amount, [(weight(n), max_epochs * sum(tokens[x] for x in below[n])) for n in nodes]), strict=True):
            down(node, below[node], got)

    if tokens:
        down((), list(tokens), budget)
    return out


def mix(
    docs: DataFrame, levels: list[Column], weight: Callable[[tuple[str, ...]], float], share_of_tokens: float = 1.0,
    max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """The chosen rows of docs, once for each epoch that takes them, with columns __level0.., __tokens and __epoch (longer names, if docs has these).

    The budget is share_of_tokens of all tokens; a leaf gives at most max_epochs times its own. Tokens are
    estimated as a quarter of the characters, rounded up, unless a column is given. In an epoch's order, a
    leaf's documents are taken until their sum is nearest to the leaf's budget. Null levels are a level of
    their own, "(none)"; null and empty texts hold no tokens, and are taken if the prefix passes them; a leaf without
    tokens gives nothing. Repeated rows are documents of their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    names = fresh(docs, *(f"__level{i}" for i in range(len(levels))))
    size, epoch, full, rest, ranges, order, at, total, end, before, more, times = fresh(docs, *(f"__{n}" for n in "tokens epoch full rest ranges order range sum end before more times".split()))
    held_by = tokens if tokens is not None else F.ceil(F.coalesce(F.length(F.col(text_col)), F.lit(0)) / 4)
    rows = docs.select("*", *(F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(names, levels, strict=True)), held_by.cast("long").alias(size))
    leaves = rows.groupBy(*names).agg(F.sum(size).alias(total), F.count("*").alias(times)).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    held = {tuple(r[n] for n in names): (int(r[total]), r[times]) for r in leaves}
    take = budgets({k: t for k, (t, _) in held.items()}, weight, share_of_tokens * sum(t for t, _ in held.values()), max_epochs)
    plan = []
    for leaf, amount in take.items():
        t, n = held[leaf]
        if t:
            plan.append((*leaf, amount // t, amount % t, min(MOST_RANGES, 1 << max(0, (n // RANGE_ROWS).bit_length()))))
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{full}` long, `{rest}` long, `{ranges}` long"
    planned = rows.join(F.broadcast(spark.createDataFrame(plan, schema)), names)
    # the hash, as a number from 0 to 2**32 - 1, times the ranges, over 2**32
    placed = planned.withColumn(order, F.xxhash64(F.lit(seed), F.col(full), F.col(id_col))).withColumn(at, F.shiftright((F.shiftrightunsigned(order, 32)) * F.col(ranges), 32))
    sums = placed.groupBy(*names, at, rest).agg(F.sum(size).alias(total))
    ahead = F.coalesce(F.sum(total).over(W.partitionBy(*names).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn(before, ahead).where(F.col(before) + F.col(total) > F.col(rest)).groupBy(*names).agg(F.min(F.struct(at, before)).alias(end))
    ends = ends.select(*names, F.col(end)[at].alias(end), F.col(end)[before].alias(before))
    known = placed.join(F.broadcast(ends), names, "left")  # a row for each leaf at most
    early = known.where(F.col(end).isNull() | (F.col(at) != F.col(end))).withColumn(more, (F.col(end).isNull() | (F.col(at) < F.col(end))).cast("long"))
    within = W.partitionBy(*names).orderBy(order, F.col(id_col), F.xxhash64(F.col(text_col))).rowsBetween(W.unboundedPreceding, 0)
    last = known.where(F.col(at) == F.col(end)).withColumn(total, F.sum(size).over(within))
    last = last.withColumn(more, (F.col(before) + F.col(total) - F.col(size) / 2 <= F.col(rest)).cast("long")).drop(total)
    taken = early.unionByName(last).withColumn(times, F.col(full) + F.col(more)).where(F.col(times) > 0)
    return taken.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))).select(*(F.col(f"`{c}`") for c in docs.columns), *names, size, epoch)
