"""Personal data by candidate gradient boosting, in SQL functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers of a strict form. Generators of high recall propose more spans, which may
overlap each other and the base ones: addresses written out ("name at host dot com"), numbers in other groups or next to further digits,
numbers without a plus. Boosted trees score a proposal by features of its format and of its context.

They are trained here, without labels of people: spans of the base rules are positive, also rewritten as a writer would (no plus, "at" for @,
other separators); proposals that touch no base span are negative. The fit sees the counts of all distinct feature vectors of the whole corpus, without a
sample or a cap. They stay in Spark: each level of a round's trees (of all kinds together) is one aggregation, of gradients by leaf, feature and value, and
only these sums reach the driver, whose number follows from the ranges of FEATURES. Half of the span texts are held out, and calibrate each kind's threshold:
the least score from which on PRECISION of the held-out proposals are positive. Trees are rendered as SQL expressions.

Gradients are summed as whole numbers, so that a fit gives the same trees however the rows are dealt. Values of leaves are multiples of 1 / GRID up to LEAF:
sums of trees are exact, and the scores that thresholds are chosen from are few.

A proposal is taken if it reaches its kind's threshold, touches no base span, and scores higher than the proposals that it overlaps (of a
chain, from left to right; ties stay with the first). Base spans always stay, also where they overlap each other.

Everything about a document happens in its row: no shuffle, no join, and the work grows with its text. Patterns have no nested repeats that could run
over a text twice, so that very long words cost no more than others.

Cases: a null or empty text has no spans; repeated rows are rows of their own; an empty table gives none, and a fit without positive spans adds nothing;
columns of any other name pass through. Starts and ends count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, fresh

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS, DEPTH, RATE, L2 = 24, 3, 0.3, 1.0
#: The largest value of a leaf, and how many values there are from one whole number to the next.
LEAF, GRID = 2.0, 1024
#: Rounds after which the odds so far are written, so that expressions stay short.
STAGED = 6
#: Spans that one step of a scan appends to at a time; keeps long lists linear.
BLOCK = 256

# The forms of the base rules. Where a run of characters cannot match from its start, it cannot from within, so starts are
# held to the start of a run (or to where the last match ended), and repeats give nothing back.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: What a match must hold besides, of x.t and its digits x.d.
VALID = {
    "email": "true",
    "ip": f"x.t rlike r'{OCTETS}'",
    "card": "length(x.d) between 13 and 19 and luhn_check(x.d)",
    "phone": "length(x.d) between 9 and 15",
}
_AT = r"(?: ?@ ?| ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?| (?:at|AT) )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| (?:dot|DOT) )"
_GAP = r"[ ./-]{0,2}"
PROPOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": rf"(?<![0-9])(?:[0-9]{{4}}(?:{_GAP}[0-9]{{4}}){{2}}{_GAP}[0-9]{{1,7}}|[0-9]{{4}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,5}[)]?){1,4}(?![0-9])",
}
#: Texts without these have no match of the kind.
GATES = {"email": "contains({t}, '@') or contains({t}, 'at') or contains({t}, 'AT')", "ip": "{d}", "card": "{d}", "phone": "{d}"}
#: How a writer might put a span of the base rules.
REWRITES = {
    "email": ["replace(x.t, '@', ' at ')", "replace(replace(x.t, '@', ' [at] '), '.', ' [dot] ')", "replace(x.t, '@', ' @ ')"],
    "ip": ["replace(x.t, '.', '[.]')"],
    "card": ["x.d", "regexp_replace(x.d, r'([0-9]{4})(?=[0-9])', '$1.')", "regexp_replace(x.d, r'([0-9]{4})(?=[0-9])', '$1  ')"],
    "phone": ["substr(x.t, 2)", "regexp_replace(x.t, r'^.[0-9]{1,3}[ .-]+', '')", "replace(replace(substr(x.t, 2), '(', ''), ')', '')", "regexp_replace(substr(x.t, 2), r'[ ().-]+', '.')"],
}
CUES = {1: "mail|correo|courriel|contact|kontakt|write|schreib", 2: "phone|tel|call|fax|mobil|handy|rufnummer", 3: "card|karte|carte|tarjeta|visa|payment", 4: r"\bip\b|host|server|address|adresse"}
_SIDE = "case when {0} = '' then 0 when {0} rlike r'[0-9]' then 4 when {0} rlike r'\\p{{L}}' then 3 when {0} rlike r'\\s' then 1 else 2 end"
#: Small whole numbers of a span x: its text t, digits d, what stands before (l) and behind (r).
FEATURES = {
    "digits": "least(length(x.d), 20)",
    "groups": "least(size(split(x.t, r'[^0-9]+')), 9)",
    "marks": "least(length(regexp_replace(x.t, r'[0-9A-Za-z]', '')), 9)",
    "sorts": "least(size(array_distinct(split(regexp_replace(x.t, r'[0-9A-Za-z]', ''), ''))), 5)",
    "plus": "cast(startswith(x.t, '+') or startswith(x.t, '00') as int)",
    "bracket": "cast(contains(x.t, '(') as int)",
    "luhn": "cast(length(x.d) between 12 and 19 and luhn_check(x.d) as int)",
    "octets": f"cast(regexp_replace(x.t, r'[^0-9]+', '.') rlike r'{OCTETS}' as int)",
    "at": "case when contains(x.t, '@') then 1 when x.t rlike r'[(\\[{] ?(?:at|AT)' then 2 when x.t rlike r' (?:at|AT) ' then 3 else 0 end",
    "tail": "cast(x.t rlike r'[A-Za-z]{2}$' as int)",
    "mixed": "cast(x.t rlike r'^[^@ ]*[._][^@ ]*[0-9]' as int)",
    "first": "least(length(regexp_extract(x.t, r'[0-9]+', 0)), 6)",
    "last": "least(length(x.t) - length(rtrim('0123456789', x.t)), 6)",
    "before": _SIDE.format("right(x.l, 1)"),
    "behind": _SIDE.format("left(x.r, 1)"),
    "cue": "case " + " ".join(f"when lower(x.l) rlike r'{words}' then {n}" for n, words in CUES.items()) + " else 0 end",
}

_F = f"struct<{', '.join(f'{n}: int' for n in FEATURES)}>"
_ITEM = f"struct<b: bigint, e: bigint, base: int, kind: int, score: double, f: {_F}, t: string>"


def _scan(items: str, zero: str, out: str, step: str) -> str:
    """SQL of (s, o) after steps over items x with an accumulator a: a state a.s and what was put out, a.o, an array of arrays of `out`."""
    blocks = f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), b -> slice({items}, b * {BLOCK} + 1, {BLOCK}))"
    inner = f"aggregate(block, named_struct('s', acc.s, 'o', cast(array() as array<{out}>)), (a, x) -> {step})"
    then = f"element_at(transform(array({inner}), r -> named_struct('s', r.s, 'o', concat(acc.o, array(r.o)))), 1)"
    return f"aggregate({blocks}, named_struct('s', {zero}, 'o', cast(array() as array<array<{out}>>)), (acc, block) -> {then})"


def _located(df: DataFrame, text: str, name: str, pattern: str, gate: str) -> DataFrame:
    """A column `name`: matches (b, e, t, d, l, r) of the pattern in `text`, by what `split` leaves between them."""
    hits, gaps = f"{name}__hits", f"{name}__gaps"
    df = df.withColumn(hits, F.expr(f"if({gate}, regexp_extract_all({text}, r'{pattern}', 0), cast(array() as array<string>))"))
    df = df.withColumn(gaps, F.expr(f"if(size({hits}) > 0, split({text}, r'{pattern}', -1), array({text}))"))
    items = f"transform({hits}, (x, i) -> named_struct('g', cast(length({gaps}[i]) as bigint), 't', x, 'l', right({gaps}[i], 24), 'r', left({gaps}[i + 1], 8)))"
    df = df.withColumn(name, F.expr(items))
    at = "a.s + x.g"
    span = f"named_struct('b', {at}, 'e', {at} + length(x.t), 't', x.t, 'd', regexp_replace(x.t, r'[^0-9]', ''), 'l', x.l, 'r', x.r)"
    step = f"named_struct('s', {at} + length(x.t), 'o', concat(a.o, array({span})))"
    found = f"flatten({_scan(name, 'cast(0 as bigint)', 'struct<b: bigint, e: bigint, t: string, d: string, l: string, r: string>', step)}.o)"
    return df.withColumn(name, F.expr(found)).drop(hits, gaps)


def _item(base: int, kind: int, score: str, features: bool) -> str:
    told = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in FEATURES.items()) + ")" if features else "null"
    return f"named_struct('b', x.b, 'e', x.e, 'base', {base}, 'kind', {kind}, 'score', cast({score} as double), 'f', cast({told} as {_F}), 't', x.t)"


def _proposed(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str], dict[str, str], str]:
    """docs with the base spans and the proposals of each kind; the names of these columns, and of the text."""
    text, digit, *names = fresh(docs, "__pii_text", "__pii_digit", *(f"__pii_{w}_{k}" for w in ("base", "more") for k in KINDS))
    base, more = dict(zip(KINDS, names[:4], strict=True)), dict(zip(KINDS, names[4:], strict=True))
    df = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(digit, F.expr(f"{text} rlike r'[0-9]'"))
    for k in KINDS:
        gate = GATES[k].format(t=text, d=digit)
        df = _located(df, text, base[k], BASE[k], f"contains({text}, '@')" if k == "email" else gate)
        df = _located(df, text, more[k], PROPOSE[k], gate)
        df = df.withColumn(base[k], F.expr(f"filter({base[k]}, x -> {VALID[k]})"))
    return df.drop(digit), base, more, text


def _free(df: DataFrame, items: str) -> DataFrame:
    """The column `items` (spans of `_ITEM`, base ones among them) as the proposals that touch no base span, the best where proposals overlap."""
    null = f"cast(null as {_ITEM})"
    put = "named_struct('s', named_struct('m', {m}, 'p', {p}), 'o', {o})"
    step = (
        f"case when x.base = 1 then {put.format(m='greatest(a.s.m, x.e)', p=f'if(a.s.p is not null and x.b < a.s.p.e, {null}, a.s.p)', o='a.o')} "
        "when x.b < a.s.m then a "
        f"when a.s.p is null then {put.format(m='a.s.m', p='x', o='a.o')} "
        f"when x.b < a.s.p.e then {put.format(m='a.s.m', p='if(x.score > a.s.p.score, x, a.s.p)', o='a.o')} "
        f"else {put.format(m='a.s.m', p='x', o='concat(a.o, array(a.s.p))')} end"
    )
    df = df.withColumn(items, F.expr(f"array_sort({items})"))
    df = df.withColumn(items, F.expr(_scan(items, f"named_struct('m', cast(-1 as bigint), 'p', {null})", _ITEM, step)))
    return df.withColumn(items, F.expr(f"concat(flatten({items}.o), if({items}.s.p is null, cast(array() as array<{_ITEM}>), array({items}.s.p)))"))


@dataclass
class Tree:
    """A split of a feature at a value (up to it: left), or a leaf; a leaf that may still be split has a number, its `node`."""

    feature: str | None = None
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0
    node: int = -1

    def sql(self, what: str = "value") -> str:
        return f"cast({getattr(self, what)!r} as double)" if self.feature is None else f"if(x.f.{self.feature} <= {self.cut}, {self.left.sql(what)}, {self.right.sql(what)})"

    def of(self, x: np.ndarray, names: list[str], what: str = "value") -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), getattr(self, what))
        on = x[:, names.index(self.feature)] <= self.cut
        return np.where(on, self.left.of(x, names, what), self.right.of(x, names, what))


def leaf(g: float, h: float) -> Tree:
    return Tree(value=float(np.clip(np.rint(GRID * RATE * g / (h + L2)) / GRID, -LEAF, LEAF)))


def divide(tree: Tree, sums: np.ndarray, weight: tuple[float, float], names: list[str]) -> list[Tree]:
    """Splits a leaf where that lowers the loss most by its second-order form, and gives the two new ones; none if nothing lowers it.

    `sums` has rows (feature, value, g and h where y is 0, g and h where y is 1), whole numbers by feature, then value."""
    of = lambda s: (weight[0] * s[..., 0] + weight[1] * s[..., 2], weight[0] * s[..., 1] + weight[1] * s[..., 3])
    every = sums[sums[:, 0] == 0, 2:].sum(axis=0)
    g, h = of(every)
    tree.value, tree.node = leaf(g, h).value, -1
    best = (1e-9, None, 0, None)
    for j in range(len(names)):
        rows = sums[sums[:, 0] == j]
        left = np.cumsum(rows[:, 2:], axis=0)[:-1]
        (gl, hl), (gr, hr) = of(left), of(every - left)
        gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - g**2 / (h + L2)
        if len(gain) and gain.max() > best[0]:
            at = int(gain.argmax())
            best = (gain[at], names[j], int(rows[at, 1]), left[at])
    if best[1] is None:
        return []
    _, tree.feature, tree.cut, left = best
    tree.left, tree.right = leaf(*of(left)), leaf(*of(every - left))
    return [tree.left, tree.right]


def class_weights(n: tuple[int, int], scale: int) -> tuple[float, float]:
    """What a row weighs where y is 0 and 1, of n such rows; both labels weigh alike."""
    return tuple(0.5 / max(m, 1) * min(sum(n), 10_000) / scale for m in n)


def grow(weights: dict[int, tuple[float, float]], names: list[str], sums: Callable, settle: Callable) -> dict[int, list[Tree]]:
    """Trees of each kind for the log odds of y.

    `sums` gives the sums of `divide` by (kind, node) for trees by kind, `settle` adds finished trees to the odds."""
    trees: dict[int, list[Tree]] = {k: [] for k in weights}
    for _ in range(ROUNDS):
        new = {k: Tree() for k in weights}
        leaves = {k: [t] for k, t in new.items()}
        for _ in range(DEPTH):
            for of_kind in leaves.values():
                for i, t in enumerate(of_kind):
                    t.node = i
            told = sums(new) if any(leaves.values()) else {}
            leaves = {k: [t for i, node in enumerate(of_kind) for t in divide(node, told[k, i], weights[k], names)] for k, of_kind in leaves.items()}
        settle(new)
        for k, t in new.items():
            trees[k].append(t)
    return trees


def whole(n: int) -> int:
    """The power of two by which gradients of n rows become whole numbers whose sums fit in a long."""
    return 1 << min(30, 62 - int(n).bit_length())


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, names: list[str]) -> list[Tree]:
    """The trees of one kind for rows in memory that count n times: what `train_personal_data` does with Spark's sums."""
    n, odds, scale = n.astype(np.int64), np.zeros(len(y)), whole(n.sum())

    def sums(trees: dict[int, Tree]) -> dict[tuple[int, int], np.ndarray]:
        p, node, told = 1 / (1 + np.exp(-odds)), trees[0].of(x, names, "node"), {}
        g, h = (n * np.rint(v * scale).astype(np.int64) for v in (y - p, p * (1 - p)))
        for i in range(node.max() + 1):
            rows = []
            for j in range(len(names)):
                values, at = np.unique(x[node == i, j], return_inverse=True)
                out = np.zeros((len(values), 6), np.int64)
                out[:, 0], out[:, 1] = j, values
                for c, (v, label) in enumerate([(g, 0), (h, 0), (g, 1), (h, 1)]):
                    np.add.at(out[:, c + 2], at, np.where(y == label, v, 0)[node == i])
                rows.append(out)
            told[0, i] = np.concatenate(rows)
        return told

    def settle(trees: dict[int, Tree]) -> None:
        odds[:] += trees[0].of(x, names)

    return grow({0: class_weights((n[y == 0].sum(), n[y == 1].sum()), scale)}, names, sums, settle)[0]


def threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> float | None:
    """Where scores from there on hold a share `precision` of positives, halfway to the next lower score; None if nowhere."""
    values, at = np.unique(-score, return_inverse=True)
    good = np.cumsum(np.bincount(at, n * y)) >= precision * np.cumsum(np.bincount(at, n))
    reached = np.flatnonzero(good)
    return float(-values[reached[-1] : reached[-1] + 2].mean()) if len(reached) else None


@dataclass
class Model:
    """Of each kind: trees and the threshold of their sum. A kind without an entry adds nothing."""

    trees: dict[str, list[Tree]] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)


def fit_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of feature vectors over all documents: (kind, held_out, y, the features, n)."""
    df, base, more, _ = _proposed(docs, text_col)
    every = "concat(" + ", ".join(f"transform({base[k]}, x -> {_item(1, j, '0', False)})" for j, k in enumerate(KINDS)) + ")"
    columns = []
    for j, k in enumerate(KINDS):
        forms = ", ".join(f"named_struct('b', x.b, 'e', x.e, 't', t, 'd', regexp_replace(t, r'[^0-9]', ''), 'l', x.l, 'r', x.r)" for t in ("t",))
        told = f"flatten(transform({base[k]}, x -> transform(array(x.t, {', '.join(REWRITES[k])}), t -> {forms})))"
        df = df.withColumn(more[k], F.expr(f"concat({every}, transform({more[k]}, x -> {_item(0, j, '0', True)}))"))
        df = _free(df, more[k])
        df = df.withColumn(base[k] + "_told", F.expr(f"transform({told}, x -> {_item(1, j, '0', True)})"))
        columns += [more[k], base[k] + "_told"]
    rows = df.select(F.explode(F.concat(*columns)).alias("x"))
    fold = F.pmod(F.xxhash64(F.regexp_replace("x.t", "[^0-9A-Za-z]", "")), F.lit(2)) == 1
    cells = rows.select("x.kind", fold.alias("held_out"), F.col("x.base").alias("y"), "x.f.*").groupBy("kind", "held_out", "y", *FEATURES)
    return cells.agg(F.count("*").alias("n"))


class Cells:
    """The feature vectors and their counts, staged with the odds so far; the sums and the settling of `grow` over them."""

    def __init__(self, cells: DataFrame):
        self.scratch = Scratch(cells.sparkSession)
        x = F.struct(F.struct(*FEATURES).alias("f")).alias("x")
        self.rows = self.scratch.keep(cells.select("kind", "held_out", "y", "n", x, F.lit(0.0).alias("odds")), "cells")
        self.totals = {(r["kind"], r["held_out"], r["y"]): r["n"] for r in self.rows.groupBy("kind", "held_out", "y").agg(F.sum("n").alias("n")).collect()}
        self.scale = whole(sum(self.totals.values()))
        self.since: list[dict[int, Tree]] = []  # trees that the staged odds lack

    @staticmethod
    def _by_kind(trees: dict[int, Tree], what: str, other: float) -> str:
        return "case kind " + " ".join(f"when {k} then {t.sql(what)}" for k, t in trees.items()) + f" else cast({other} as double) end"

    def _odds(self) -> str:
        return " + ".join(["odds", *(self._by_kind(t, "value", 0) for t in self.since)])

    def sums(self, trees: dict[int, Tree]) -> dict[tuple[int, int], np.ndarray]:
        rows = self.rows.where("not held_out").withColumn("node", F.expr(self._by_kind(trees, "node", -1)).cast("int")).where("node >= 0")
        rows = rows.withColumn("p", F.expr(f"1 / (1 + exp(-({self._odds()})))"))
        g, h = (F.expr(f"n * cast(rint({v} * {self.scale}) as bigint)") for v in ("(y - p)", "p * (1 - p)"))
        told = rows.select("kind", "node", "y", g.alias("g"), h.alias("h"), F.posexplode(F.array(*(f"x.f.{c}" for c in FEATURES))).alias("j", "v"))
        own = [F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)) for y in (0, 1) for c in "gh"]
        out: dict[tuple[int, int], list] = {}
        for r in sorted(tuple(r) for r in told.groupBy("kind", "node", "j", "v").agg(*own).collect()):
            out.setdefault(r[:2], []).append(r[2:])
        return {k: np.array(v, np.int64) for k, v in out.items()}

    def settle(self, trees: dict[int, Tree]) -> None:
        self.since.append(trees)
        if len(self.since) == STAGED:
            self.stage()

    def stage(self) -> None:
        if self.since:
            held, self.rows = self.rows, self.scratch.keep(self.rows.withColumn("odds", F.expr(self._odds())), "cells")
            self.scratch.drop(held)
            self.since = []

    def held_out(self) -> dict[int, np.ndarray]:
        """By kind, rows (score, y, n) of what is held out."""
        self.stage()
        out: dict[int, list] = {}
        for r in self.rows.where("held_out").groupBy("kind", "odds", "y").agg(F.sum("n").alias("n")).collect():
            out.setdefault(r["kind"], []).append((r["odds"], r["y"], r["n"]))
        return {k: np.array(v, np.float64) for k, v in out.items()}


def train_personal_data(docs: DataFrame, text_col: str = "text") -> Model:
    """Trees and thresholds from the base spans of docs and from proposals that touch none, all of them."""
    cells, model = Cells(fit_cells(docs, text_col)), Model()
    fit = [j for j in range(len(KINDS)) if {(j, False, 1), (j, True, 1)} <= set(cells.totals)]
    if fit:
        weights = {j: class_weights(tuple(cells.totals.get((j, False, y), 0) for y in (0, 1)), cells.scale) for j in fit}
        trees = grow(weights, list(FEATURES), cells.sums, cells.settle)
        held = cells.held_out()
        for j in fit:
            least = threshold(*held[j].T, PRECISION)
            if least is not None:
                model.trees[KINDS[j]], model.least[KINDS[j]] = trees[j], least
    cells.scratch.drop(cells.rows)
    return model


def find_personal_data(docs: DataFrame, model: Model, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """docs with a column of spans (kind, start, end, base, score) by kind as in KINDS, then start; base spans score null."""
    df, base, more, text = _proposed(docs, text_col)
    (items,) = fresh(docs, "__pii_items")
    parts = [f"transform({base[k]}, x -> {_item(1, j, 'null', False)})" for j, k in enumerate(KINDS)]
    for j, k in enumerate(KINDS):
        if k in model.trees:
            df = df.withColumn(more[k], F.expr(f"transform({more[k]}, x -> {_item(0, j, 'null', True)})"))
            odds = " + ".join(t.sql() for t in model.trees[k])
            scored = f"transform({more[k]}, x -> named_struct('b', x.b, 'e', x.e, 'base', 0, 'kind', {j}, 'score', {odds}, 'f', cast(null as {_F}), 't', x.t))"
            df = df.withColumn(more[k], F.expr(scored))
            parts.append(f"filter({more[k]}, x -> x.score >= {model.least[k]!r})")
    df = df.withColumn(items, F.expr(f"concat({', '.join(parts[:4])})"))
    own = fresh(docs, "__pii_own")[0]
    df = df.withColumn(own, F.expr(items))
    df = _free(df.withColumn(items, F.expr(f"concat({', '.join([items, *parts[4:]])})")), items)
    kind = f"element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1)"
    ordered = f"array_sort(transform(concat({own}, {items}), x -> named_struct('kind', x.kind, 'start', x.b, 'end', x.e, 'base', x.base = 1, 'score', x.score)))"
    told = f"transform({ordered}, x -> named_struct('kind', {kind}, 'start', x.start, 'end', x.end, 'base', x.base, 'score', 1 / (1 + exp(-x.score))))"
    keep = [c for c in docs.columns if c != spans]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.expr(told).alias(spans))


def redact(docs: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """docs (as from find_personal_data) whose texts have `[EMAIL]` and the like in place of spans; of spans that overlap one mark stays, that of the first."""
    text, items = fresh(docs, "__text", "__items")
    df = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(items, F.expr(f"array_sort(transform({spans}, x -> named_struct('b', x.start, 'e', x.end, 'k', x.kind)))"))
    cut = f"concat(substr({text}, a.s + 1, x.b - a.s), '[', upper(x.k), ']')"
    step = f"if(x.b < a.s, named_struct('s', greatest(a.s, x.e), 'o', a.o), named_struct('s', x.e, 'o', concat(a.o, array({cut}))))"
    df = df.withColumn(items, F.expr(_scan(items, "cast(0 as bigint)", "string", step)))
    made = F.expr(f"concat(array_join(flatten({items}.o), ''), substr({text}, {items}.s + 1))")
    return df.select(*(F.when(F.col(text_col).isNotNull(), made).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Rows (id, base spans by kind, the digest of the base spans, all spans)."""
    listed = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter({spans}, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = F.expr(f"sha2({listed.format(f'filter({spans}, x -> x.base)')}, 256)").alias("base_sha256")
    return docs.select(id_col, *counts, base, F.expr(listed.format(spans)).alias("spans"))
