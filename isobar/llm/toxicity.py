"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns a clause's words into symbols: I (insult), H (threat verb), T (target), M (intention), N (negation),
R (reported speech) and O (any other word). Insult stems and their weights are learned from labelled
documents; the closed classes are fixed lists. Transducers over these symbols mark insults and threats by what stands around
them, with a factor for each mark:

* insult: T, a target on either side of it;
* threat: T, a target after the verb, or before an intention and the verb ("you will be shot"); M, an intention before the verb.
  A threat verb that has no target is none, and weighs nothing;
* negation: N, a negation shortly before;
* reported speech: R, a report anywhere before, or shortly after.

Those that look ahead are composed into one deterministic transducer that reads a clause from its end, those that look back into
another that reads the first one's output from the start. A clause scores the sum of the weights of its insults and threats along
both paths. A document's score is a logistic function of its clauses' scores and of its sums by mark, fitted on the labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, add_score, sliced
from isobar.llm.fitting import labelled, newton

#: The bound of the fit: labelled documents read.
FIT_DOCS = 12_000
SHORT, LONG = 3, 9

# Fixed closed classes, in four languages.
TARGETS = "you your yours yourself u ur he she they them him her du dich dir dein deine ihr euch sie tu toi te ton ta vous votre ils elles usted ustedes ti tus vosotros"
INTENTIONS = "will would gonna going shall must should ought deserve deserves want wants werde werden wirst wird soll sollte will muss vais va vas allons veux dois voy vamos quiero debe debes merece"
NEGATIONS = "not no never nor none without cannot isn't aren't wasn't weren't don't doesn't didn't can't won't couldn't wouldn't shouldn't shan't ain't hasn't haven't hadn't mustn't nicht kein keine keinen nie niemals pas jamais ni sans nunca jamás tampoco sin"
REPORTS = "said says say told tells quote quoted wrote writes reported claimed claims according sagte sagt behauptet laut dit disait selon écrit dijo dice según escribió"
THREATS = "kill killing killed murder murdered hurt stab stabbed shoot shot strangle strangled destroy destroyed umbringen töten verletzen tuer tuerai frapper matar mataré herir"
THREAT_WEIGHT = 3.0
#: What a mark does to the weight, before the fit.
FACTORS = {"T": 1.5, "M": 1.5, "N": 0.4, "R": 0.6}
#: How many words further a mark reaches.
REACH = {"target before": 6, "target after": 4, "verb after intention": 3, "negation": 4, "report after": 12}

WORD = re.compile(r"\w+(?:'\w+)?")
ENDS = ".!?;\n"
STOP = re.compile(r"[.!?;\n]")

MARKS = "TMNR"
#: Insults and threats with any marks, and the other symbols.
HITS = [k + "".join(m for m, on in zip(MARKS, bits, strict=True) if on) for k in "IH" for bits in product((False, True), repeat=len(MARKS))]
SYMBOLS = [*HITS, "T", "M", "N", "R", "O"]


def marked(symbol: str, mark: str) -> tuple[str, float]:
    """An insult or a threat with one mark more, and the factor of that (1, if it has it already)."""
    return (symbol, 1.0) if mark in symbol[1:] else (symbol[0] + "".join(m for m in MARKS if m in symbol[1:] + mark), FACTORS[mark])


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over SYMBOLS: arcs[state, symbol] = (next state, symbol out, factor)."""

    start: object
    arcs: dict = field(hash=False)

    def compose(self, other: Transducer) -> Transducer:
        """First self, then other on self's output; factors multiply. Only reachable states are built."""
        arcs, todo, seen = {}, [(self.start, other.start)], {(self.start, other.start)}
        while todo:
            a, b = state = todo.pop()
            for s in SYMBOLS:
                a2, out, x = self.arcs[a, s]
                b2, out2, y = other.arcs[b, out]
                arcs[state, s] = ((a2, b2), out2, x * y)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer((self.start, other.start), arcs)

    def run(self, path: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """The symbols out of a path of weighted symbols, with their weights."""
        state, out = self.start, []
        for s, w in path:
            state, s, x = self.arcs[state, s]
            out.append((s, w * x))
        return out


def scope(opens: str, reach: int | None, mark: str, kinds: str = "IH") -> Transducer:
    """After a symbol `opens`, insults or threats get a mark, for so many symbols (None: to the end)."""
    arcs = {}
    top = reach or 1
    for left in range(top + 1):
        for s in SYMBOLS:
            hit = left and len(s) >= 1 and s in HITS and s[0] in kinds
            arcs[left, s] = (top if s == opens else left if reach is None else max(0, left - 1), *(marked(s, mark) if hit else (s, 1.0)))
    return Transducer(0, arcs)


def passive(reach: int) -> Transducer:
    """A target, an intention, then a threat verb, each within reach of the one before: the verb's target stands before it."""
    arcs = {}
    for stage in (0, 1, 2):  # nothing, a target, an intention after it
        for left in range(reach + 1):
            for s in SYMBOLS:
                went = (1, reach) if s == "T" else (2, reach) if s == "M" and stage and left else (stage, left - 1) if stage and left > 1 else (0, 0)
                arcs[(stage, left), s] = (went, *(marked(s, "T") if stage == 2 and left and s in HITS and s[0] == "H" else (s, 1.0)))
    return Transducer((0, 0), arcs)


def aimless() -> Transducer:
    """A threat verb without a target weighs nothing."""
    return Transducer(0, {(0, s): (0, s, 0.0 if s in HITS and s[0] == "H" and "T" not in s[1:] else 1.0) for s in SYMBOLS})


def grammar() -> tuple[Transducer, Transducer]:
    """What is read from the end of a clause, and what then from its start."""
    ahead = scope("T", REACH["target after"], "T").compose(scope("R", REACH["report after"], "R"))
    insult = scope("T", REACH["target before"], "T", "I")
    threat = passive(REACH["verb after intention"]).compose(scope("M", REACH["verb after intention"], "M", "H")).compose(aimless())
    back = insult.compose(threat).compose(scope("N", REACH["negation"], "N")).compose(scope("R", None, "R"))
    return ahead, back


@dataclass
class Lexicon:
    stems: dict[str, float]
    words: dict[str, float]

    def symbol(self, word: str) -> tuple[str, float]:
        w = self.words.get(word)
        if w is not None:
            return "I", w
        for n in range(SHORT, min(LONG, len(word)) + 1):
            w = self.stems.get(word[:n])
            if w is not None:
                return "I", w
        return CLOSED.get(word, ("O", 0.0))


CLOSED = {w: (s, THREAT_WEIGHT if s == "H" else 0.0) for s, ws in (("M", INTENTIONS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in ws.split()}


class Grammar:
    """A lexicon and the composed grammar, ready to read texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, (self.ahead, self.back) = lexicon, grammar()
        self.find = ahocorasick.Automaton()
        for w in [*lexicon.stems, *lexicon.words, *THREATS.split()]:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def weigh(self, path: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """The marked insults and threats of a clause's symbols, with their weights."""
        out = self.back.run(self.ahead.run(path[::-1])[::-1])
        return [(s, w) for s, w in out if s in HITS and w > 0]

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """The insults and threats of each clause that holds any."""
        low = text.lower().replace("\u2019", "'")
        done = 0
        for end, n in self.find.iter(low):
            begin = end - n + 1
            if begin < done or (begin and (low[begin - 1].isalnum() or low[begin - 1] == "_")):
                continue
            left = max(low.rfind(c, done, begin) for c in ENDS) + 1 or done
            right = STOP.search(low, end + 1)
            stop = right.start() if right else len(low)
            done = stop
            found = self.weigh([*map(self.lexicon.symbol, WORD.findall(low, left, stop))])
            if found:
                yield found

    def features(self, text: str | None) -> list[float]:
        """One, the two worst clauses, their sum and its density, and the sums of threats and by mark."""
        hits = [*self.clauses(text)] if text else []
        found = sorted((sum(w for _, w in clause) for clause in hits), reverse=True)
        own = lambda fits: log(1 + sum(w for clause in hits for s, w in clause if fits(s)))
        return [
            1.0, found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, log(1 + sum(found)), min(1.0, 60 * sum(found) / (1 + len(text))) if found else 0.0,
            own(lambda s: s[0] == "H"), *(own(lambda s, m=m: m in s[1:]) for m in MARKS),
        ]


@dataclass
class Model:
    lexicon: Lexicon
    weight: np.ndarray

    def scores(self, texts: Iterable[str | None], held: Grammar) -> np.ndarray:
        x = np.array([held.features(t) for t in texts]).reshape(-1, len(self.weight))
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))


def patterns(text: str) -> set[str]:
    """The whole words of a text, and the stems (prefixes, with an asterisk) that two words or more of it share or one repeats.

    A stem in one word may be chance; an insult's forms come in numbers.
    """
    words, stems = Counter(WORD.findall(text.lower().replace("\u2019", "'"))), Counter()
    for w, n in words.items():
        for end in range(SHORT, min(LONG, len(w)) + 1):
            stems[w[:end]] += n
    return {w for w in words if len(w) >= SHORT} | {f"{p}*" for p, n in stems.items() if n > 1}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a partition hold each pattern, by label."""
    count: Counter[tuple[str, int]] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in count], pa.string()), pa.array([y for _, y in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["pattern", "y", "n"])

    for batch in batches:
        for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t:
                count.update((p, label) for p in patterns(t))
            if len(count) > 400_000:
                yield told()
                count.clear()
    yield told()


def odds(a: Column, b: Column, n_pos: int, n_neg: int) -> Column:
    return F.log((a + 0.5) / (n_pos + 1)) - F.log((b + 0.5) / (n_neg + 1))


def surprise(a: Column, b: Column, base: float) -> Column:
    """The likelihood ratio of a pattern in `a` toxic and `b` other documents against the common share `base`."""
    share = a / (a + b)
    return F.when(share > base, 2 * (a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0.0))).otherwise(0.0)


def tried(held: dict[int, int], base: float) -> int:
    """How many patterns chance has tries with, of held[n] patterns in n toxic documents: those of enough documents that they could pass at all (Tarone)."""
    for n in sorted(held):
        many = sum(c for m, c in held.items() if m >= n)
        if 2 * n * log(1 / base) >= least(many):
            return many
    return 0


def least(many: int) -> float:
    """The likelihood ratio that chance alone seldom reaches in so many tries."""
    return 2 * log(max(2, many)) + 1


def telling(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """Of rows (pattern, pos, neg), those far commoner in toxic documents: rows (pattern, pos, odds, ratio). Few pass, however many are tried."""
    base = n_pos / (n_pos + n_neg)
    held = {r["pos"]: r["count"] for r in counts.where("pos > 0").groupBy("pos").count().collect()}  # no more rows than toxic documents
    a, b = F.col("pos"), F.col("neg")
    judged = counts.select("pattern", "pos", odds(a, b, n_pos, n_neg).alias("odds"), surprise(a, b, base).alias("ratio"))
    return judged.where((F.col("ratio") >= least(tried(held, base))) & (F.col("odds") >= 1.5))


def choose(fine: list[tuple[str, int, float, float]]) -> Lexicon:
    """Insult stems and words from telling patterns (pattern, toxic documents, odds, ratio).

    Taken in order of that ratio; among nested stems only the first is kept, lengthened while it keeps
    95 % of its toxic documents, so that it covers a word's forms and no more. A weight is the log odds.
    """
    pos, odd = {p: n for p, n, _, _ in fine}, {p: o for p, _, o, _ in fine}
    stems, words = {}, {}
    taken: list[str] = []
    for p, *_ in sorted(fine, key=lambda r: (-r[3], -len(r[0]), r[0])):
        own = p.rstrip("*")
        if any(own.startswith(t) or t.startswith(own) for t in taken):
            continue
        if p.endswith("*"):
            while longer := [q for q in pos if q.endswith("*") and len(q) == len(own) + 2 and q.startswith(own) and pos[q] >= 0.95 * pos[own + "*"]]:
                own = longer[0].rstrip("*")
        if not p.endswith("*") or pos.get(own, 0) >= 0.95 * pos[own + "*"]:
            words[own] = min(8.0, odd[own])
        else:
            stems[own] = min(8.0, odd[own + "*"])
        taken.append(own)
    return Lexicon(stems, words)


def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's five-word shingles, which near copies mostly share."""
    for batch in batches:
        low: list[list[int]] = [[], []]
        for t in batch.column(1).to_pylist():
            words = (t or "").split()
            grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
            for seed, out in enumerate(low):
                out.append(min(xxhash.xxh64_intdigest(g, seed=seed) for g in grams) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low[0], pa.int64()), pa.array(low[1], pa.int64())], names=["__id", "text", "y", "m0", "m1"])


def _features(lexicon: Lexicon):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Grammar(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return f


def train_toxicity(docs: DataFrame, labels: DataFrame, fit_on: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kept = labelled(docs, labels, "toxic", fit_on, FIT_DOCS, id_col, text_col)
    # One of each group of near copies, else a copied text's words look like a common pattern.
    kept = kept.mapInArrow(minima, ", ".join(f"{n} {t}" for n, t in kept.dtypes) + ", m0 long, m1 long").dropDuplicates(["y", "m0"]).dropDuplicates(["y", "m1"])
    kept = scratch.keep(kept, "labelled")
    rows = kept.select("text", "y")
    sizes = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.mapInArrow(_counts, "pattern string, y int, n long").groupBy("pattern").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    lexicon = Lexicon({}, {})
    if n_pos and n_neg:
        counted = scratch.keep(counted, "patterns")
        lexicon = choose([(r["pattern"], r["pos"], r["odds"], r["ratio"]) for r in telling(counted, n_pos, n_neg).collect()])
        scratch.drop(counted)
    seen = sorted((tuple(r["x"]), r["y"]) for r in rows.mapInArrow(_features(lexicon), "x array<double>, y int").collect())
    scratch.drop(kept)
    if not n_pos or not n_neg:
        return Model(lexicon, np.r_[-5.0 if not n_pos else 5.0, np.zeros(len(Grammar(lexicon).features(None)) - 1)])
    x, y = np.array([a for a, _ in seen]), np.array([b for _, b in seen], dtype=float)
    return Model(lexicon, newton(x, y, 1.0, free=0))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score` (0 to 1, higher is more toxic) of each whole text.

    One pass without a shuffle. Null and empty texts have no clauses and get the score of a text without
    matches. Repeated rows are scored alike; equal scores fall on one side of any cut. Other columns are kept, whatever their
    names, and one that is named like `score` is replaced. An empty table gives an empty table.
    """

    def make():
        held = Grammar(model.lexicon)
        return lambda texts: model.scores(texts.to_pylist(), held)

    return add_score(docs, text_col, score, make)
