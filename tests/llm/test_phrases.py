"""Periodic runs and phrase collocations, against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from isobar.llm import collocations, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All runs of a list of words, by trying each period."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(kept))


def laid(docs):
    """Documents end to end with words of their own, and where each starts."""
    seq, starts = [], []
    for k, w in enumerate(docs):
        starts.append(len(seq))
        seq += [x + 1000 * k for x in w] + [1000 * k + 999]
    return np.array(seq, np.int64), starts


def test_runs_equal_trying_each_period():
    rng = random.Random(3)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 5, 8, 20, 60, 150]), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 8 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        seq, starts = laid(docs)
        got = [tuple(map(int, r)) for r in zip(*periodic_runs.runs(seq))]
        assert sorted(got) == sorted((a + o, a + n + o, q) for o, w in zip(starts, docs) for a, n, q in plain_runs(w))


@pytest.mark.parametrize("period", [1, 2, 7, 50_000])
def test_runs_of_very_long_texts(period):
    found = periodic_runs.runs(np.r_[np.arange(200_000) % period, 10**6])
    assert [x.tolist() for x in found] == [[0], [200_000], [period]]


def test_suffix_array_and_smaller_values():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 80):
        seq = np.r_[rng.integers(0, 2, n), 9]
        s = periodic_runs.Suffixes(seq)
        assert s.order.tolist() == sorted(range(n + 1), key=lambda i: seq[i:].tolist())
        x = rng.integers(0, 4, n)
        on = np.flatnonzero(x)
        left, right = periodic_runs.nearest_smaller(x)
        assert left[on].tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in on]
        assert right[on].tolist() == [min((j for j in range(i + 1, n) if x[j] < x[i]), default=n) for i in on]


def test_op11_equals_plain_loops(spark, sf):
    got = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, sf).collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(plain_row(*r) for r in docs)
    assert sum(r[1] for r in got) > 0


def test_runs_of_odd_rows(spark):
    rows = [(None, "a " * 9, 1), (0, None, 2), (1, "", 3), (2, "\t \n", 4), (3, "x y " * 8 + " z", 5), (3, "x y " * 8 + " z", 5), (4, "word\x0b" * 1_500, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    key = lambda r: [(v is not None, v) for v in r]
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(df).collect()), key=key)
    assert [r[0] for r in got] == [None, 0, 1, 2, 3, 3, 4] and got[0][1:5] == (1, 0, 9, 1)
    assert got == sorted((plain_row(a, b) for a, b, _ in rows), key=key) and got[-1][1] == 1
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


# Collocations


def plain_collocations(rows, least, covered, top):
    f, n = Counter(), Counter()
    lower = str.maketrans(collocations.UPPER, collocations.LOWER)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out, longer = [], defaultdict(list)
    for (lang, p), b in f.items():
        if len(p) == 3 and b >= least:
            for part in {p[:2], p[1:]}:
                longer[lang, part].append(b)
    for lang in n:
        scored = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2 or a < least:
                continue
            if any(100 * b >= covered * a for b in longer[lang, p]):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r, p.decode(), -a, l, x, n[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "covered", "top", "window"), [(2, 50, 2000, 1 << 20), (3, 80, 7, 1 << 20), (2, 50, 2000, 8)])
def test_collocations_equal_plain_loops(spark, monkeypatch, least, covered, top, window):
    rng = random.Random(7)
    words = ["the", "The", "é", "ü-x", "\x00", "of", "a", "b", " "]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "! ", "  "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.choice([0, 1, 3, 60]))) for _ in range(60)] + [("en", None), ("xx", ""), ("en", "x y z. " * 2000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    batches = [b for b in df.fillna("und", ["lang"]).toArrow().to_batches()]
    monkeypatch.setattr(collocations, "WINDOW", window)
    packed = [r for b in collocations.stripes(batches, {("en", "x"): 3, ("en", "the"): 5}) for r in b.to_pylist()]
    merged, slot = Counter(), {}
    for r in packed:
        for line in r["stripe"].split("\n"):
            count, _, rest = line.partition(" ")
            merged[r["lang"], r["first"], rest] += int(count)
            assert slot.setdefault((r["lang"], r["first"], rest), r["slot"]) == r["slot"], "an element has one slot"
    assert merged["en", "x", ""] == merged["en", "x", "y"] == merged["en", "x", "y z"] == 2000 and ("en", "z", "x") not in merged
    monkeypatch.setattr(collocations, "WINDOW", 1 << 20)
    got = sorted(map(tuple, collocations.collocations(df, least, covered, top).collect()))
    assert got == plain_collocations(rows, least, covered, top)


def test_collocations_of_no_rows_and_counts_past_64_bits(spark):
    df = spark.createDataFrame([], "text string, lang string, f long, w int, phrase string, n int")
    assert collocations.collocations(df).count() == 0
    spark.range(1).selectExpr("9000000000000L a").createOrReplaceTempView("__big")
    exact = "(1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(a as decimal(19,0)) * cast(a + 1 as decimal(19,0)))"
    assert spark.sql(f"SELECT {exact} AS s FROM __big").first()["s"] == 1_000_000 * 9_000_000_000_000**2 // (9_000_000_000_000 * 9_000_000_000_001)
