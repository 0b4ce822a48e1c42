"""Personal data: base spans against plain loops, the boosted trees, and what they add."""

import hashlib
import random
import re

import numpy as np
import pytest

from isobar.llm import personal_data as pii
from isobar.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(odd)) % 10 == 0


def valid(kind, t):
    d = re.sub("[^0-9]", "", t)
    return {"email": True, "ip": all(int(p) <= 255 for p in t.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    """Base spans (kind, start, end) by kind, then start."""
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def own_texts(rng, n):
    """Texts of pieces of all kinds, whole and broken."""
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "a@b", "@", ".", "_d@e.f", "1.2.3.4", "256.1.1.1", "000255.1.2.3", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "9", "12"]
    parts += ["+1 (017) 555-7713", "+", "+1", "(", ")", "-", " ", "  ", "\n", "é", "😀", "word", "at", "dot com", "00", "+4930123456", "5555555555554444", "name at host dot com"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def found(df):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in df.collect()}


def test_base_spans_equal_plain_loops(spark):
    texts = own_texts(random.Random(2), 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(pii.find_personal_data(df, pii.Model()))
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i]] == plain(t), t
    assert sum(map(len, got.values())) > 1000


def test_op12_equals_plain_loops(spark, sf):
    out = queries.QUERIES["op12_personal_data"](spark, sf)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n = 0
    for r in out.collect():
        base = plain(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        listed = ["{}:{}:{}".format(*b) for b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(every)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in every)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
        added = [s for s in spans if s not in base]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in spans if a != b), "what is added overlaps nothing"
        n += len(base)
    assert n > 0


def test_plan_has_no_python(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = pii.find_personal_data(df, pii.Model())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    kinds = [
        lambda: f"mail {rng.choice(['ann', 'bob.k', 'eve'])}{digits(2)}@mail{digits(1)}.example.com",
        lambda: f"host {'.'.join(str(rng.randrange(256)) for _ in range(4))}",
        lambda: f"card {card()}",
        lambda: f"call +1 ({digits(3)}) 555-{digits(4)}",
        lambda: f"on {digits(4)}-{digits(2)}-{digits(2)} version {digits(1)}.{digits(1)}",
        lambda: f"code {digits(16)} look at something",
        lambda: f"sizes {digits(2)} {digits(3)} {digits(3)}",
    ]
    texts = [f"word {rng.choice(kinds)()} and {rng.choice(kinds)()} end" for _ in range(3000)]
    return pii.train_personal_data(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_trees_add_spans_in_other_forms(spark, trained):
    assert {"email", "phone", "card"} <= set(trained.trees)
    texts = {
        1: "write to mail ann77 [at] mail3 [dot] example [dot] com today",
        2: "call (017) 555-7713 now",
        3: "on 2024-11-02 version 3.1 they look at something",
        4: "call +1 (017) 555-7713 9807915762804490 end",  # with the number behind it the base rule fails
        5: "plain text, nothing here",
    }
    got = found(pii.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), trained))
    spans = {i: [(k, texts[i][a:b]) for k, a, b, _ in s] for i, s in got.items()}
    assert any(k == "email" and t.endswith("ann77 [at] mail3 [dot] example [dot] com") for k, t in spans[1])
    assert ("phone", "(017) 555-7713") in spans[2] and spans[3] == [] and spans[5] == []
    assert ("phone", "+1 (017) 555-7713") in spans[4]


def test_held_out_accuracy_of_trees(trained, spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (4000, 3))
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(float)
    trees = pii.boost(x[:3000], y[:3000], np.ones(3000), ["a", "b", "c"])
    odds = sum(t.of(x[3000:], ["a", "b", "c"]) for t in trees)
    assert ((odds > 0) == (y[3000:] == 1)).mean() > 0.99
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x[3000:3100]], "a int, b int, c int").selectExpr("struct(struct(a, b, c) AS f) AS x")
    told = [r[0] for r in rows.selectExpr(" + ".join(t.sql() for t in trees)).collect()]
    assert np.allclose(told, odds[:100]), "SQL says what the trees say"


def test_threshold_by_precision():
    s, y, n = np.array([3.0, 2.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0, 0.0]), np.array([9.0, 10.0, 1.0, 5.0])
    assert pii.threshold(s, y, n, 0.95) == 1.5 and pii.threshold(s, y, n, 0.96) == 2.5 and pii.threshold(s, 0 * y, n, 0.5) is None


def test_odd_rows(spark, trained):
    rows = [(None, None, 1), (1, "", 2), (2, "a@b.c", 3), (2, "a@b.c", 3), (3, "😀é a@b.c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = pii.digest(pii.find_personal_data(df, trained)).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in out) == [(0, 0, ""), (1, 0, ""), (2, 1, "email:0:5"), (2, 1, "email:0:5"), (3, 1, "email:3:8")]
    clash = df.withColumnRenamed("spans", "__pii_text").withColumn("__pii_items", df.doc_id)
    assert pii.find_personal_data(clash, trained).columns == ["doc_id", "text", "__pii_text", "__pii_items", "spans"]
    assert pii.find_personal_data(df.limit(0), trained).count() == 0
    assert pii.train_personal_data(df.where("doc_id is null")) == pii.Model()


LONG = [("a" * 300_000, 0), ("1" * 300_000, 0), ("a.b." * 80_000 + "@", 0), ("a@b" + ".c" * 100_000, 1), ("+1" + " " * 300_000, 0), ("1 " * 100_000, 0), ("1.2.3." * 48_000, 36_000), ("a@b.c " * 8_000, 8_000), ("(" * 200_000 + "at", 0), ("4111 " * 60_000, 0)]


@pytest.mark.parametrize(("text", "base"), LONG)
def test_very_long_texts(spark, trained, text, base):
    """What plain loops would take hours for ends; the numbers of base spans are known."""
    got = found(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), trained))[1]
    assert sum(s[3] for s in got) == base


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.c or 1.2.3.4."), (2, "none"), (3, None), (4, "+4930123456 x")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_personal_data(df, pii.Model())).collect()}
    assert out == {1: "é mail [EMAIL] or [IP].", 2: "none", 3: None, 4: "[PHONE] x"}


def test_fit_reads_every_feature_vector(spark, monkeypatch):
    """20,000 vectors of a frequent kind leave out no rare one; Spark's sums give the trees of plain arrays, however rows are dealt."""
    names = list(pii.FEATURES)
    told = lambda f: [f.get(c, "0") + f" AS {c}" for c in names]
    many = {c: f"cast(id div {10**i} % 10 AS int)" for i, c in enumerate(names[:5])}
    often = spark.range(20_000).selectExpr("0 AS kind", "id % 3 = 0 AS held_out", "cast(id % 10 > 4 and id div 100 % 10 < 7 AS int) AS y", *told(many), "2L AS n")
    rare = spark.range(40).selectExpr("3 AS kind", "id % 4 >= 2 AS held_out", "cast(id % 2 AS int) AS y", *told({"plus": "cast(id % 2 AS int)", "first": "cast(id div 7 AS int)"}), "1L AS n")
    cells = often.unionByName(rare)
    monkeypatch.setattr(pii, "fit_cells", lambda docs, text_col="text": cells)
    monkeypatch.setattr(pii, "ROUNDS", 8)
    model = pii.train_personal_data(cells)
    assert set(model.trees) == {"email", "phone"}
    for k in model.trees:
        rows = cells.where(f"kind = {pii.KINDS.index(k)}").toPandas()
        fit, out = rows[~rows.held_out], rows[rows.held_out]
        trees = pii.boost(fit[names].to_numpy(), fit.y.to_numpy(), fit.n.to_numpy(), names)
        score = sum(t.of(out[names].to_numpy(), names) for t in trees)
        assert model.trees[k] == trees and model.least[k] == pii.threshold(score, out.y.to_numpy(), out.n.to_numpy(), pii.PRECISION)
    cells = cells.repartition(7, "digits")
    assert pii.train_personal_data(cells) == model
