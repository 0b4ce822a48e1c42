"""Joins, searches and duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import block_matrix_knn
from isobar.llm.block_matrix_knn import nearest
from isobar.llm.common import SENT_ROWS, Scratch, components, forest, runs
from isobar.llm.itq_dedup import near_duplicates
from isobar.llm.itq_dedup import Model, packed, pairs_at
from isobar.llm.ngram_jaccard import boundary, cost_small, jaccard_groups, lists_of, most_small, overlaps, ranges, shingles, size_class, subsets_of

DOCS = "doc_id long, text string"


def brute_groups(rows, k, num, den):
    """Components of exact Jaccard links of the sets of word shingles."""

    def own(t):
        w = [x for x in (t or "").encode().lower().split()]
        if not w:
            return set()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    sets = [own(t) for _, t in rows]
    ids = np.array([i for i, _ in rows])
    order = np.argsort(ids, kind="stable")
    a, b = [], []
    for p in range(len(rows)):
        for q in range(p):
            x, y = sets[order[p]], sets[order[q]]
            if x and y and den * len(x & y) >= num * len(x | y):
                a.append(p)
                b.append(q)
    root = forest(len(rows), np.array(a, dtype=int), np.array(b, dtype=int))
    return sorted((int(ids[order[p]]), len(sets[order[p]]), int(ids[order[root[p]]])) for p in range(len(rows)))


def corpus(seed, sizes, copies, edits):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 30))
    rows, n = [], 0
    for size in sizes:
        base = list(rng.choice(words, size))
        for _ in range(copies):
            t = base.copy()
            for _ in range(int(rng.integers(0, edits + 1))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
            if rng.random() < 0.3:
                t = passage + t
            rows.append((n, " ".join(t)))
            n += 1
    return rows


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, k, num):
    rows = corpus(k, [4, 8, 9, 12, 15, 20, 25, 40, 80, 150, 300], 14, 4)
    out = jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(5), k=k, num=num, den=100)
    assert sorted(map(tuple, out.collect())) == brute_groups(rows, k, num, 100)


def test_jaccard_long_lists_and_large_families(spark, monkeypatch):
    import isobar.llm.ngram_jaccard as j

    monkeypatch.setattr(j, "LONG", 4)
    monkeypatch.setattr(j, "LIST_BLOCK", 8)
    monkeypatch.setattr(j, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(j, "FAMILY_BLOCK_MOST", 16)
    rows = corpus(7, [60, 61], 60, 3)
    out = jaccard_groups(spark.createDataFrame(rows, DOCS), k=3, num=80, den=100)
    assert sorted(map(tuple, out.collect())) == brute_groups(rows, 3, 80, 100)


def test_jaccard_very_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    import isobar.llm.ngram_jaccard as j

    for name, value in (("LONG", 4), ("LIST_BLOCK", 8), ("HOT", 24), ("EVERY", 2)):
        monkeypatch.setattr(j, name, value)
    rows = corpus(8, [60, 10, 9], 80, 3)
    out = jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(6), k=3, num=80, den=100)
    assert sorted(map(tuple, out.collect())) == brute_groups(rows, 3, 80, 100)


def test_jaccard_long_lists_across_batches():
    import pyarrow as pa

    from isobar.llm.ngram_jaccard import _meet

    k, n = np.repeat([1, 2, 3, 4], [1, 700, 3, 1]), np.arange(705)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(n[a:b])], names=["list", "node"])
    for cuts in ([0, 705], [0, 1, 2, 300, 699, 701, 702, 705], [0, 350, 700, 704, 705]):
        got = [(r["key"], r["node"], r["m"]) for b in _meet(False)(map(batch, cuts, cuts[1:])) for r in b.to_pylist()]
        assert sorted(x for _, x, m in got if m == 700) == list(range(1, 701)) and sorted(x for _, x, m in got if m == 0) == [701, 702, 703]


def test_jaccard_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, a), (5, b), (1, a.replace("a79", "x")), (2, b.replace("b79", "x")), (None, a)]
    got = [tuple(r) for r in jaccard_groups(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, 78, 1), (2, 78, 2), (5, 78, 1), (5, 78, 2), (None, 78, None)], key=str)


def test_jaccard_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (3, "one"), (9, "a b"), (10, "A\tB"), (2, "x " * 5000), (1, "X " * 5000), (4, "x"), (11, "ÄB c d"), (12, "äB c d")]
    df = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df).collect()}
    assert got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (0, 7)
    assert got[8] == (1, 3) and got[9] == got[10] == (1, 9)
    assert got[1] == got[2] == (1, 1) and got[4] == (1, 4)
    assert got[11] != got[12], "only A-Z are lowered"
    assert jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    twice = jaccard_groups(spark.createDataFrame([(1, "a b c d"), (1, "a b c d")], DOCS)).collect()
    assert [tuple(r) for r in twice] == [(1, 2, 1)] * 2


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (65, 100)])
def test_linked_sets_share_enough_lists(num, den):
    rng = np.random.default_rng(1)
    for n in (9, 12, 30, 100, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(20):
            gone = int(rng.integers(0, max(1, (den - num) * n // (num + den)) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both < num * (len(a) + len(b) - both):
                continue
            shared = np.intersect1d(lists_of(a, num, den), lists_of(b, num, den))
            _, _, high = size_class(max(len(a), len(b)))
            _, _, leave = ranges(high, num, den)
            assert len(shared) >= 1 + 2 * leave
            if max(len(a), len(b)) <= 14:
                assert len(np.intersect1d(subsets_of(a, num, den), subsets_of(b, num, den)))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_empty_ranges_do_not_bring_sets_together(num, den):
    rng = np.random.default_rng(3)
    own = [set(lists_of(np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64)), num, den).tolist()) for _ in range(200)]
    met = sum(bool(own[i] & own[j]) for i in range(200) for j in range(i))
    assert met <= 199, "unlike sets share a list in at most one of a hundred pairs"


def test_boundary_and_overlaps():
    assert boundary({}, 90, 100) == 0
    few, many = (boundary({n: c for n in range(1, 60)}, 90, 100) for c in (1000, 10**11))
    assert 0 <= few < many < most_small(90, 100), "cost alone decides: the limit of rows is not reached"
    assert cost_small(most_small(80, 100), 80, 100) <= 1_000_000 < cost_small(most_small(80, 100) + 1, 80, 100)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 20, 60)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = overlaps(sets, 0)
    assert all(got[p][q] == want[p][q] for p in range(4) for q in range(4) if p != q)
    assert (overlaps(sets, 2) == np.array(want)[:2, 2:]).all()
    assert len(shingles(b"a b", 3)) == 1 and len(shingles(b"", 3)) == 0 and len(shingles(None, 3)) == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    got = {r["node"]: r["component"] for r in out}
    assert len(out) == len(got) == 41 + 40
    assert set(got.values()) == {0, 100}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 7, dim))
    x = np.concatenate([centres + rng.normal(scale=s, size=centres.shape) for s in (0.0, 0.0, 0.05, 0.1, 0.2, 0.4, 3.0)])
    return [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x.astype(np.float32))]


BAD = [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [float("nan")] * 24, 0), (9004, [None] * 24, 0), (9005, [float("inf")] + [0.0] * 23, 0), (9006, [], 0), (9020, None, 0)]


def test_nearest_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + BAD, VECTORS)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    ids = np.arange(len(rows))
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for i, found in got.items():
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:7]
        assert [v for _, v, _ in sorted(found)] == best.tolist()
        assert np.allclose([s for _, _, s in sorted(found)], score[best], atol=1e-12, rtol=0)


def test_nearest_in_blocks_and_stripes(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows + BAD, VECTORS)
    whole = nearest(df, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(block_matrix_knn, "QUERY_COMPONENTS", 10 * 24)
    monkeypatch.setattr(block_matrix_knn, "STRIPE_ROWS", 50)
    monkeypatch.setattr(block_matrix_knn, "STRIPE_MOST", 100)
    assert nearest(df, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect() == whole


def test_heaps_in_tiles_of_queries(monkeypatch):
    x = np.array([v for _, v, _ in vectors()], dtype=np.float64)
    ids = np.arange(len(x))
    one = block_matrix_knn.Heaps(ids[:50], x[:50], 5)
    one.offer(ids, x)
    monkeypatch.setattr(block_matrix_knn, "QUERY_TILE", 16)
    tiled = block_matrix_knn.Heaps(ids[:50], x[:50], 5)
    for at in range(0, len(x), 64):
        tiled.offer(ids[at : at + 64], x[at : at + 64])
    assert (one.who == tiled.who).all() and (one.score == tiled.score).all()


def test_nearest_of_doubles_and_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.1]), (4, [1.0, 0.1]), (4, [1.0, 0.1]), (5, [0.5, 0.1])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 4), (0, 2, 4), (0, 3, 5)]


def test_nearest_few_rows_and_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (7, [0.5, 9.0], 0), (8, [1.0], 0)], VECTORS)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 7, 0.5)]
    assert nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0
    assert nearest(df, F.col("vec_id") == 99).count() == 0


def test_staged_tables_send_small_batches_and_leave_the_session_alone(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = [r["n"] for r in Scratch(spark).keep(spark.range(0, 9000, 1, 1).mapInArrow(rows, "n long"), "sizes").collect()]
    assert sum(got) == 9000 and max(got) == SENT_ROWS and spark.conf.get(name) == before


def test_near_duplicates_recall_and_precision(spark):
    rows = vectors(1400)
    out = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows + BAD, VECTORS), 0.9).collect()}
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum() - len(x)
    found = sum(r["n_links"] for r in out.values())
    assert 0.95 * links <= found <= links
    assert all(r["kept"] == (r["component_id"] == i) for i, r in out.items())
    for i, *_ in BAD:
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)


def test_near_duplicates_equal_vectors_in_blocks(spark, monkeypatch):
    import isobar.llm.itq_dedup as d

    monkeypatch.setattr(d, "BLOCK", 4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(100, 200)] + [(1, [-1.0, 0.0, 0.0, 0.0], 0), (2, [1.0, 2.0, 3.0], 0)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(out[i] == (99, 100, i == 100) for i in range(100, 200))
    assert out[1] == (0, 1, True) and out[2] == (0, 2, True)
    assert near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("base", [0.0, 0.5, 0.8])
def test_near_duplicates_recall_whatever_the_common_direction(spark, base):
    rng = np.random.default_rng(5)
    mean = np.zeros(64)
    mean[0] = 1
    z = rng.normal(size=(6000, 64))
    z[:, 0] = 0
    x = np.sqrt(base) * mean + np.sqrt(1 - base) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b, _ = pairs_at(x, 0.9005)
    x = np.concatenate([x, a[:400], b[:400], a[-400:], b[-400:]])
    out = near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).toPandas()
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum() - len(x)
    assert 0.95 * links <= out["n_links"].sum() <= links


def test_substrings_of_a_learned_code():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = Model(x, 0.9, 100_000)
    signs = model.signs(x)
    assert 0.4 < signs.mean() < 0.6, "balanced bits"
    keys = model.keys(signs)
    for t in range(model.tables):
        for j in range(model.width):
            assert ((keys[:, t] >> j & 1) == signs[:, t * model.width + j]).all()
    assert (model.apart(x[:250], x[250:]) == (signs[:250] != signs[250:]).sum(axis=1)).all() and packed(signs).dtype == np.uint64


def test_near_duplicates_in_blocks_with_probes(spark, monkeypatch):
    import isobar.llm.itq_dedup as d

    monkeypatch.setattr(d, "BLOCK", 8)
    monkeypatch.setattr(d, "FAMILY_BLOCK", 8)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 24))[rng.integers(0, 6, 400)] + rng.normal(scale=0.15, size=(400, 24))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    p, q = np.nonzero(near)
    assert 0.97 * len(p) <= out["n_links"].sum() <= len(p)
    assert (out["component_id"].to_numpy() == forest(400, p, q)).mean() > 0.99


def test_near_duplicates_of_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (7, v, 0), (7, w, 0), (8, w, 0), (None, v, 0), (9, [-0.0, 0.0, 0.0], 0), (10, [0.1], 0), (11, [5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int").withColumn("h0", F.lit(1))
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (7, 3, 1, False), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, None), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False)], key=str)


def test_runs_cross_batches():
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"key": k, "v": v}) for k, v in (([1, 1, 2], [0, 1, 2]), ([2, 2], [3, 4]), ([], []), ([3], [5])) if k]
    assert [(k, t.column("v").to_pylist()) for k, t in runs(parts, "key")] == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5])]
