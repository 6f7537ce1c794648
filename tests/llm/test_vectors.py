import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import embedding_dedup as ed
from lamina.llm import vector_search as vs
from lamina.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, list int"


def table(make, vectors):
    return make([(n, None if v is None else [None if x is None else float(x) for x in v], 1, 5, "x", 2) for n, v in vectors], SCHEMA)


def test_e8_decoding_finds_the_nearest_point():
    x = np.random.default_rng(0).normal(0, 2, (300, 8))
    got = ed.nearest_in_e8(x)
    twice = np.rint(got * 2)
    assert (np.abs(got * 2 - twice) < 1e-9).all() and (got.sum(axis=1) % 2 == 0).all()
    assert all(len(set(row % 2)) == 1 for row in twice)
    for around in ed.neighbours():
        assert (((x - got) ** 2).sum(axis=1) <= ((x - got - around) ** 2).sum(axis=1) + 1e-9).all()
    assert len(np.unique(ed.neighbours(), axis=0)) == 240 and np.allclose((ed.neighbours() ** 2).sum(axis=1), 2)


def planted(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    vectors = []
    for cosine in (0.905, 0.93, 0.97, 0.99, 0.999, 0.85, 0.6):
        for _ in range(6):
            a, b = rng.normal(size=(2, dim))
            a /= np.linalg.norm(a)
            b -= (b @ a) * a
            b /= np.linalg.norm(b)
            vectors += [a * 3, cosine * a + np.sqrt(1 - cosine**2) * b]
    chain = rng.normal(size=dim)
    for _ in range(30):
        chain = chain + rng.normal(size=dim) * 0.12
        vectors.append(chain.copy())
    vectors += [vectors[0]] * 5 + [vectors[0] * 2]
    return [(7 + 3 * n, v) for n, v in enumerate(np.array(vectors, np.float32))]


def plain_links(vectors, threshold=0.9):
    ids = [n for n, _ in vectors]
    x = np.array([v for _, v in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in itertools.product(range(len(ids)), repeat=2):
            if near[i, j] and root[j] > root[i]:
                root[j], changed = root[i], True
    return {n: (int(c), r) for n, c, r in zip(ids, near.sum(axis=1), root, strict=True)}


@pytest.mark.parametrize("block", [1024, 4])
def test_links_equal_brute_force(make, block):
    vectors = planted()
    # Many tables: here every pair must be found, and each counted once however often it meets.
    found = ed.embedding_groups(table(make, vectors), tables=12, probes=24, scale=1.6, block=block)
    assert {r["id"]: (r["n_links"], r["component"]) for r in found.collect()} == plain_links(vectors)


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x, y = (ed.Lattice(4, 8, 1.4, 11).keys(v) for v in (a, 0.905 * a + np.sqrt(1 - 0.905**2) * b))
    met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
    assert met.any(axis=1).mean() > 0.97


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")])]


def test_odd_vectors_link_with_nothing(make):
    good = [(None, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [2e-30, 4e-30]), (13, [1.0, 2.0, 0.0]), (9, [-1.0, -2.0])]
    found = ed.embedding_groups(table(make, ODD + good)).collect()
    assert sorted(((r["id"], r["n_links"], r["component"]) for r in found), key=str) == sorted(
        [(n, 0, n) for n, _ in ODD] + [(None, 0, None), (10, 3, 10), (11, 3, 10), (11, 3, 10), (12, 3, 10), (13, 0, 13), (9, 0, 9)], key=str)
    assert ed.embedding_groups(table(make, [])).collect() == []
    assert [r["id"] for r in table(make, ODD).where(usable(F.col("embedding"))).selectExpr("vec_id as id").collect()] == []


def test_scan_abandons_only_what_the_test_allows():
    rng = np.random.default_rng(1)
    queries, candidates = rng.normal(size=(7, 32)), rng.normal(size=(200, 32))
    far = ((queries[:, None] - candidates[None]) ** 2).sum(axis=2)
    bounds = np.sort(far, axis=1)[:, 20]
    q, c, found = vs.scan_list(queries, bounds, candidates, [(0, 8), (8, 16), (16, 24), (24, 32)], 1e9)
    assert set(zip(q, c, strict=True)) == set(zip(*np.nonzero(far <= bounds[:, None]), strict=True))
    assert np.allclose(found, far[q, c])
    some = vs.scan_list(queries, bounds, candidates, [(0, 8), (8, 16), (16, 24), (24, 32)], 2.1)
    assert set(zip(some[0], some[1], strict=True)) <= set(zip(q, c, strict=True)) and len(some[0]) > 0.9 * len(q)


def plain_nearest(vectors, queries, k):
    x = np.array([v for _, v in vectors], np.float64)
    ids = np.array([n for n, _ in vectors])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for q in queries:
        score = x @ x[list(ids).index(q)]
        others = np.flatnonzero(ids != q)
        found[q] = [int(ids[n]) for n in others[np.lexsort((ids[others], -score[others].round(12)))][:k]]
    return found


def test_all_lists_probed_without_doubt_is_exact(make):
    rng = np.random.default_rng(3)
    vectors = list(enumerate(rng.normal(size=(300, 12)).astype(np.float32)))
    vectors += [(300 + n, vectors[0][1]) for n in range(4)]
    found = vs.nearest(table(make, vectors), F.col("vec_id") % 50 == 0, probe_share=1.0, epsilon=1e6, shard_rows=64, column_block=4).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest(vectors, range(0, 304, 50), 5)
    assert all(1 <= r["rank"] <= 5 and -1.0001 <= r["score"] <= 1.0001 for r in found)


def test_recall_on_the_given_table(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.1"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = entry.queries()["op10_vector_search"](spark, path).collect()
    wanted = plain_nearest(vectors, [n for n, _ in vectors if n % 50 == 0], 5)
    assert len(found) == sum(map(len, wanted.values()))
    assert np.mean([r["vec_id"] in wanted[r["query_id"]] for r in found]) >= 0.9


def test_few_odd_and_no_rows(make):
    asks = F.col("vec_id") % 50 == 0
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [0.0, 1.0]), (100, [3.0]), (None, [1.0, 0.5])]
    found = vs.nearest(table(make, few + ODD), asks, probe_share=0.1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0)]
    assert vs.nearest(table(make, ODD), asks).collect() == [] == vs.nearest(table(make, []), asks).collect()
    assert vs.nearest(table(make, [(1, [1.0]), (2, [2.0])]), asks).collect() == []


def test_each_vector_length_is_searched_apart(make):
    rng = np.random.default_rng(8)
    wide, short = ([(n, rng.normal(size=d).tolist()) for n in some] for some, d in ((range(0, 30), 6), (range(100, 112), 4)))
    found = vs.nearest(table(make, wide + short), F.col("vec_id").isin(3, 105), probe_share=1.0).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (3, 105)}
    for q, rows in ((3, wide), (105, short)):
        vectors = {n: np.array(v) / np.linalg.norm(v) for n, v in rows}
        assert got[q] == sorted((n for n in vectors if n != q), key=lambda n: -vectors[n] @ vectors[q])[:5]


def test_huge_and_tiny_components(make):
    rng = np.random.default_rng(4)
    near = rng.normal(size=16)
    vectors = {0: near, 50: near * 1e200, 2: near * 1e-200, 3: (near + 0.01) / np.abs(near + 0.01).max() * 1.7e308, 4: -near * 1e300}
    docs = make([(k, [float(x) for x in v]) for k, v in vectors.items()], "vec_id long, embedding array<double>")
    groups = {r["id"]: (r["n_links"], r["component"]) for r in ed.embedding_groups(docs).collect()}
    assert groups == {0: (3, 0), 50: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}
    found = vs.nearest(docs, F.col("vec_id") % 50 == 0, k=2).collect()
    assert len(found) == 4 and all(r["score"] > 0.99 for r in found)
