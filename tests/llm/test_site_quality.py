import numpy as np
import pytest

from lamina.llm import site_quality as sq

from .conftest import DOCS

SITES = "id long, host string, path string, evidence double"


def plain(rows, prior):
    """The same posteriors by loops; concentrations by the method of moments."""
    logistic = lambda x: 1 / (1 + np.exp(-x))
    p = np.array([logistic(r[3] + np.log(prior / (1 - prior))) for r in rows])
    of = lambda *keys: {k: p[[tuple(r[c] for c in keys) == k for r in rows]] for k in {tuple(r[c] for c in keys) for r in rows}}
    hosts, paths = of(1), of(1, 2)
    mean = p.mean()

    def tightness(groups, around, inside):
        size = sum(map(len, groups.values()))
        spare = size - sum(len(g) ** 2 for g in groups.values()) / size if size else 0
        if spare <= 0:
            return sq.NEVER
        q = sum(len(g) * (g.mean() - around(k)) ** 2 for k, g in groups.items())
        variance = (q - (len(groups) - 1) * inside) / spare
        return float(np.clip(mean * (1 - mean) / variance - 1, 0.5, sq.NEVER)) if variance > 0 else sq.NEVER

    spread = lambda groups: sum(((g - g.mean()) ** 2).sum() for g in groups.values()) / max(len(p) - len(groups), 1)
    top = tightness(hosts, lambda k: mean, spread(hosts))
    low = tightness({k: g for k, g in paths.items() if len(g) < len(hosts[k[:1]])}, lambda k: hosts[k[:1]].mean(), spread(paths))
    found = []
    for r, own in zip(rows, p, strict=True):
        h, g = hosts[(r[1],)], paths[(r[1], r[2])]
        host = (h.sum() - own + top * mean) / (len(h) - 1 + top)
        path = (g.sum() - own + low * host) / (len(g) - 1 + low)
        bounded = np.clip(path, 1e-4, 1 - 1e-4)
        found.append((r[0], host, path, logistic(r[3] + np.log(bounded / (1 - bounded)))))
    return found


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_posteriors_equal_a_plain_computation(make, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(300):
        host = None if n % 29 == 0 else f"h{min(int(rng.exponential(3)), 9)}"
        path = None if n % 17 == 0 else f"p{rng.integers(3)}"
        rows.append((n, host, path, float(rng.normal(2 if host in ("h0", "h1") else -1, 2))))
    found = {r["id"]: r for r in sq.score_sites(make(rows, SITES), 0.6).collect()}
    for number, host, path, score in plain(rows, 0.6):
        r = found[number]
        assert np.allclose([r["host_rate"], r["path_rate"], r["score"]], [host, path, score], atol=1e-9)


def test_sparse_sites_shrink_more(make):
    rows = [(n, "large bad", "x", -3.0) for n in range(200)] + [(200 + n, "large good", "x", 3.0) for n in range(200)]
    rows += [(400 + n, f"host {n}", "x", 3.0 if n % 2 else -3.0) for n in range(100)]
    rows += [(600, "large bad", "x", 0.0), (601, "host 0", "x", 0.0), (602, "large good", "x", 0.0)]
    rate = {r["id"]: r["path_rate"] for r in sq.score_sites(make(rows, SITES), 0.5).collect()}
    assert rate[600] < 0.1 < rate[601] < rate[602] and abs(rate[600] - 0.5) > abs(rate[601] - 0.5)


def test_held_out_quality_and_every_row(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    found = entry.queries()["op8_site_quality"](spark, path).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    assert np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in found if r["doc_id"] in truth]) > 0.97


def test_odd_rows(make):
    classifier = sq.Classifier()
    texts = ["plain words in a row", "### $$$ ### %%%", "OTHER words, and more", "&&& ***"] * 10
    classifier.fit(sq.shape_features(texts), np.array([1.0, 0.0] * 20))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "i", 1), (3, "$$$ " * 50_000, "en", "s", 1, "i", 1), (3, "plain words", "en", "s", 1, "i", 1), (None, "plain words", "en", "s", 1, "i", 1)]
    scored = sq.score_quality(make(rows, DOCS), classifier, 0.5, host_col="source", path_col="lang").collect()
    assert sorted(str(r["id"]) for r in scored) == ["1", "2", "3", "3", "None"] and all(0 <= r["score"] <= 1 for r in scored)
    assert sq.score_quality(make([], DOCS), classifier, 0.5, host_col="source", path_col="lang").collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (7, 0)]])
def test_too_little_to_learn_from(make, labels):
    from lamina.llm.queries import remainder

    docs = make([(1, "a b", "en", "s", 1, "i", 1)], DOCS)
    classifier, rate = sq.fit_classifier(docs, make(labels, "doc_id long, quality int"), remainder(1) == 0)
    assert 0 < rate < 1 and classifier.odds(["x", None]).tolist() == [0.0, 0.0]
