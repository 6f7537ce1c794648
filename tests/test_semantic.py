import zlib

import numpy as np
import pytest

from lamina.operators import embed, search, semantic
from lamina.operators.fulltext import FRENCH, SIMPLE, analyser

TOPICS = [
    "laminoir tôle acier bobine ligne four épaisseur", "arrêt panne maintenance pièce roulement moteur équipe", "énergie puissance réactive kilowatt facteur pointe tarif",
    "contrôle défaut rayure tache surface caméra qualité", "sécurité casque consigne danger évacuation alarme poste",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(120):
        words = TOPICS[n % 5].split()
        rows.append((n, " ".join(rng.choice(words, 12)) + " " + " ".join(rng.choice(" ".join(TOPICS).split(), 3))))
    rows += [(900, None), (901, ""), (902, "?!")]
    return rows, spark.createDataFrame(rows, "id int, text string").repartition(5)


def dense(rows, cells, analysis):
    """The weighted matrix of all texts, plainly."""
    analyse = analyser(analysis)
    counts = np.zeros((len(rows), cells))
    for n, (_, text) in enumerate(rows):
        for term in analyse(text):
            if term is not None:
                counts[n, zlib.crc32(term.encode()) % cells] += 1
    counts = counts[counts.any(axis=1)]
    damped = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)
    holding = (counts > 0).sum(axis=0)
    weighted = damped * np.where(holding > 0, np.log((1 + len(counts)) / (1 + holding)) + 1, 0)
    return weighted / np.linalg.norm(weighted, axis=1, keepdims=True)


@pytest.mark.parametrize("analysis", [FRENCH, SIMPLE])
def test_directions_span_those_of_a_plain_decomposition(corpus, analysis):
    rows, df = corpus
    model = semantic.fit_semantic(df, "text", dim=5, cells=512, analysis=analysis, rounds=6)
    _, strengths, plain = np.linalg.svd(dense(rows, 512, analysis), full_matrices=False)
    assert np.allclose(model.strengths, strengths[:5], rtol=1e-4)
    # The cosines of the angles between the two spaces are all one.
    angles = np.linalg.svd(plain[:5] @ model.directions, compute_uv=False)
    assert angles.min() > 0.999 and np.allclose(model.directions.T @ model.directions, np.eye(5), atol=1e-8)


def test_texts_of_a_topic_lie_together_though_they_share_no_word(spark, corpus):
    _, df = corpus
    model = semantic.fit_semantic(df, "text", dim=5, cells=2048)
    make = {"encoder": model.encoder(), "expected_dim": model.dim}
    asked = spark.createDataFrame([(0, "bobine"), (1, "moteur"), (2, "tarif"), (3, "caméra"), (4, "casque")], "query_id int, text string")
    told = spark.createDataFrame([(0, "épaisseur du four"), (1, "pièce et roulement"), (2, "puissance réactive"), (3, "taches"), (4, "évacuation")], "chunk_id int, text string")
    found = search.knn_exact(embed.embed_batch(asked, "text", "vector", prefix="query: ", **make), embed.embed_batch(told, "text", **make), 1)
    assert {r["query_id"]: r["chunk_id"] for r in found.collect()} == {n: n for n in range(5)}
    with pytest.raises(Exception, match="5 dimensions"):
        embed.embed_batch(asked, "text", encoder=model.encoder(), expected_dim=6).collect()


def test_no_texts(spark, corpus):
    _, df = corpus
    model = semantic.fit_semantic(df.where("id >= 900"), "text", dim=4, cells=64)
    assert not model.directions.any() and model.dim == 4
    assert embed.embed_batch(df.limit(1), "text", encoder=model.encoder(), expected_dim=4).first()["embedding"] is None
