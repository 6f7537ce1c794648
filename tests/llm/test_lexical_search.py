import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lamina.llm import lexical_search as ls

DOCS = "doc_id long, text string, score long, rank string, item_id string, item string, doc string"
ITEMS = "item_id long, text string, term string, doc_id string"
WORDS = ["plate", "Plate", "été", "KWH", "x9", "日本", "the", "of", "a", "mill", "line", "zz"]


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, k):
    cut = [(key, Counter(plain_terms(text))) for key, text in docs]
    N, L = sum(1 for _, c in cut if c), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, set()).update(plain_terms(text))
    found = []
    for item, terms in wanted.items():
        scored = []
        for key, c in cut:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        found += [(item, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


def text(dice, most):
    return " ".join(dice.choices(WORDS, weights=range(len(WORDS), 0, -1), k=dice.randint(0, most)))


@pytest.mark.parametrize("pairs,tile", [(500_000, 1024), (7, 16), (30, 3)])
def test_equals_the_plain_form(make, monkeypatch, pairs, tile):
    monkeypatch.setattr(ls, "TILE_DOCS", tile)
    monkeypatch.setattr(ls, "TILE_ITEMS", 4)
    monkeypatch.setattr(ls, "TILE_TERMS", 3)
    dice = random.Random(pairs)
    docs = [(n * 11 % 120, text(dice, 25)) for n in range(120)]
    # Copies tie; one text is very long; ids repeat and lack.
    docs += [(200 + n, "plate of the mill") for n in range(40)] + [(None, "plate of the mill"), (7, "plate of the mill"), (7, "plate of the mill")]
    docs += [(900, None), (901, ""), (902, "zz x9 " * 30_000)]
    items = [(n, text(dice, 8)) for n in range(15)] + [(3, "mill zz"), (None, "plate"), (None, "zz"), (50, ""), (51, None), (52, "absent word")]
    got = ls.ranked_search(make([(*d, 1, "r", "x", "y", "z") for d in docs], DOCS), make([(*i, "t", "d") for i in items], ITEMS), chunk_pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 10)


def test_empty_tables(make):
    docs, items = make([(1, "plate", 1, "r", "x", "y", "z")], DOCS), make([(1, "plate", "t", "d")], ITEMS)
    assert ls.ranked_search(make([], DOCS), items).collect() == []
    assert ls.ranked_search(docs, make([], ITEMS)).collect() == []
    assert ls.ranked_search(make([(1, None, 1, "r", "x", "y", "z")], DOCS), items).collect() == []


def test_parts_stay_exact(monkeypatch):
    """Terms are cut where sums of products could pass 2^53, and the parts add up."""
    dice = np.random.default_rng(3)
    items, terms, docs = 5, 400, 30
    pair = np.array([(i, t) for i in range(items) for t in sorted(dice.choice(terms, 300, replace=False))])
    weight = dice.integers(1, 2**31, len(pair))
    tiles = ls.item_tiles(pair[:, 0], pair[:, 1], weight, items)
    assert sum(len(t.parts) for t in tiles) > 20
    for tile in tiles:
        for _, _, item, w in tile.parts:
            assert max(np.bincount(item, w * float(ls.IMPACT_LIMIT))) < ls.EXACT
    impact = dice.integers(1, ls.IMPACT_LIMIT, (docs, terms))
    doc, term = (x.ravel() for x in np.indices((docs, terms)))
    dense = np.zeros((terms, items), np.int64)
    dense[pair[:, 1], pair[:, 0]] = weight
    got = np.hstack([ls.tile_scores(t, doc, term, impact.ravel(), docs, terms) for t in tiles])
    assert (got == impact @ dense).all()


def test_best_keeps_ties_across_tiles():
    best = ls.Best(2, 2)
    none = np.zeros(3, np.int64)
    best.add(0, np.array([[5, 0], [5, 1], [5, 0]]), np.array([9, 8, 7]), none)
    best.add(0, np.array([[5, 1], [4, 1], [5, 1]]), np.array([1, 2, 3]), np.array([1, 0, 0]))
    assert list(zip(best.item, best.score, best.id)) == [(0, 5, 3), (0, 5, 7), (1, 1, 2), (1, 1, 3)]
