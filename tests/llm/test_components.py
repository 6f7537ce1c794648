import random

import pytest

from lamina.llm.components import connected_components


def plain(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(2, 1), (1, 2), (1, 2)], [(n, n + 1) for n in range(40)], [(0, n) for n in range(1, 60)],
    [(random.Random(n).randrange(80), random.Random(-n).randrange(80)) for n in range(1, 70)], [(-5, 3), (3, -(1 << 62))],
])
def test_components_equal_a_plain_search(spark, edges):
    frame = spark.createDataFrame(edges or [(1, 1)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    alone = {a for a, b in edges if a == b}
    wanted = {n: c for n, c in plain(edges).items() if n not in alone or any(n in e and e[0] != e[1] for e in edges)}
    assert found == wanted
