import random
from collections import defaultdict

import pytest

from lamina.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, row string, mark string, places string, n_lines string, first string"
UPPER = {chr(c): chr(c + 32) for c in range(65, 91)}
LINES = ["  Same line of all  ", "same LINE of all", "short", "", "É A LINE OF accents", "é a line of accents", " no white space ", "ten chars.", "nine char",
         "\ta tab and a return\r", "a tab and a return", "\x1ctabulated\x1c line"]


def key(line):
    return "".join(UPPER.get(c, c) for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, least_chars, least_docs):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add((doc is None, doc))
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs
                or sorted(holders[key(x)], key=lambda h: (h[0], h[1] or 0))[0] == (doc is None, doc)]
        found.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(found, key=str)


def run(make, rows, **how):
    docs = make([(*r, "i", "r", "m", "p", "n", "f") for r in rows], SCHEMA)
    got = line_dedup.drop_shared_lines(docs, **how)
    assert got.columns == ["doc_id", "text", "id", "row", "mark", "places", "first", "n_lines", "n_dropped"]
    assert all(r["id"] == "i" and r["places"] == "p" for r in got.collect())
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("how", [(10, 2), (0, 2), (10, 3), (9, 1)])
def test_equals_the_plain_form(make, how):
    dice = random.Random(sum(how))
    rows = [(100 + n * 13 % 90, "\n".join(dice.choices(LINES, k=dice.randint(0, 9)))) for n in range(90)]
    rows += [(None, None), (None, "Same line of all\nshort"), (None, "Same line of all\nshort"), (5000, ""), (5001, "\n\n"), (101, rows[4][1]), (101, "another line here")]
    rows += [(5002, "\n".join(f"numbered line {n % 700}" for n in range(30_000))), (5003, "numbered line 5\nnumbered line 6")]
    assert run(make, rows, least_chars=how[0], least_docs=how[1]) == plain(rows, *how)


def test_edges(make):
    assert run(make, []) == []
    assert run(make, [(1, "only one line"), (1, "only one line")]) == [(1, "only one line", 1, 0)] * 2
    assert run(make, [(2, "a shared line\nmine"), (1, "A SHARED LINE ")]) == [(1, "A SHARED LINE ", 1, 0), (2, "mine", 2, 1)]
    assert run(make, [(2, "a shared line"), (1, "a shared line")]) == [(1, "a shared line", 1, 0), (2, "", 1, 1)]


def test_no_python_in_the_plan(make):
    plan = line_dedup.drop_shared_lines(make([], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
