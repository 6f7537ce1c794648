import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.stemming import french_stem
from lamina.operators import fulltext as ft
from lamina.operators import index
from tests.conftest import rows

#: Words with their stems as the rules are published to give.
STEMS = {
    "continuellement": "continuel", "continuité": "continu", "continuons": "continuon", "contradictoirement": "contradictoir",
    "majestueusement": "majestu", "majestueux": "majestu", "majorité": "major", "malades": "malad", "maladive": "malad",
    "constamment": "const", "évidemment": "évident", "hésitation": "hésit", "activement": "activ", "immédiates": "immédiat",
    "rayures": "rayur", "actions": "action", "lançait": "lanc", "aiguë": "aigu", "naïf": "naïf", "yeux": "yeux", "tôles": "tôl",
    "quand": "quand", "premièrement": "premi", "travaux": "traval", "bateaux": "bateau", "": "", "z_scratch": "z_scratch", "42": "42",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert french_stem(word) == STEMS[word]


def test_stems_equal_a_second_form():
    """The procedural stemmer and the patterns of the SQL agree on words made of all endings."""
    import duckdb
    import pandas as pd

    from lamina.functions import stemming as s
    from workload import sqltext

    dice = random.Random(5)
    ends = [*s._NOUN, *s.I_VERB_ENDINGS, *s.ER_VERB_ENDINGS, *s.A_VERB_ENDINGS, *s.LAST_ENDINGS, *s.DOUBLED, "ic", "at", "iv", "abil", "eus", "ièr", "ç", "que"]
    letters = "aeiouyâàëéêèïîôûùbcçdfghjlmnpqrstvwxz_9"
    made = {"".join(dice.choices(letters, k=dice.randint(1, 5))) + "".join(dice.choices(ends, k=dice.randint(0, 3))).lower() for _ in range(20_000)}
    frame = pd.DataFrame({"word": sorted(made)})  # noqa: F841
    found = duckdb.sql(sqltext.stemmed("SELECT word FROM frame")).fetchall()
    assert len(found) == len(made) and not [w for w, stem in found if french_stem(w) != stem]


def clauses(text, analysis=ft.SIMPLE, syntax=True):
    return [(c.negated, c.terms, c.offsets) for c in ft.parse_question(text, ft.analyser(analysis), syntax)]


def test_questions_are_parsed():
    one = (0,)
    assert clauses('"mise en place" or défaut -rayure') == [(False, ("mise", "en", "place"), (0, 1, 2)), (False, ("défaut",), one), (True, ("rayure",), one)]
    # Stop words leave gaps; what is left of one word is a term.
    assert clauses('"la mise en place" "de la tôle"', ft.FRENCH) == [(False, ("mis", "plac"), (0, 2)), (False, ("tôl",), one)]
    assert clauses("or l'arrêt -a-b or") == [(False, ("or",), one), (False, ("l",), one), (False, ("arrêt",), one), (True, ("a", "b"), (0, 1))]
    assert clauses('open "quote a - "" a', syntax=True)[0] == (False, ("open",), one)
    assert clauses(None) == clauses("- !!") == clauses("de la", ft.FRENCH) == []
    assert clauses('"a b" -c a', syntax=False) == [(False, (t,), one) for t in "abc"]


def sweep(entries, asked):
    """Covers as a database finds them: forward to the first match, back to the shortest, on behind its begin."""
    order = sorted(entries)

    def holds(places, whole=False):
        at = {p: entries[p][0] for p in places}

        def there(terms, offsets):
            return any(all(at.get(p + o) == t for t, o in zip(terms, offsets)) for p in places)

        return any(there(terms, offsets) != negated for terms, offsets, negated in asked) if places or whole else False

    if not holds(order, whole=True):
        return -1.0
    rank, begin = 0.0, 0
    while begin < len(order):
        end = next((e for e in range(begin, len(order)) if holds(order[begin:e + 1])), None)
        if end is None:
            break
        first = next(b for b in range(end, -1, -1) if holds(order[b:end + 1]))
        inside = order[first:end + 1]
        mean = len(inside) / sum(1 / (1.0 if entries[p][1] else 0.4) for p in inside)
        rank += mean / (1 + inside[-1] - inside[0] - (len(inside) - 1))
        begin = first + 1
    return round(rank, 6)


def test_cover_density_equals_a_sweep():
    dice = random.Random(8)
    for _ in range(4000):
        heading = dice.randint(0, 4)
        entries = {p: (dice.randint(0, 3), p <= heading) for p in range(1, dice.randint(1, 14)) if dice.random() < 0.7}
        asked = []
        for _ in range(dice.randint(1, 3)):
            size = dice.choice([1, 1, 2, 3])
            offsets = (0, *sorted(dice.sample(range(1, 4), size - 1)))
            asked.append((tuple(dice.choices(range(4), k=size)), offsets, dice.random() < 0.25))
        operands = {t for terms, _, _ in asked for t in terms}
        entries = {p: e for p, e in entries.items() if e[0] in operands}
        assert ft.cover_density(entries, asked) == sweep(entries, asked), (entries, asked)


WORDS = "acier tôle ligne four mise en place défaut rayure de la z_scratch".split()


def plain(chunks, questions, analysis, k):
    found = []
    for q, text in questions:
        asked = ft.parse_question(text, ft.analyser(analysis))
        if not asked:
            continue
        operands = {t for c in asked for t in c.terms}
        scored = []
        for key, head, body in chunks:
            entries = {}
            for term, (inside, *places) in ft.chunk_entries(head, body, ft.analyser(analysis)).items():
                entries |= {p: (term, n < inside) for n, p in enumerate(places) if term in operands}
            score = sweep(entries, [(c.terms, c.offsets, c.negated) for c in asked])
            if score > 0 or score == 0 and any(c.negated for c in asked):
                scored.append((-score, key is None, key or 0, key))
        found += [(q, s[3], -s[0], n + 1) for n, s in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


@pytest.mark.parametrize("block,sent", [(256, 1000), (3, 4)])
def test_search_equals_the_plain_form(spark, block, sent):
    dice = random.Random(block)

    def text(most):
        return " ".join(dice.choices(WORDS, k=dice.randint(0, most)))

    chunks = [(n, text(3), text(15)) for n in range(60)] + [(100 + n, "four", "mise en place de la ligne") for n in range(20)]
    chunks += [(None, "four", "mise en place de la ligne"), (200, None, None), (201, "", "acier " * 5000)]
    questions = [(n, text(4)) for n in range(6)]
    questions += [(10, '"mise en place"'), (11, '"mise en place" -four'), (12, '-"acier tôle"'), (13, "absent"), (14, '"tôle ligne" tôle'), (15, ""), (16, None)]
    questions += [(17, 'four or "ligne four" -rayure'), (18, '"place ligne" "ligne four" acier')]
    table = spark.createDataFrame(chunks, "chunk_id long, heading string, content string").repartition(4)
    asked = ft.parse_questions(spark.createDataFrame(questions, "query_id long, text string"))
    found = ft.search_blocks(ft.block_index(table, block_chunks=block), asked, 5, sent_terms=sent)
    got = [(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in found.collect()]
    assert sorted(got, key=str) == plain(chunks, questions, ft.FRENCH, 5)
    # Blocks of the asked terms alone give the same.
    few = ft.search_blocks(ft.block_index(table, block_chunks=block, only=ft.asked_terms(asked)), asked, 5, sent_terms=sent)
    assert sorted(((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in few.collect()), key=str) == sorted(got, key=str)
    assert ft.asked_terms(asked, 2) is None


def test_blocks_that_cannot_help_are_passed_over():
    best = ft._Best(1, 2)
    import numpy as np

    best.offer(0, np.array([0.4, 2.0, 1.4]), [5, 6, 7])
    assert best.floor[0] == 1.4
    # An equal score of a smaller id still counts.
    best.offer(0, np.array([1.4, -1.0]), [1, 2])
    assert [h[2] for h in best.held[0]] == [6, 1]


def test_code_is_not_stemmed(spark):
    chunks = spark.createDataFrame(
        [(1, "doc", "Lectures", "les lectures actives"), (2, "code", "readings lectures", "def lectures")],
        "chunk_id long, source_type string, heading string, content string")
    how = {"analysis": ft.BY_SOURCE_TYPE, "config": "source_type"}
    assert rows(ft.positional_index(chunks, **how), "chunk_id", "term", "headings", "positions") == [
        (1, "activ", 0, [4]), (1, "lectur", 1, [1, 3]), (2, "def", 0, [3]), (2, "lectures", 1, [2, 4]), (2, "readings", 1, [1])]
    assert ("lectures", "A", [2]) in rows(index.term_index(chunks, **how), "term", "weight", "positions")
    asked = ft.parse_questions(spark.createDataFrame([(0, "lecture")], "query_id long, text string"), analysis=ft.BY_SOURCE_TYPE)
    assert rows(ft.search_blocks(ft.block_index(chunks, **how), asked), "chunk_id", "score") == [(1, 1.4)]
    with pytest.raises(Exception, match="KeyError"):
        ft.block_index(chunks.withColumn("source_type", F.lit("mail")), **how).collect()
    with pytest.raises(ValueError):
        ft.block_index(chunks, analysis=ft.BY_SOURCE_TYPE)


def test_empty_index_and_no_questions(spark):
    none = spark.createDataFrame([], "chunk_id long, heading string, content string")
    asked = ft.parse_questions(spark.createDataFrame([(0, "x")], "query_id long, text string"))
    assert ft.search_blocks(ft.block_index(none), asked).collect() == []
    one = spark.createDataFrame([(1, "x", "x")], "chunk_id long, heading string, content string")
    assert ft.search_blocks(ft.block_index(one), asked.limit(0)).collect() == []


def test_only_chunks_that_can_be_among_the_best_have_their_covers_listed(spark, monkeypatch):
    texts = ["red fox " * 9, "red fox " * 8, "red fox", "fox", "red fox " * 7 + "red fox red fox red fox", "red fox", "fox red", "red"]
    chunks = spark.createDataFrame([(n, "", x) for n, x in enumerate(texts)], "chunk_id long, heading string, content string").coalesce(1)
    batches = ft.block_index(chunks, block_chunks=4).toArrow().combine_chunks().to_batches()
    # All of the first block, but where nothing is negated those without a match, and of the second the one that reaches the second best score.
    for question, most in (('"red fox"', 4), ('red or "red fox"', 4), ('"red fox" -blue', 5)):
        asked, listed, density = ft._Asked(), [], ft.cover_density

        def counted(entries, clauses):
            listed.append(entries)
            return density(entries, clauses)

        asked.add(0, ft.parse_question(question, ft.analyser(ft.FRENCH)))
        best, none = ft._Best(1, 2), np.zeros(0, np.int64)
        monkeypatch.setattr(ft, "cover_density", counted)
        for batch in batches:
            for row in range(batch.num_rows):
                ft._search_block(batch, row, asked, (none, none), best)
        monkeypatch.setattr(ft, "cover_density", density)
        assert len(listed) == most
        assert sorted(h[2] for h in best.held[0]) == [0, 4]
