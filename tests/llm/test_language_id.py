import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import language_id as li

from .conftest import DOCS


def plain_marginals(field, emissions, words):
    """Sums over all label sequences."""
    n = len(field.languages)
    found = np.zeros((len(words), n))
    for labels in itertools.product(range(n), repeat=len(words)):
        score = field.starts[labels[0]] + sum(emissions[w, k] for w, k in zip(words, labels, strict=True))
        score += sum(field.moves[a, b] for a, b in itertools.pairwise(labels))
        for at, k in enumerate(labels):
            found[at, k] += np.exp(score)
    return found / found.sum(axis=1, keepdims=True)


def field_of(n=3, seed=0):
    rng = np.random.default_rng(seed)
    field = li.Field([f"l{k}" for k in range(n)], bits=8)
    field.moves, field.starts = rng.normal(size=(n, n)), rng.normal(size=n)
    return field, rng


def test_forward_backward_equals_sums_over_all_sequences():
    field, rng = field_of()
    emissions = rng.normal(size=(10, 3))
    lengths = np.array([4, 0, 1, 6, 2])
    words = rng.integers(0, 10, lengths.sum())
    got = field.marginals(emissions, words, lengths)
    at = 0
    for length in lengths:
        if length:
            assert np.allclose(got[at:at + length], plain_marginals(field, emissions, words[at:at + length]))
        at += length


def test_expected_moves_equal_sums_over_all_sequences():
    field, rng = field_of(2, 3)
    emissions, words, lengths = rng.normal(size=(6, 2)), rng.integers(0, 6, 9), np.array([4, 5])
    _, expected = field.marginals(emissions, words, lengths, moves_too=True)
    wanted = np.zeros((2, 2))
    for part in (words[:4], words[4:]):
        total, sums = 0.0, np.zeros((2, 2))
        for labels in itertools.product(range(2), repeat=len(part)):
            weight = np.exp(field.starts[labels[0]] + sum(emissions[w, k] for w, k in zip(part, labels, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            for a, b in itertools.pairwise(labels):
                sums[a, b] += weight
        wanted += sums / total
    assert np.allclose(expected, wanted)


def test_long_texts_are_several_chains(monkeypatch):
    field, rng = field_of()
    emissions, words = rng.normal(size=(10, 3)), rng.integers(0, 10, 23)
    monkeypatch.setattr(li, "CHAIN", 5)
    got = field.marginals(emissions, words, np.array([11, 12]))
    cuts = [0, 5, 10, 11, 16, 21, 23]
    assert np.allclose(got, np.vstack([plain_marginals(field, emissions, words[a:b]) for a, b in itertools.pairwise(cuts)]))


ENGLISH = ["the house of the king is near the river and the old bridge", "she was reading a letter from her brother in the garden", "they were walking along the road with the children"]
GERMAN = ["das haus des königs steht am fluss und bei der alten brücke", "sie las einen brief von ihrem bruder im garten", "sie gingen mit den kindern die straße entlang"]


def test_code_switched_words_get_their_own_language():
    field = li.train((ENGLISH + GERMAN) * 4, (["en"] * 3 + ["de"] * 3) * 4, rounds=12)
    types, words, lengths = li.number_words(["the bridge of the king und der fluss bei der brücke"])
    each = field.marginals(field.emissions(types), words, lengths)
    assert [field.languages[k] for k in each.argmax(axis=1)] == ["en"] * 5 + ["de"] * 6
    assert field.moves[0, 0] > field.moves[0, 1] and field.moves[1, 1] > field.moves[1, 0]


def test_odd_rows(make):
    field = li.train(ENGLISH + GERMAN, ["en"] * 3 + ["de"] * 3)
    rows = [(1, None), (2, ""), (3, "123 -- !?"), (4, "the river " * 20_000), (5, "der fluss"), (5, "der fluss"), (None, "the"), (6, "x" * 100_000), (7, "ж 漢字"), (8, "² Ⅷ ½ 10²")]
    docs = make([(d, t, None, "s", 1, "i", 1) for d, t in rows], DOCS)
    found = {(r["id"], r["lang_pred"]) for r in li.identify_languages(docs, field).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (4, "en"), (5, "de"), (None, "en")} <= found
    assert li.identify_languages(docs, field).count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in li.identify_languages(docs, field).collect())
    # Words that neither language knows are as unsure with two languages as with more.
    kept = li.keep_known(docs, field, 0.35)
    assert kept.schema == docs.schema and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([4, 5, 5, None], key=str)
    assert li.identify_languages(make([], DOCS), field).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, "only one", "en", "s", 1, "i", 1)], [(1, "x", None, "s", 1, "i", 1)]])
def test_too_little_to_learn_from(make, rows):
    from lamina.llm.queries import remainder

    docs = make(rows, DOCS)
    field = li.fit_languages(docs, remainder(1) == 0)
    assert len(field.languages) <= 1 and li.identify_languages(docs, field).count() == len(rows)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = entry.queries()["op6_language_id"](spark, path).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and len(held) > 200
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_texts_of_many_known_languages_are_kept(make):
    vocabulary = [[a + b + c for b in "aeiou" for c in d] for a, d in (("k", "rst"), ("w", "xyz"), ("p", "lmn"), ("g", "dfh"))]
    names = ["a", "b", "c", "d"]
    field = li.train([" ".join(words[k:] + words[:k]) for words in vocabulary for k in range(15)], [n for n in names for _ in range(15)], rounds=12)
    even = " ".join(word for words in vocabulary for word in words)
    assert field.predict([even])[1][0] < 0.35 < 0.9 < field.sureness([even])[0]
    field.moves[:], field.starts[:] = 0, 0  # so that unknown words belong to no language
    docs = make([(1, even, None, "s", 1, "i", 1), (2, "ж 漢字 ж", None, "s", 1, "i", 1), (3, "12", None, "s", 1, "i", 1)], DOCS)
    assert [r["doc_id"] for r in li.keep_known(docs, field, 0.35).collect()] == [1]


def test_every_language_is_learned_whatever_its_rows_and_lengths(make):

    rows = [(n, ENGLISH[n % 3], "en", "s", 1, "i", 1) for n in range(400)] + [(n, GERMAN[n % 3], "de", "s", 1, "i", 1) for n in range(400, 800)]
    rows += [(800, "la casa del rey junto al río viejo " * 500, "es", "s", 1, "i", 1), (801, "talo kuninkaan joen lähellä", "fi", "s", 1, "i", 1), (802, None, "fi", "s", 1, "i", 1)]
    field = li.fit_languages(make(rows, DOCS), F.lit(True), train_rows=40)
    assert field.languages == ["de", "en", "es", "fi"]
    assert field.predict(["la casa vieja del rey"])[0] == ["es"]
    books = [(n, " ".join(texts) * 200, lang, "s", 1, "i", 1) for n, (texts, lang) in enumerate([(ENGLISH, "en"), (GERMAN, "de")])]
    assert li.fit_languages(make(books, DOCS), F.lit(True)).languages == ["de", "en"]


def test_nothing_learned_keeps_texts_with_letters(make):
    docs = make([(1, "some words", None, "s", 1, "i", 1), (2, "12", None, "s", 1, "i", 1), (3, None, None, "s", 1, "i", 1)], DOCS)
    assert [r["doc_id"] for r in li.keep_known(docs, li.train([], []), 0.35).collect()] == [1]


def test_spans_of_long_texts_are_trained_on(make):

    from lamina.llm.batches import training_span

    long = "".join(chr(0x4E00 + n) for n in range(5000))
    docs = make([(1, long, None, "s", 1, "i", 1), (2, "short", None, "s", 1, "i", 1), (3, None, None, "s", 1, "i", 1), (4, long, None, "s", 1, "i", 1), (5, long[:100], None, "s", 1, "i", 1)], DOCS)
    found = {r["doc_id"]: r["t"] for r in docs.select("doc_id", training_span(F.col("text"), F.col("doc_id"), 100, 7).alias("t")).collect()}
    assert len(found[1]) == len(found[4]) == 100 and found[1] in long and found[1] != found[4]
    assert found[2] == "short" and found[3] is None and found[5] == long[:100]


def test_the_sample_is_that_of_the_smallest_hashes(make, monkeypatch):
    """A language of very many rows is cut by hash first, which draws the same rows; repeated ids need the plain way."""
    taken = []
    monkeypatch.setattr(li, "train", lambda texts, labels, **how: taken.append(sorted(zip(labels, texts))) or li.Field([]))
    many = [(n, f"text {n}", "en" if n % 50 else "de", "s", 1, "i", 1) for n in range(3000)]
    repeated = [(n % 40, f"text {n % 40}", "en", "s", 1, "i", 1) for n in range(2000)]
    for rows, each in ((many, 30), (repeated, 30), ([], 30)):
        docs = make(rows, DOCS)
        li.fit_languages(docs, F.lit(True), train_rows=2 * each)
        spark = docs.sparkSession
        wanted = []
        for lang in {r[2] for r in rows}:
            ids = spark.createDataFrame(sorted({(r[0], r[1]) for r in rows if r[2] == lang}), "id long, t string")
            first = ids.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(each).collect()
            wanted += [(lang, r["t"]) for r in first]
        assert taken.pop() == sorted(wanted)
