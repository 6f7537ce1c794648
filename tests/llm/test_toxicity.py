import numpy as np
from pyspark.sql import functions as F

from lamina.llm import toxicity as tx

from .conftest import DOCS


def corpus(count=240, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti"]
    texts, labels = [], []
    for n in range(count):
        words = ["the" if rng.random() < 0.2 else "".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(rng.integers(5, 120))]
        bad = n % 4 == 0
        if bad:
            words[rng.integers(len(words))] = "zorgal" + rng.choice(["", "ba", "ti"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_pooling_equals_a_plain_convolution():
    net = tx.Network(4, 5, 3, 1)
    rng = np.random.default_rng(2)
    embedded = rng.normal(size=(9, 5)).astype(np.float32)
    lengths = np.array([0, 1, 2, 7, 0, 3])
    words = rng.integers(0, 9, lengths.sum())
    got, where, _ = net.pooled(embedded, words, lengths, places=True)
    at = 0
    for n, length in enumerate(lengths):
        mine = [embedded[w] for w in words[at:at + length]]
        at += length
        column = 0
        for kernel in net.kernels:
            width = len(kernel)
            padded = [np.zeros(5)] * (width - 1) + mine + [np.zeros(5)] * (width - 1)
            windows = [padded[k:k + width] for k in range(max(length + width - 1, 1))]
            best = np.max([sum(x @ kernel[k] for k, x in enumerate(w)) for w in windows], axis=0)
            assert np.allclose(got[n, column:column + 3], np.maximum(best + net.bias[column:column + 3], 0), atol=1e-4)
            column += 3


def test_beginnings_carry_over_to_unseen_words():
    texts, labels = corpus()
    net = tx.train(texts, labels)
    unseen, truth = corpus(seed=9)
    score = net.score([t.replace("zorgal", "zorgalke") for t in unseen])
    assert ((score >= 0.7) == truth).mean() > 0.95 and ((score >= 0) & (score <= 1)).all()


def test_one_label_or_none_gives_a_constant():
    for texts, labels in (([], np.zeros(0, int)), (["a b"], np.array([0])), (["a b", "c"], np.array([1, 1]))):
        score = tx.train(texts, labels).score(["x", None, ""])
        assert len(set(score)) == 1 and 0 <= score[0] <= 1


def test_odd_rows(make):
    texts, labels = corpus()
    net = tx.train(texts, labels)
    rows = [(1, None), (2, ""), (3, "zorgal"), (3, "zorgal"), (None, "ba " * 40_000), (4, "!!! ???"), (5, "mo " * 30_000 + "zorgalba")]
    found = tx.score_toxicity(make([(d, t, None, "s", 1, "i", 1) for d, t in rows], DOCS), net).collect()
    score = {r["id"]: r["score"] for r in found}
    assert len(found) == len(rows) and score[1] == score[2] == score[4] < 0.7 <= min(score[3], score[5]) and score[None] < 0.7
    assert tx.score_toxicity(make([], DOCS), net).collect() == []


LABELS = "doc_id long, quality int, toxic int"


def tables(make, texts, labels, parts=3):
    docs = make([(n, t, None, "s", 1, "i", 1) for n, t in enumerate(texts)], DOCS, parts)
    return docs, make([(n, 1, int(x)) for n, x in enumerate(labels)], LABELS, parts)


def test_every_labelled_row_is_learned_from(make):
    # Each of 2,000 words is in six texts: some three of them must be among those that fit the network.
    texts = ["mark" + "abcdefghij"[n % 10] + "klmnopqrst"[n // 10 % 10] + "uvwxyzabcd"[n // 100 % 10] + "ef"[n // 1000 % 2] + " so" for n in range(12_000)]
    net = tx.fit_toxicity(*tables(make, texts, np.arange(12_000) % 5 == 0), F.lit(True), rounds=1)
    types = sorted({t.split()[0] for t in texts})
    whole_words = net.parts(types)[:, 0] < len(net.known)
    assert len(types) == 2000 and whole_words.mean() > 0.93


def test_long_texts_are_read_whole(make):
    rng = np.random.default_rng(4)
    texts, labels = corpus(200, seed=4)
    long = [" ".join(rng.choice(["mo", "ba", "the"], 9_000)) + (" grimzak" if n % 2 else "") for n in range(40)]
    net = tx.fit_toxicity(*tables(make, texts + long, [*labels, *(n % 2 for n in range(40))]), F.lit(True))
    bad, good = net.score([long[1], long[0]])
    assert good < 0.7 <= bad


def test_one_share_equals_training_in_one_place(make):
    for count in (240, 247):  # after 247 rows the random numbers that split them leave a spare half
        texts, labels = corpus(count)
        texts[7], texts[9] = "", "!!!"
        net, plain = tx.fit_toxicity(*tables(make, texts, labels), F.lit(True), rounds=2), tx.train(texts, labels, rounds=2)
        assert np.array_equal(net.known, plain.known) and np.allclose(net.embed, plain.embed, atol=1e-4)
        assert np.allclose(net.score(texts), plain.score(texts), atol=1e-4)


def test_shares_learn_together_however_rows_lie(make, monkeypatch):
    monkeypatch.setattr(tx, "SHARE_ROWS", 150)
    texts, labels = corpus(900)
    one, other = (tx.fit_toxicity(*tables(make, texts, labels, parts), F.lit(True)) for parts in (2, 7))
    assert all(np.array_equal(x, y) for x, y in zip((one.known, one.embed, one.out, one.shifts), (other.known, other.embed, other.out, other.shifts), strict=True))
    unseen, truth = corpus(seed=9)
    assert ((one.score([t.replace("zorgal", "zorgalke") for t in unseen]) >= 0.7) == truth).mean() > 0.95


def test_repeated_rows_and_rows_without_label_or_text(make):
    texts, labels = corpus(200)
    rows = [(n, t, None, "s", 1, "i", 1) for n, t in enumerate(texts)]
    marks = [(n, 1, int(x)) for n, x in enumerate(labels)]
    odd = [(None, "zorgal", None, "s", 1, "i", 1), (900, None, None, "s", 1, "i", 1), (901, "zorgal", None, "s", 1, "i", 1), (902, "zorgal", None, "s", 1, "i", 1)]
    plain = tx.fit_toxicity(make(rows, DOCS), make(marks, LABELS), F.lit(True))
    more = tx.fit_toxicity(make(rows + odd, DOCS), make([*marks, *marks, (None, 1, 1), (900, 1, 1), (902, 1, None)], LABELS), F.lit(True))
    assert np.array_equal(plain.embed, more.embed) and np.array_equal(plain.shifts, more.shifts)
    twice = tx.fit_toxicity(make(rows + rows, DOCS), make(marks, LABELS), F.lit(True))
    assert ((twice.score(texts) >= 0.7) == labels).mean() > 0.95
    for kind in (0, 1):
        constant = tx.fit_toxicity(make(rows, DOCS), make([(n, 1, kind) for n in range(200)], LABELS), F.lit(True)).score(["x"])[0]
        assert (constant > 0.7) == kind
    assert tx.fit_toxicity(make([], DOCS), make(marks, LABELS), F.lit(True)).score(["x"])[0] < 0.7
    wordless = tx.fit_toxicity(*tables(make, ["!!", "", "1", "..", ""], [1, 0, 1, 0, 0]), F.lit(True))
    assert len(wordless.known) == 0 and 0 <= wordless.score(["x"])[0] <= 1


def test_groups_of_words_do_not_change_what_is_learned(monkeypatch):
    texts, labels = corpus(300)
    texts[3] = ""
    whole = tx.train(texts, labels)
    monkeypatch.setattr(tx, "LINE_WORDS", 150)
    grouped = tx.train(texts, labels)
    assert np.allclose(whole.embed, grouped.embed, atol=1e-4) and np.allclose(whole.score(texts), grouped.score(texts), atol=1e-3)


def test_thresholds_from_bins_equal_those_from_all_scores(make):
    rng = np.random.default_rng(5)
    told, truth = rng.integers(0, 5, 3000), (rng.random(3000) < 0.2).astype(int)
    told[truth & (told == 2) > 0] = 1
    odds = np.round(rng.normal(truth * 2.0, 1.0), 3)
    rows = [(int(a), float(b), 1, int(c)) for a, b, c in zip(told, odds, truth, strict=True)]
    plain = []
    for n in range(5):
        best = {}
        mine = (told == n) if truth[told == n].sum() >= 5 else np.ones(3000, bool)
        levels = np.unique(odds[mine])[::-1]
        for at, level in enumerate(levels):
            taken = mine & (odds >= level)
            f1 = 2 * truth[taken].sum() / (taken.sum() + truth[mine].sum())
            best.setdefault(f1, (level + (levels[at + 1] if at + 1 < len(levels) else level - 2)) / 2)
        plain.append(np.log(0.7 / 0.3) - best[max(best)])
    assert np.allclose(tx._calibrated(make(rows, "told long, odds double, n long, hits long"), 0.7), plain)


def test_held_out_quality(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    found = [r for r in entry.queries()["op2_toxicity"](spark, path).collect() if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] == truth[r["doc_id"]] == 1 for r in found)
    assert hits / sum(r["predicted"] for r in found) > 0.85 and hits / sum(truth[r["doc_id"]] for r in found) > 0.85
