import random

import numpy as np
import xxhash

from lamina.llm import simhash_dedup as sd

from .conftest import DOCS


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fingerprints):
    """Smallest position reachable over at most two differing bits."""
    n = len(fingerprints)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if root[j] < root[i] and (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2:
                    root[i], changed = root[j], True
    return root


def test_fingerprints_follow_the_definition():
    texts = [None, "", " \n ", "a", "A b", "a b c d", "One two three four", "x y z " * 400, "É é", "tab\tand\x0bmore\x0cwords here"]
    assert sd.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_every_word_lies_within_three_bits_of_its_code_word():
    table = sd.golay_decoder()
    codes = np.zeros(1, np.uint32)
    for shift in range(12):
        codes = np.concatenate([codes, codes ^ np.uint32(sd.GENERATOR << shift)])
    words = np.random.default_rng(0).integers(0, 1 << 23, 20_000).astype(np.uint32)
    assert np.bitwise_count(words ^ codes[table[words]]).max() <= 3


def test_fingerprints_two_bits_apart_share_a_key():
    decoder, rng = sd.golay_decoder(), random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 1, 2])))
        rows, keys = sd.golay_keys(np.array([a, b], np.uint64), decoder)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def _near(spark, values, bucket):
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(values))], "fp long")
    return {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in sd.near_links(frame, bucket).collect()}


def test_links_with_and_without_large_buckets_give_the_same_groups(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for seed in values[:8]:
        at = seed
        for _ in range(12):
            at ^= sum(1 << i for i in rng.sample(range(64), 2))
            values.append(at)
    values += [values[0] ^ (1 << i) for i in range(64)] + [0, 1 << 63, (1 << 64) - 1]
    values = sorted(set(values))
    wanted = plain_groups(values)
    for bucket in (1, 4, 1000):
        links = _near(spark, values, bucket)
        at = {v: n for n, v in enumerate(values)}
        assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, links))
        root = list(range(len(values)))
        changed = True
        while changed:
            changed = False
            for a, b in map(tuple, links):
                low = min(root[at[a]], root[at[b]])
                if root[at[a]] != low or root[at[b]] != low:
                    root[at[a]] = root[at[b]] = low
                    changed = True
        assert root == wanted


def test_query_equals_brute_force(spark, sf_dir):
    import __spark_entry__ as entry

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    wanted = [(d, f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, plain_groups(prints), strict=True)]
    assert sorted(tuple(r) for r in entry.queries()["op4_simhash"](spark, sf_dir).collect()) == wanted


def test_odd_rows(make):
    rows = [(5, None, None, None, None, "x", 9), (3, "", "en", "s", 0, "x", 9), (7, "same words here now", "en", "s", 1, "x", 9),
            (6, "Same  words\nhere now", "en", "s", 1, "x", 9), (6, "Same  words\nhere now", "en", "s", 1, "x", 9), (None, "same words here now", None, None, None, None, None),
            (9, "word " * 30_000, "en", "s", 1, "x", 9)]
    found = sorted(((r["id"], r["component"]) for r in sd.simhash_groups(make(rows, DOCS)).collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (7, 6), (6, 6), (6, 6), (None, 6), (9, 9)], key=str)
    kept = sd.drop_near_copies(make(rows, DOCS))
    assert kept.columns == make(rows, DOCS).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 9]
    assert sd.simhash_groups(make([], DOCS)).collect() == [] and sd.drop_near_copies(make([], DOCS)).collect() == []


def test_one_row_of_each_group_stays(make):
    """Rows are told by id and text: a repeated id loses nothing, and rows without one are grouped like others."""
    rows = [(1, "the first text under this id", "a"), (1, "an entirely different second text", "b"), (2, "something else again for two", "c"),
            (3, "the first text under this id", "d"), (None, "nobody numbered these words", "e"), (None, "nobody numbered these words", "f"),
            (None, "nobody numbered these words", "g"), (None, "an entirely different second text", "h"), (None, "lone words without a number", "i")]
    kept = sd.drop_near_copies(make(rows, "doc_id long, text string, _row string"))
    assert kept.columns == ["doc_id", "text", "_row"]
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted({(r[0], r[1]) for n, r in enumerate(rows) if n in (0, 1, 2, 4, 8)}, key=str)


def test_names_of_given_columns_meet_no_others(make):
    schema = "doc_id long, text string, id string, mark string, row string, place string, _kept string, _row string, root string"
    kept = sd.drop_near_copies(make([(1, "a few words here", *"abcdefg"), (2, "a few words here", *"abcdefg")], schema))
    assert [tuple(r) for r in kept.collect()] == [(1, "a few words here", *"abcdefg")]
