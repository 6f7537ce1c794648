import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import importance_resampling as ir
from lamina.llm import radix_sort
from lamina.llm.terms import words_of

SCHEMA = "doc_id long, text string, score long, rank string, id string, row string, at long"
VOCABULARY = ["Plate", "été", "KWH", "x9", "日本", "the", "a", "ß", "straße", "İ"]


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)]


def plain(rows, targets, buckets, most, least, percent):
    def features(text):
        words = plain_words(text)
        return [b" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(zlib.crc32(f) % buckets for text in texts for f in features(text)) for texts in ([r[1] for r in rows], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    found = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        found.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    ordered = sorted((f for f in found if f[4] >= least), key=lambda f: (-f[3], f[0] is None, f[0] or 0, f[1]))
    drawn = ordered[: percent * len(ordered) // 100]
    rest = ordered[len(drawn):] + [f for f in found if f[4] < least]
    return sorted([(*f[:4], n + 1) for n, f in enumerate(drawn)] + [(*f[:4], None) for f in rest], key=str)


@pytest.mark.parametrize("how", [(50, 1, 3, 40), (1000, 2, 5, 100), (7, 3, 1, 33)])
def test_equals_the_plain_form(make, how):
    dice = random.Random(how[0])
    rows = [(n * 7 % 150, " ".join(dice.choices(VOCABULARY, weights=range(10, 0, -1), k=dice.randint(0, 30)))) for n in range(150)]
    rows += [(None, None), (None, "Plate " * 8), (None, "Plate " * 8), (-5, ""), (3, rows[10][1]), (2**62, "A-b_c, straße " * 20_000)]
    targets = ["KWH été x9", None, "", "kwh KWH"]
    docs, target = make([(*r, 9, "r", "i", "w", 4) for r in rows], SCHEMA), make([(t,) for t in targets], "text string")
    buckets, most, least, percent = how
    got = ir.resample(docs, target, buckets=buckets, most=most, least_words=least, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, targets, *how)


def test_empty_tables(make):
    docs, none = make([(1, "a b c", 9, "r", "i", "w", 4)], SCHEMA), make([], "text string")
    assert ir.resample(make([], SCHEMA), none).collect() == []
    assert [tuple(r) for r in ir.resample(docs, none, least_words=1, percent=100).collect()] == plain([(1, "a b c")], [], 10_000, 1, 1, 100)


def test_words_are_cut_by_code_points():
    text = "".join(map(chr, range(0x250))) + " ABC9é\x85Z\xa0_-[`{~\x7f0"
    assert words_of(text.encode()) == plain_words(text)


@pytest.mark.parametrize("digit_bits", [1, 4, 11])
def test_radix_rank_orders_any_longs(spark, monkeypatch, digit_bits):
    monkeypatch.setattr(radix_sort, "LEAST_BLOCK_BITS", 3)
    dice = random.Random(digit_bits)
    ends = [-(2**63), 2**63 - 1, 0, -1, None]
    rows = [(dice.choice([dice.randint(-9, 9), *ends]) if n % 3 else 5, dice.randint(0, 40) if n % 5 else None, n) for n in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, rank long").repartition(5)
    ranked = radix_sort.radix_rank(df.withColumnRenamed("rank", "n"), [(F.col("a"), True), (F.col("b"), False), (F.col("n"), False)], digit_bits=digit_bits)
    got = [r["n"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))
    assert got == [r[2] for r in want]


def test_radix_rank_of_equal_keys_and_no_rows(spark):
    df = spark.range(50, numPartitions=4)
    ranked = radix_sort.radix_rank(df, [(F.lit(1), True)])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 51))
    assert radix_sort.radix_rank(df.where("id < 0"), [(F.col("id"), True)]).collect() == []


def test_gains_follow_the_formula():
    gains = ir.bucket_gains(np.array([3, 0]), np.array([0, 0]))
    assert list(gains) == [math.floor(1000 * math.log(1 * 5 / (4 * 2))), math.floor(1000 * math.log(5 / 2))]


@pytest.mark.parametrize("name", ["op11_resampling", "op12_lexical", "op13_lines"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from check import canonical

    db, path = duckdb.connect(), "/root/testdata/sf0.01"
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got, want = entry.queries()[name](spark, path).toPandas(), db.execute(f"CREATE VIEW v AS {entry.oracle_sql()[name]}").execute("FROM v").df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
