import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from lamina.llm import language_id, mixing, secret_scan
from lamina.llm.packing import Tokens
from lamina.llm.queries import remainder, tokenizer_path

from .conftest import DOCS
from .test_simhash_dedup import plain_fingerprint, plain_groups

GIVEN = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_are_named_in_order():
    assert [name for name, _ in cp.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "packing"]
    assert cp.ORACLE_SQL is None


def test_run_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    field = language_id.fit_languages(docs, remainder(4) != 2)
    names, _ = field.predict([r["text"] for r in rows])
    sure = field.sureness([r["text"] for r in rows])
    rows = [r for r, name, share in zip(rows, names, sure, strict=True) if name != "und" and share >= cp.LEAST_SURENESS]
    roots = plain_groups([plain_fingerprint(r["text"]) for r in rows])
    rows = [r for n, r in enumerate(rows) if roots[n] == n]
    forms = secret_scan._compiled()
    for r in rows:
        strong = secret_scan.strong_parts(r["text"], forms)
        done, text = 0, ""
        for start, end, kind in sorted(strong + secret_scan.linked_parts(r["text"], strong, forms, 200), key=lambda p: (p[0], secret_scan.KINDS.index(p[2]))):
            if start >= done:
                text += r["text"][done:start] + f"[{kind}]"
            done = max(done, end)
        r["text"] = text + r["text"][done:]
    tokens = {r["doc_id"]: max(1, -(-len(r["text"]) // 4)) for r in rows}
    counted = Counter()
    for r in rows:
        counted[r["source"]] += tokens[r["doc_id"]]
    found = cp.run(spark, sf_dir).collect()
    times = Counter(r["doc_id"] for r in found if r["start"] == 0)
    # Every document is read; the repeats of a source follow its tokens.
    assert set(times) == set(tokens) and max(times.values()) == 2 and min(times.values()) == 1
    exponent = mixing.source_plan(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string"), max_repeats=1.5, whole=True).first()["exponent"]
    read = Counter()
    for r in rows:
        read[r["source"]] += tokens[r["doc_id"]] * times[r["doc_id"]]
    most = max(counted.values())
    for source, size in counted.items():
        wanted = size * (size / most) ** (exponent - 1)
        assert wanted - max(t for d, t in tokens.items()) <= read[source] <= wanted + 1
    encode = Tokens(tokenizer_path())
    for r in rows:
        ids = np.r_[np.frombuffer(encode.of(r["text"]), "<u4"), 1].astype("<u4")
        mine = Counter((p["start"], p["length"], p["ids_crc32"]) for p in found if p["doc_id"] == r["doc_id"])
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in mine)
        covered = Counter()
        for (start, length, _), count in mine.items():
            covered.update({at: count for at in range(start, start + length)})
        assert set(covered.values()) == {times[r["doc_id"]]} and len(covered) == len(ids)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5)],
    [(1, "the same words in a row", "en", "a", 23)] * 3 + [(None, "no id here", "en", None, 10), (4, "das ist ein satz von hier " * 3000, "de", "b", 1), (5, "das sind die anderen worte", "de", "b", 1)],
])
def test_odd_rows_pass_every_stage(spark, make, rows):
    docs = make(rows, GIVEN)
    for number, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, "/nowhere")
        if number < 4:
            assert docs.columns == [c.split()[0] for c in GIVEN.split(", ")]
            docs = spark.createDataFrame(docs.collect(), GIVEN)
    assert docs.columns[0] == "doc_id" and len(docs.collect()) >= (1 if len(rows) > 3 else 0)


def test_further_columns_pass(spark, make):
    docs = make([(1, "the token = abcdefgh and words", "en", "s", 30, "i", 2), (2, "the other words, in english", "en", "s", 27, "i", 2), (3, "das haus", "de", "s", 8, "i", 2)], DOCS)
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, "/nowhere")
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[1] == "the [assign] and words"
