import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lamina.llm.packing import pack_documents, pack_lengths
from lamina.llm.queries import tokenizer_path

from .conftest import DOCS


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 1, 1], [1000] * 37, list(range(1, 600, 7)), [2047, 2047, 2, 2]])
def test_each_token_lies_in_one_piece(lengths):
    pieces, sizes, costs = pack_lengths(lengths, 2048, 1.0, 1 / 2048)
    spans, filled = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        spans[doc].append((start, length))
        filled[sequence].append((offset, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, part in sorted(spans[doc]):
            assert start == at and part > 0
            at += part
        assert at == length
    for sequence, parts in filled.items():
        at = 0
        for offset, part in sorted(parts):
            assert offset == at
            at += part
        assert at == sizes[sequence] <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert sorted(filled) == list(range(len(sizes))) and len(costs) == len(sizes)


def test_costs_are_even():
    rng = np.random.default_rng(1)
    lengths = rng.integers(50, 1500, 900).tolist()
    _, sizes, costs = pack_lengths(lengths, 2048, 1.0, 1 / 2048)
    given = list(lengths)
    rng.shuffle(given)
    first_fit = np.zeros(len(costs) * 2)
    room = np.full(len(first_fit), 2048)
    for length in given:
        at = int(np.argmax(room >= length))
        room[at] -= length
        first_fit[at] += length + length * length / 2048
    full = costs[sizes == 2048]
    assert full.std() < first_fit[room < 400].std()


def test_pieces_hold_the_tokens_of_the_tokenizer(make):
    texts = ["", None, "a", "Hello  world\n\n foo ", "x " * 5000, "<|endoftext|> é ß", "a\x1c b", "w" * 3000, "Hello  world\n\n foo "]
    docs = make([(n, t, "en", "s", 1, "i", 2) for n, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None)], DOCS)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    found = pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    for n, text in [*enumerate(texts), (None, "no id")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in found if r["doc_id"] == n), key=lambda r: r["start"])
        assert [i for r in mine for i in r["ids"]] == ids and {r["doc_tokens"] for r in mine} == {len(ids)}
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    for parts in filled.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at == size
    assert pack_documents(make([], DOCS), tokenizer_path()).collect() == []


def test_long_texts_are_tokenized_in_parts(monkeypatch):
    from lamina.llm import packing

    text = "some words,  and\n more words " * 60
    whole = packing.Tokens(tokenizer_path()).of(text)
    monkeypatch.setattr(packing, "LONG_TEXT", 100)
    assert packing.Tokens(tokenizer_path()).of(text) == whole


def test_added_tokens_have_their_ids(monkeypatch, tmp_path, make):
    from lamina.llm import packing
    from lamina.llm.queries import op3_packing

    name, tokenizer = "<|endoftext|>", Tokenizer.from_file(tokenizer_path())
    texts = [f"a{name}b", name, name * 3, f"  {name}  é {name}\n", f"<|endoftext| {name[1:]}<{name}", "plain", "", "some words,  and " * 40 + name + " more  words" * 40]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert want[0] == [64, 50256, 65]
    for bound in (packing.LONG_TEXT, 100):
        monkeypatch.setattr(packing, "LONG_TEXT", bound)
        tokens = packing.Tokens(tokenizer_path(), added=True)
        assert [np.frombuffer(tokens.of(text), "<u4").tolist() for text in texts] == want
    docs = make([(n, t, "en", "s", 1, "i", 2) for n, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_packing(docs.sparkSession, str(tmp_path)).collect():
        ids = want[r["doc_id"]] + [1]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
