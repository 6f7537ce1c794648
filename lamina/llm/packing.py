"""Packing documents into training sequences of even attention cost.

A piece of n tokens costs ``linear * n + quadratic * n^2``: attention looks back inside a document
only. Documents are tokenized and packed in the task that reads them, in groups of about
``group_tokens`` tokens, so nothing is shuffled and a lost task is repeated by itself.

In a group, documents longer than a sequence give whole sequences first. The rest goes, longest
first, to the sequence of lowest cost that has room for it; as many sequences are open as the tokens
need. When none has room, the piece is cut and fills the emptiest. The tokens over at the end of a
group go to sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import cut

END = 1
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 1 << 20
COLUMNS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_length long, sequence_cost double")


def _slices(text: str) -> Iterator[str]:
    """Consecutive parts of a very long text, cut where no token crosses."""
    start = 0
    while len(text) - start > LONG_TEXT:
        found = re.compile(r" (?=\S)").search(text, start + LONG_TEXT)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE file of the tokenizers library, as bytes with their ids.

    Such files write each byte as a character: printable ones as themselves, the rest from U+0100 on.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", ())}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    return {bytes(map(byte_of.__getitem__, token)): rank for token, rank in model["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a file of the tokenizers library, with their ids."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file).get("added_tokens", ())
    for token in listed:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            raise ValueError(f"added token {token['content']!r} takes in or depends on its surroundings, which is not supported")
    return {token["content"]: token["id"] for token in listed}


class Tokens:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The file is a byte-level BPE of the tokenizers library with ids in the order of merging. Its tokens
    are applied by tiktoken, which gives the same ids four times as fast. Names of added tokens in a
    text are ordinary text, or with ``added`` their ids, as the tokenizers library gives by default; the
    parts between them are then texts of their own.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        self.encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=byte_level_ranks(path), special_tokens={})
        self.added = added_tokens(path) if added else {}
        # Of two names that begin at the same place the longer is meant.
        names = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, names))})").split if names else lambda text: [text]

    def of(self, text: str) -> bytes:
        found = []
        for at, between in enumerate(self.split(text)):
            if at % 2:
                found.append(np.array([self.added[between]], "<u4").tobytes())
            elif between:
                found += [np.array(self.encoding.encode_ordinary(part), "<u4").tobytes() for part in _slices(between)]
        return b"".join(found)


def pack_lengths(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Pieces ``(document, start, length, sequence, offset)``, and the length and cost of each sequence.

    Each token lies in one piece, and each sequence has ``size`` tokens or a power of two.
    """
    pieces, whole, rest = [], 0, []
    for doc, length in enumerate(lengths):
        full, left = divmod(length, size)
        pieces += [(doc, k * size, size, whole + k, 0) for k in range(full)]
        whole += full
        if left:
            rest.append((left, doc, full * size))
    full, left = divmod(sum(r[0] for r in rest), size)
    sizes = np.array([size] * full + [1 << b for b in reversed(range(size.bit_length())) if left >> b & 1], np.int64)
    room, costs = sizes.copy(), np.zeros(len(sizes))

    def put(at: int, doc: int, start: int, length: int) -> None:
        pieces.append((doc, start, length, whole + at, int(sizes[at] - room[at])))
        room[at] -= length
        costs[at] += linear * length + quadratic * length * length

    for length, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        at = int(np.argmin(np.where(room >= length, costs, np.inf)))
        if room[at] >= length:
            put(at, doc, start, length)
            continue
        while length:
            at = int(np.argmax(room))
            step = min(length, int(room[at]))
            put(at, doc, start, step)
            start, length = start + step, length - step
    return pieces, np.r_[np.full(whole, size), sizes], np.r_[np.full(whole, linear * size + quadratic * size * size), costs]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
    group_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 2048, with_ids: bool = False,
    added: bool = False,
) -> DataFrame:
    """One row per piece: the id column, ``COLUMNS`` and, on wish, the piece's ``ids``.

    A document is its tokens and the end token; a null or empty text is the end token alone. Repeated
    rows and null ids are packed like others. Sequence ids are unique but not consecutive. No rows: no
    rows. Further columns are not read. ``tokenizer_path`` must exist on every executor. With ``added``
    the added tokens of its file are found in the texts; without, their names are ordinary text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {COLUMNS}" + (", ids array<long>" if with_ids else "")

    def packed(ids: list, held: list[bytes], first: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
        lengths = [len(x) // 4 for x in held]
        pieces, sizes, costs = pack_lengths(lengths, size, linear, quadratic)
        doc, start, length, seq, offset = np.array(pieces, np.int64).T
        sums = [zlib.crc32(memoryview(held[d])[4 * s:4 * (s + n)]) for d, s, n, _, _ in pieces]
        arrays = [pa.array([ids[d] for d in doc], id_type), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                  pa.array(np.array(lengths, np.int64)[doc]), pa.array(first + seq), pa.array(offset),
                  pa.array(sizes[seq].astype(np.int64)), pa.array(costs[seq])]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(held[d], "<u4")[s:s + n].astype(np.int64) for d, s, n, _, _ in pieces], pa.list_(pa.int64())))
        names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names=names), first + len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, end = None, np.array([END], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        ids, held, count = [], [], 0
        for whole in batches:
            for batch in cut(whole, 1, 2 << 20):
                tokens = tokens or Tokens(tokenizer_path, added)
                found = [tokens.of(text or "") for text in batch.column(1).to_pylist()]
                for key, got in zip(batch.column(0).to_pylist(), found, strict=True):
                    ids.append(key)
                    held.append(got + end)
                    count += len(got) // 4 + 1
                    if count >= group_tokens:
                        out, first = packed(ids, held, first, batch.schema.field(0).type)
                        yield out
                        ids, held, count = [], [], 0
                kind = batch.schema.field(0).type
        if ids:
            yield packed(ids, held, first, kind)[0]

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
