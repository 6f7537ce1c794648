"""Words of many texts at once, numbered by type, with hashed character features of the types."""

from __future__ import annotations

import re

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def number_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different lower-case words, the number of each word in reading order, and words per text."""
    table = _Numbers()
    number, parts, lengths = table.__getitem__, [], np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        words = LETTERS.findall(text.lower()) if text else []
        lengths[at] = len(words)
        parts.append(np.fromiter(map(number, words), np.int32, len(words)))
    types, every = list(table), np.concatenate(parts) if parts else np.zeros(0, np.int32)
    # Signs such as a superscript two count as word characters but are no letters.
    lettered = np.fromiter((word.isalpha() or any(map(str.isalpha, word)) for word in types), bool, len(types))
    if not lettered.all():
        kept = lettered[every]
        owner = np.repeat(np.arange(len(texts)), lengths)
        every, lengths = every[kept], np.bincount(owner[kept], minlength=len(texts))
    return types, every, lengths


def join_words(table: dict[str, int], types: list[str]) -> np.ndarray:
    """The number of each type in ``table``, to which types not yet there are added in order."""
    return np.fromiter((table.setdefault(word, len(table)) for word in types), np.int32, len(types))


def _mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (hashes + np.uint64(kind)) * _SPREAD
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _codes(types: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all types with a zero before and after each; where each begins; lengths."""
    joined = "\0" + "\0".join(types) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, types), np.int64, len(types))
    return codes, np.cumsum(lengths + 1) - lengths, lengths


def _whole(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(int(lengths.max()) if len(lengths) else 0, 1000003, np.uint64), dtype=np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.r_[0, begins], np.r_[1, lengths + 1])
    inside = np.repeat(np.r_[False, np.ones(len(lengths), bool)], np.r_[1, lengths + 1])
    inside[begins + lengths] = False
    terms = np.zeros(len(codes), np.uint64)
    terms[inside] = codes[inside] * powers[place[inside]]
    return np.add.reduceat(terms, begins) if len(begins) else np.zeros(0, np.uint64)


def prefix_features(types: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each whole word and of its first 2, 3, ... ``longest`` letters, and which exist."""
    codes, begins, lengths = _codes(types)
    places = np.arange(longest)
    letters = codes[np.minimum(begins[:, None] + places, len(codes) - 1)] * (places < lengths[:, None])
    powers = np.cumprod(np.full(longest, 1000003, np.uint64), dtype=np.uint64)
    starts = np.cumsum(letters * powers, axis=1, dtype=np.uint64)[:, 1:]
    hashes = np.column_stack([_mixed(_whole(codes, begins, lengths), 1), *[_mixed(starts[:, k], k + 2) for k in range(longest - 1)]])
    exists = np.column_stack([np.ones(len(types), bool), lengths[:, None] >= np.arange(2, longest + 1)])
    return hashes, exists


def ngram_features(types: list[str], inner: int, affix: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of each whole word, its n-grams of ``inner`` letters, its beginning and its end.

    A word's edges count as letters, so n-grams with an edge are affixes; ``affix`` adds longer ones.
    """
    codes, begins, lengths = _codes(types)
    every = np.arange(len(types))
    owners, hashes = [every], [_mixed(_whole(codes, begins, lengths), 1)]

    def add(owner: np.ndarray, at: np.ndarray, size: int) -> None:
        value = codes[at]
        for k in range(1, size):
            value = value * np.uint64(1000003) + codes[at + k]
        owners.append(owner)
        hashes.append(_mixed(value, 100 + size))

    count = np.maximum(lengths + 3 - inner, 0)
    owner = np.repeat(every, count)
    add(owner, np.repeat(begins - 1, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), inner)
    long = every[lengths >= affix]
    add(long, begins[long] - 1, affix + 1)
    add(long, begins[long] + lengths[long] - affix, affix + 1)
    return np.concatenate(owners), np.concatenate(hashes)
