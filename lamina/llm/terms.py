"""Words of whole texts as bytes: runs of ASCII letters and digits and of everything beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    return byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20


#: A-Z become small, other bytes of ASCII that are neither letter nor digit become a space. Bytes of
#: longer UTF-8 sequences stay, so cutting bytes is cutting code points.
_TABLE = bytes(map(_folded, range(256)))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in order, lower-cased in A-Z only; none of a null."""
    return text.translate(_TABLE).split() if text else []


def utf8(text: Column) -> Column:
    """A text as bytes, so that no task needs to decode it."""
    return text.cast("string").cast("binary")
