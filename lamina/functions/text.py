"""Text flags, normalisation, hashing and citation strings."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.constants import FRENCH_MARKERS, REFUSAL_MARKERS


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike("|".join(rf"\Q{phrase}\E" for phrase in phrases))


def detect_language(text: Column) -> Column:
    """``fr`` when any French marker occurs, else ``en``."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.when(_contains_any(padded, FRENCH_MARKERS), "fr").otherwise("en")


def is_refusal(answer: Column) -> Column:
    """True when an answer declines to answer."""
    return _contains_any(F.lower(answer), REFUSAL_MARKERS)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every character whose decomposition is one ASCII character plus combining marks."""
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and ord(base[0]) < 0x80:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def normalise_text(text: Column) -> Column:
    """Lower case without accents; each run of other characters becomes one space; trimmed."""
    accented, plain = _accent_table()
    lowered = F.lower(text)
    bare = F.regexp_replace(F.translate(lowered, accented, plain), r"\p{Mn}+", "")
    # Texts without a letter outside ASCII skip the character table.
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(lowered)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9 ]+", " "))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256, the key of incremental indexing."""
    return F.substring(F.sha2(text, 256), 1, 16)


def embed_text(
    source_type: Column, source_id: Column, section: Column, content: Column, title: Column
) -> Column:
    """The text to embed: what the chunk is about, a blank line, then its body."""
    about_doc = F.concat_ws(" > ", F.coalesce(title, source_id), F.nullif(section, F.lit("")))
    symbol = F.coalesce(F.nullif(section, F.lit("")), F.lit("module"))
    about_code = F.concat(F.lit("File: "), source_id, F.lit("\nSymbol: "), symbol)
    about = F.when(source_type == "doc", about_doc).otherwise(about_code)
    return F.concat(about, F.lit("\n\n"), content)


def citation(
    source_type: Column, source_id: Column, section: Column, start_line: Column, end_line: Column
) -> Column:
    """``[id §section]`` for documents (without the leading title), ``file:Lx-Ly`` for code."""
    short = F.regexp_replace(section, r"(?s)^.*? > ", "")
    doc = F.when(
        F.length(section) > 0, F.concat(F.lit("["), source_id, F.lit(" §"), short, F.lit("]"))
    ).otherwise(F.concat(F.lit("["), source_id, F.lit("]")))
    lines = F.concat(source_id, F.lit(":L"), start_line, F.lit("-L"), end_line)
    code = F.when(start_line.isNotNull(), lines).otherwise(source_id)
    return F.when(source_type == "doc", doc).otherwise(code)
