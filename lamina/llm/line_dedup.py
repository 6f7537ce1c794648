"""Dropping lines that many documents share, in DataFrame operations only.

Lines are exploded, normalised and hashed; a row per line is the hash, the document and the place, not the
text. Documents are counted by hash, and the lines of hashes found in enough documents, but for the first
document holding them, give each document a set of places to drop. The text meets that set once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import durable

#: The white space stripped from both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond A-Z that lower-casing would change too.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def small(text: Column) -> Column:
    """A text in small letters, of A-Z alone. Where it has no other capitals, that is plain lower-casing, which is faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).when(text.rlike(OTHER_CAPITALS), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, least_docs: int = 2,
) -> DataFrame:
    """``docs`` with the text kept, ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced.

    A key of at least ``least_chars`` code points in at least ``least_docs`` documents loses its lines everywhere
    but in the document of the smallest id. Null and empty texts have one empty line, and the text kept is empty. Rows
    that repeat an id are one document: they count once and keep their lines together. Rows without
    an id are one document too, behind all others. No rows: no rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Equal rows share their places, so a row is told by its id and a hash of its text.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"),
        F.unhex(F.md5(text.cast("binary"))).alias("mark"))
    exploded = rows.select("id", "mark", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    stripped = exploded.select("id", "mark", "at", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.length("line") >= least_chars)
    lines = stripped.select("id", "mark", "at", F.unhex(F.md5(small(F.col("line")).cast("binary"))).alias("hash"))
    documents = F.count_distinct("id") + F.max(F.when(F.col("id").isNull(), 1).otherwise(0))
    shared = lines.groupBy("hash").agg(F.min("id").alias("first"), documents.alias("n")).where(F.col("n") >= least_docs)
    # Written first, it meets the lines in an exchange of its own, of which Spark splits a line that very many documents share.
    places = (
        lines.join(durable(shared.select("hash", "first")), "hash").where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("d_id"), F.col("mark").alias("d_mark")).agg(F.collect_set("at").alias("places"))
    )
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")

    # Binding the lines to a lambda cuts a text once.
    cut = F.transform(F.array(_lines(F.col("text"))), kept)[0]
    dropped = F.coalesce(F.size("places"), F.lit(0))
    made = joined.select(
        "row", F.when(F.col("places").isNull(), F.col("text")).otherwise(cut).alias("text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns], "n_lines", "n_dropped")
