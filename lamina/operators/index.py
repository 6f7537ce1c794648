"""The corpus index: postings, incremental refresh and health."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.constants import BODY_WEIGHT, FRENCH_STOP_WORDS, HEADING_WEIGHT
from lamina.functions.text import content_hash
from lamina.operators import fulltext
from lamina.session import durable
from lamina.sources.sinks import upsert_by_source

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def term_index(
    chunks: DataFrame, chunk_id: str = "chunk_id", heading: str = "heading",
    content: str = "content", stop_words: Sequence[str] = FRENCH_STOP_WORDS, stem: bool = True,
    only: DataFrame | None = None, analysis: Mapping[str, fulltext.Analysis] | None = None, config: str | None = None,
) -> DataFrame:
    """Postings (chunk_id, term, weight, tf, positions): heading terms weigh A, body terms B.

    Words are stemmed by the French rules unless ``stem`` is false. With ``config``, a column such as the
    source type, ``analysis`` says for each of its values what to do instead: documents are stemmed, code is not.
    ``only`` holds the terms worth counting, when the postings serve one batch of queries.
    A chunk is one row, so its terms are counted inside the row. No text and no single term is shuffled.
    """
    how = analysis if config else fulltext.Analysis(tuple(stop_words), stem)
    places = fulltext.positional_index(chunks, chunk_id, heading, content, how, config)
    if only is not None:
        places = places.join(only.select("term").distinct(), "term", "left_semi")
    inside = F.col("headings")
    weights = F.array(
        F.struct(F.lit("A").alias("weight"), F.slice("positions", 1, F.greatest(inside, F.lit(0))).alias("positions")),
        F.struct(F.lit("B").alias("weight"), F.slice("positions", inside + 1, F.size("positions")).alias("positions")),
    )
    sides = places.select("chunk_id", "term", F.explode(weights).alias("_s")).select("chunk_id", "term", "_s.weight", "_s.positions")
    return sides.where(F.size("positions") > 0).select(
        "chunk_id", "term", "weight", F.size("positions").cast("bigint").alias("tf"), "positions")


def weight_value() -> Column:
    """Rank weight of a posting."""
    return F.when(F.col("weight") == "A", HEADING_WEIGHT).otherwise(BODY_WEIGHT)


def changed_sources(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (source_id, text) whose hash is not the indexed one, with ``source_hash`` added."""
    hashed = files.withColumn("source_hash", content_hash(F.col("text")))
    known = indexed.select("source_id", "source_hash").distinct()
    return hashed.join(known, ["source_id", "source_hash"], "left_anti")


def index_incremental(
    files: DataFrame, indexed: DataFrame, chunker: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The refreshed chunk table.

    Only changed or new sources are chunked, once; their old rows go. Sources that vanished stay,
    as does a changed source that no longer yields any chunk. ``chunker`` copies ``source_id`` to
    its chunks; the hash travels with it.
    """
    changed = changed_sources(files, indexed)
    mark = F.concat("source_hash", F.lit(":"), "source_id")
    chunked = chunker(changed.withColumn("source_id", mark))
    size = F.length(F.substring_index("source_id", ":", 1))
    fresh = chunked.withColumns({
        "source_hash": F.substring_index("source_id", ":", 1),
        "source_id": F.substring(F.col("source_id"), size + 2, F.length("source_id")),
    })
    return upsert_by_source(indexed, durable(fresh.select(*indexed.columns)))


def index_health(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """Chunks per source type, and how many lack a vector or any term."""
    posted = postings.select("chunk_id").distinct().withColumn("_has_terms", F.lit(True))
    joined = chunks.join(posted, "chunk_id", "left")
    incomplete = F.col("embedding").isNull() | F.col("_has_terms").isNull()
    return joined.groupBy("source_type").agg(
        F.count("*").alias("chunks"), F.count_if(incomplete).alias("missing")
    )
