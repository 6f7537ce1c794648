"""The corpus index as one job, and a search of it as one call."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.constants import CANDIDATES_PER_BRANCH, PASSAGE_PREFIX, QUERY_PREFIX, TOP_K
from lamina.functions.text import content_hash, embed_text
from lamina.operators import chunking, embed, fulltext, search
from lamina.operators.index import changed_sources
from lamina.operators.relational import filter_metadata
from lamina.session import durable
from lamina.sources import versions
from lamina.sources.files import with_front_matter

#: Columns of the stored index. ``heading`` is what a chunk is about, weighted over its body in keyword search.
INDEX = (
    "chunk_id string, source_type string, source_id string, ordinal int, section string, start_line int, end_line int, title string, "
    "heading string, content string, metadata map<string,string>, source_hash string, embedding array<float>"
)


def source_chunks(files: DataFrame, encoder: Callable = embed.hashing_encoder, dim: int = embed.HASH_DIM) -> DataFrame:
    """Files (path, text) as rows of the index: Markdown as documents, Python and SQL as code; other suffixes have none.

    Documents are cut at their headings and have the title and metadata of their front matter; code is cut at definitions and
    named queries and is about its file and symbol. A file without a chunk, or of code that does not parse, has no row.
    """
    def about(*parts: Column) -> Column:
        return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])

    documents = with_front_matter(files.where(F.col("path").endswith(".md")))
    doc_chunks = chunking.chunk_headings(documents).join(
        documents.select(F.col("doc_id").alias("source_id"), "metadata", "source_hash"), "source_id")
    title = F.col("metadata")["title"]
    docs = doc_chunks.select("*", F.lit("doc").alias("source_type"), title.alias("title"), about(title, F.col("section")).alias("heading"))
    code_files = files.where(F.col("path").endswith(".py") | F.col("path").endswith(".sql"))
    cut = chunking.chunk_definitions(code_files.where(F.col("path").endswith(".py"))).unionByName(
        chunking.chunk_named_sql(code_files.where(F.col("path").endswith(".sql")))).where(F.col("kind") != "reject")
    hashes = code_files.select(F.col("path").alias("source_id"), content_hash(F.col("text")).alias("source_hash"))
    code = cut.join(hashes, "source_id").select(
        "*", F.lit("code").alias("source_type"), F.lit(None).cast("string").alias("title"), about(F.col("source_id"), F.col("section")).alias("heading"),
        F.create_map(F.lit("kind"), "kind").alias("metadata"))
    both = chunking.with_chunk_id(docs.unionByName(code.select(docs.columns)))
    named = both.withColumn("_about", embed_text(*[F.col(c) for c in ("source_type", "source_id", "section", "content", "title")]))
    vectors = embed.embed_batch(named, "_about", prefix=PASSAGE_PREFIX, encoder=encoder, expected_dim=dim)
    return vectors.select(*[c.split()[0] for c in INDEX.split(", ")])


def refresh_index(
    spark: SparkSession, path: str, files: DataFrame, buckets: int = 64, **encoding: object,
) -> DataFrame:
    """Bring the index at ``path`` up to date with ``files`` (path, text), and report (source_type, chunks, missing).

    Only files whose hash is not the indexed one are cut and encoded; their old chunks go. Files that vanished stay, as do
    those that no longer yield a chunk. The new version is published at once, so searches see the
    old index or the new one. ``missing`` counts chunks without a vector or any term.
    """
    if not versions.versions(spark, path):
        versions.create_versioned(spark.createDataFrame([], INDEX), path, buckets=buckets)
    indexed = versions.read_versioned(spark, path)
    # A document is indexed by the name it gives itself.
    documents = with_front_matter(files.where(F.col("path").endswith(".md"))).select("path", F.col("doc_id").alias("source_id"))
    named = files.join(documents, "path", "left").select("path", "text", F.coalesce("source_id", "path").alias("source_id"))
    changed = durable(changed_sources(named, indexed).select("path", "text"))
    versions.upsert_versioned(spark, path, source_chunks(changed, **encoding))
    now = versions.read_versioned(spark, path)
    wordless = F.size(fulltext.words_of(F.concat_ws(" ", "heading", "content"))) == 0
    return now.groupBy("source_type").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull() | wordless).alias("missing"))


def retrieve(
    queries: DataFrame, index: DataFrame, source_type: str, k: int = TOP_K, filters: Mapping[str, object] | None = None,
    mode: str = "hybrid", rerank: bool = False, score: Column | None = None, candidates: int = CANDIDATES_PER_BRANCH,
    encoder: Callable = embed.hashing_encoder, dim: int = embed.HASH_DIM,
) -> DataFrame:
    """The ``k`` best chunks for every query (query_id, text), as rows of the index with rank, score and both branches' ranks.

    ``mode`` is ``hybrid`` (vectors and keywords, fused) or ``dense``. ``filters`` are exact metadata values. Both, and the
    source type, hold before anything is ranked. With ``rerank`` a pool of ``candidates`` is put in a new order by ``score``,
    a column over (text, content), or by the share of query words in the chunk.
    """
    if mode not in ("hybrid", "dense"):
        raise ValueError(f"no mode {mode!r}")
    chunks = filter_metadata(index.where(F.col("source_type") == source_type), filters or {})
    asked = embed.embed_batch(queries.select("query_id", "text"), "text", "vector", prefix=QUERY_PREFIX, encoder=encoder, expected_dim=dim)
    dense = search.knn_exact(asked, chunks.select("chunk_id", "embedding"), candidates)
    keyword = None
    if mode == "hybrid":
        analysis = fulltext.BY_SOURCE_TYPE[source_type]
        clauses = fulltext.parse_questions(queries, analysis=analysis)
        blocks = fulltext.block_index(chunks, analysis=analysis, only=fulltext.asked_terms(clauses))
        keyword = fulltext.search_blocks(blocks, clauses, candidates)
    pool = search.hybrid_search(dense, keyword, chunks.drop("embedding"), candidates if rerank else k)
    if not rerank:
        return pool
    return search.rerank(pool.join(queries.select("query_id", "text"), "query_id"), k, score).drop("text")
