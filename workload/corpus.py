"""Chunking, hashing, postings, vectors and the incremental index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina.functions.text import content_hash, embed_text
from lamina.operators import chunking, embed, fulltext, index, semantic
from lamina.plans import retrieval
from lamina.session import shared_dir
from lamina.sources import versions
from workload import sqltext
from workload import tables as t
from workload.registry import query


def _packed(source: str, body: str, columns: str = "", extra: str = "") -> str:
    """Greedy packing of lines to 2,000 characters with 200 repeated, one step per line."""
    return f"""WITH RECURSIVE pieces AS (SELECT {source} AS source_id{columns}, b,
        string_split(b, chr(10)) AS p FROM (SELECT *, {body} AS b FROM documents)),
    fold AS (
      SELECT source_id, 1 AS i, p[1] AS part, 0 AS ordinal, CAST(NULL AS VARCHAR) AS done FROM pieces
      WHERE length(b) > 2000
      UNION ALL
      SELECT f.source_id, i + 1,
        CASE WHEN part <> '' AND length(part) + 1 + length(p[i + 1]) > 2000
          THEN right(part, 200) || chr(10) || p[i + 1]
          WHEN part <> '' THEN part || chr(10) || p[i + 1] ELSE p[i + 1] END,
        ordinal + CASE WHEN part <> '' AND length(part) + 1 + length(p[i + 1]) > 2000 THEN 1 ELSE 0 END,
        CASE WHEN part <> '' AND length(part) + 1 + length(p[i + 1]) > 2000 THEN part END
      FROM fold f JOIN pieces USING (source_id) WHERE i < len(p)),
    parts AS (
      SELECT source_id, 0 AS ordinal, b AS content FROM pieces WHERE length(b) <= 2000
      UNION ALL SELECT source_id, ordinal - 1, done FROM fold WHERE done IS NOT NULL
      UNION ALL SELECT source_id, ordinal, part FROM fold JOIN pieces USING (source_id)
        WHERE i = len(p) AND part <> '')
    SELECT parts.source_id, CAST(ordinal AS INTEGER) AS ordinal, content{extra}
    FROM parts JOIN pieces USING (source_id)"""


@query(
    "chunk_headings",
    _packed("CAST(doc_id AS VARCHAR)", sqltext.stripped("text"), ", source || ' > ' || lang AS section",
            ", section") + " WHERE b <> ''",
)
def _(spark, sf):
    body = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), "text")
    documents = t.spread_table(spark, sf, "documents").select("doc_id", body.alias("body"))
    chunks = chunking.chunk_headings(documents, separator="\n")
    return chunks.select("source_id", "ordinal", "section", "content")


@query("chunk_split_long", _packed("CAST(doc_id AS VARCHAR)", "text"))
def _(spark, sf):
    return chunking.chunk_split_long(
        t.spread_table(spark, sf, "documents"), "doc_id", "text", separator="\n"
    )


@query(
    "chunk_named_sql",
    f"""SELECT source_id, CAST(0 AS INTEGER) AS ordinal, 'a' || doc_id AS section,
      CAST(1 AS INTEGER) AS start_line, CAST(n + 1 AS INTEGER) AS end_line,
      {sqltext.stripped("'-- name: a' || doc_id || chr(10) || text")} AS content, 'query' AS kind FROM docs
    UNION ALL SELECT source_id, 1, 'b' || doc_id, n + 2, n + 3,
      '-- name: b' || doc_id || chr(10) || 'SELECT 1', 'query' FROM docs""".replace(
        "FROM docs",
        "FROM (SELECT *, 'q' || doc_id || '.sql' AS source_id, len(string_split(text, chr(10))) AS n FROM documents)",
    ),
)
def _(spark, sf):
    text = F.concat(
        F.lit("-- name: a"), "doc_id", F.lit("\n"), "text", F.lit("\n-- name: b"), "doc_id",
        F.lit("\nSELECT 1\n"),
    )
    sources = t.spread_table(spark, sf, "documents").select(
        F.concat(F.lit("q"), "doc_id", F.lit(".sql")).alias("path"), text.alias("text")
    )
    return chunking.chunk_named_sql(sources)


@query(
    "chunk_definitions",
    """SELECT 'p' || p_partkey || '.py' AS source_id, ordinal, section, start_line, end_line,
    content, kind FROM part, LATERAL (VALUES
      (0, 'module', 1, 5, 'import math' || chr(10) || chr(10) || 'SIZE = ' || p_size, 'module'),
      (1, 'first_' || p_partkey, 6, 8, '@cache' || chr(10) || 'def first_' || p_partkey || '(x):' ||
          chr(10) || '    return x * ' || p_size, 'function'),
      (2, 'Second', 11, 13, 'class Second:' || chr(10) || '    def one(self):' || chr(10) ||
          '        return ' || p_partkey, 'class')
    ) AS v(ordinal, section, start_line, end_line, content, kind)""".replace("'module', 1, 5", "'module', 1, 10"),
)
def _(spark, sf):
    code = F.concat(
        F.lit("import math\n\nSIZE = "), "p_size", F.lit("\n\n\n@cache\ndef first_"), "p_partkey",
        F.lit("(x):\n    return x * "), "p_size",
        F.lit("\n\n\nclass Second:\n    def one(self):\n        return "), "p_partkey", F.lit("\n"),
    )
    sources = t.table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), code.alias("text")
    )
    return chunking.chunk_definitions(sources)


@query(
    "embed_text",
    "SELECT chunk_id, title || ' > ' || section || chr(10) || chr(10) || content AS embed_text FROM chunks",
    "chunks",
)
def _(spark, sf):
    columns = [F.col(c) for c in ("source_type", "source_id", "section", "content", "title")]
    return t.chunks(spark, sf).select("chunk_id", embed_text(*columns).alias("embed_text"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(spark, sf):
    return t.spread_table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@query(
    "index_incremental",
    _packed("'doc-' || doc_id", "text").replace(
        "SELECT parts.source_id, CAST(ordinal AS INTEGER) AS ordinal, content",
        "SELECT 'bench-' || item_id AS source_id, CAST(0 AS INTEGER) AS ordinal, text AS content FROM "
        "benchmark UNION ALL SELECT parts.source_id, CAST(ordinal AS INTEGER) AS ordinal, content",
    ),
)
def _(spark, sf):
    documents = t.spread_table(spark, sf, "documents")
    sources = documents.select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), "text", "lang")

    def chunker(changed):
        return chunking.chunk_split_long(changed, "source_id", "text", separator="\n")

    # Indexed before: English and French as they are, German out of date, Spanish not yet, and
    # passages whose source has vanished since.
    current = sources.filter(F.col("lang").isin("en", "fr"))
    hashes = current.select("source_id", content_hash(F.col("text")).alias("source_hash"))
    fresh = chunker(current).join(hashes, "source_id")
    stale = sources.filter(F.col("lang") == "de").select(
        "source_id", F.lit(0).alias("ordinal"), F.lit("old").alias("content"),
        F.lit("0").alias("source_hash"),
    )
    vanished = t.table(spark, sf, "benchmark").select(
        F.concat(F.lit("bench-"), "item_id").alias("source_id"), F.lit(0).alias("ordinal"),
        F.col("text").alias("content"), content_hash(F.col("text")).alias("source_hash"),
    )
    columns = ["source_id", "ordinal", "content", "source_hash"]
    indexed = fresh.select(*columns).unionByName(stale).unionByName(vanished)
    refreshed = index.index_incremental(sources.select("source_id", "text"), indexed, chunker)
    return refreshed.drop("source_hash")


@query(
    "index_refresh",
    f"""WITH texts AS (SELECT *, CASE WHEN lang = 'de' THEN 'neu ' || text ELSE text END AS now FROM documents)
    SELECT 'doc' AS source_type, 'doc-' || doc_id AS source_id, CAST(0 AS INTEGER) AS ordinal, source || ' > ' || lang AS section,
      CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, source || ' ' || source || ' > ' || lang AS heading, lang AS kind,
      md5({sqltext.stripped('now')}) AS content, lang <> 'es' OR doc_id % 2 = 0 AS kept_old FROM texts WHERE {sqltext.stripped('now')} <> ''
    UNION ALL
    SELECT 'code', 'p' || p_partkey || '.sql', 0, 'top_' || p_partkey, 1, 2, 'p' || p_partkey || '.sql top_' || p_partkey, 'query',
      md5('-- name: top_' || p_partkey || chr(10) || 'SELECT ' || p_size), true FROM part""",
)
def _(spark, sf):
    """Documents as Markdown files and parts as SQL files, indexed in two runs: the second brings changed German files and
    half of the Spanish ones, the rest of which it lacks and the index keeps."""
    documents = t.spread_table(spark, sf, "documents")
    head = F.concat(F.lit("---\ndoc_id: doc-"), "doc_id", F.lit("\ntitle: "), "source", F.lit("\nlang: "), "lang", F.lit("\n---\n# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"))
    path = F.concat(F.lit("d"), "doc_id", F.lit(".md"))
    first = documents.select(path.alias("path"), F.concat(head, "text").alias("text"))
    body = F.concat(F.when(F.col("lang") == "de", "neu ").otherwise(""), "text")
    second = documents.where((F.col("lang") != "es") | (F.col("doc_id") % 2 == 0)).select(path.alias("path"), F.concat(head, body).alias("text"))
    queries = t.table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey", F.lit(".sql")).alias("path"),
        F.concat(F.lit("-- name: top_"), "p_partkey", F.lit("\nSELECT "), "p_size").alias("text"))
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    retrieval.refresh_index(spark, folder, first.unionByName(queries), buckets=8)
    retrieval.refresh_index(spark, folder, second, buckets=8)
    found = versions.read_versioned(spark, folder)
    number = F.regexp_extract("source_id", r"^doc-(\d+)$", 1)
    spanish = F.col("metadata")["lang"] == "es"
    return found.select(
        "source_type", "source_id", "ordinal", "section", "start_line", "end_line", "heading", F.coalesce(F.col("metadata")["lang"], F.col("metadata")["kind"]).alias("kind"),
        F.md5(F.col("content").cast("binary")).alias("content"),
        (~F.coalesce(spanish, F.lit(False)) | (number.try_cast("bigint") % 2 == 0)).alias("kept_old"))


@query(
    "term_index", sqltext.postings("heading", "content", "chunk_id", "chunks"), "chunks",
)
def _(spark, sf):
    found = index.term_index(t.chunks(spark, sf))
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(
    "french_stems",
    sqltext.stemmed(f"SELECT DISTINCT unnest({sqltext.words('text')}) AS word FROM documents"),
)
def _(spark, sf):
    words = t.spread_table(spark, sf, "documents").select(F.explode(fulltext.words_of(F.col("text"))).alias("word"))
    return fulltext.stems(words.distinct())


@query(
    "embed_batch",
    "SELECT id AS chunk_id, CAST(cell AS INTEGER) AS cell, round(v, 6) AS v FROM "
    f"({sqltext.cells('doc_id', 'text', 'passage: ', 'documents')})",
)
def _(spark, sf):
    vectors = embed.embed_batch(t.chunks(spark, sf).select("chunk_id", "content"), "content")
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("cell", "v"))
    return cells.filter(F.col("v") != 0).select(
        "chunk_id", "cell", F.round(F.col("v").cast("double"), 6).alias("v")
    )


@query(
    "embed_semantic",
    f"""SELECT doc_id AS chunk_id, has_vector, CASE WHEN has_vector THEN 32 END AS dims, CASE WHEN has_vector THEN true END AS is_unit
    FROM (SELECT doc_id, len(list_filter({sqltext.words('text')}, lambda w: w NOT IN ({sqltext._STOP}))) > 0 AS has_vector FROM documents)""",
)
def _(spark, sf):
    """What is certain of vectors learned from the corpus; tests compare their space with a plain decomposition."""
    chunks = t.chunks(spark, sf).select("chunk_id", "content")
    model = semantic.fit_semantic(chunks, "content", dim=32, cells=4096, rounds=2)
    vectors = embed.embed_batch(chunks, "content", encoder=model.encoder(), expected_dim=model.dim)
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x)
    held = F.col("embedding").isNotNull()
    return vectors.select(
        "chunk_id", held.alias("has_vector"), F.when(held, F.size("embedding")).alias("dims"),
        F.when(held, F.abs(squares - 1) < 1e-5).alias("is_unit"))


@query(
    "index_health",
    "SELECT 'doc' AS source_type, count(*) AS chunks, count(*) FILTER (WHERE chunk_id NOT IN (SELECT "
    f"chunk_id FROM ({sqltext.postings('heading', 'content', 'chunk_id', 'chunks')}))) AS missing FROM chunks",
    "chunks",
)
def _(spark, sf):
    chunks = embed.embed_batch(t.chunks(spark, sf), "content")
    return index.index_health(chunks, index.term_index(t.chunks(spark, sf)))
