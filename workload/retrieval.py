"""Vector, keyword and fused retrieval of documents for benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.constants import PASSAGE_PREFIX, QUERY_PREFIX
from lamina.operators import compressed, embed, fulltext, fusion, leakage, relational, search
from lamina.plans import retrieval
from workload import sqltext
from workload import tables as t
from workload.registry import query


def _vectors(spark, sf):
    return t.spread_table(spark, sf, "embeddings")


def _queries(spark, sf):
    return embed.embed_batch(t.search_queries(spark, sf), "text", "vector", prefix=QUERY_PREFIX)


def _dense(spark, sf, k: int = 20, chunks=None):
    chunks = t.chunks(spark, sf) if chunks is None else chunks
    corpus = embed.embed_batch(
        chunks.select("chunk_id", "content"), "content", prefix=PASSAGE_PREFIX
    )
    return search.knn_exact(_queries(spark, sf), corpus, k)


def _keyword(spark, sf, k: int = 20, chunks=None):
    chunks = t.chunks(spark, sf) if chunks is None else chunks
    clauses = fulltext.parse_questions(t.search_queries(spark, sf), syntax=False)
    blocks = fulltext.block_index(chunks, only=fulltext.asked_terms(clauses))
    return fulltext.search_blocks(blocks, clauses, k)


def _hits(spark, sf, k: int = 5):
    chunks = t.chunks(spark, sf)
    dense, keyword = _dense(spark, sf, chunks=chunks), _keyword(spark, sf, chunks=chunks)
    return search.hybrid_search(
        dense, keyword, chunks.drop("heading", "metadata"), k,
        query_count=t.search_queries(spark, sf).count(),
    )


_KNN = sqltext.top(
    "SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity("
    "a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b",
    5,
)


def _ranks(df, *names: str):
    """Ranks as BIGINT, the type the oracle's window gives."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("knn_exact", f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({_KNN})")
def _(spark, sf):
    vectors = _vectors(spark, sf)
    found = search.knn_exact(
        vectors, vectors, 5, query_id="vec_id", query_vector="embedding", chunk_id="vec_id"
    )
    return _ranks(found, "rank").withColumn("score", F.round("score", 6))


@query("knn_exact_blocks", f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({_KNN})")
def _(spark, sf):
    # The plan for sides too large to broadcast, cut into blocks of 128 rows.
    vectors = _vectors(spark, sf)
    found = search.knn_exact(
        vectors, vectors, 5, query_id="vec_id", query_vector="embedding", chunk_id="vec_id",
        broadcast_rows=0, block_rows=128,
    )
    return _ranks(found, "rank").withColumn("score", F.round("score", 6))


_CERTAIN = "SELECT vec_id AS query_id, CAST(5 AS BIGINT) AS found, true AS exact_scores, true AS recall_reached FROM embeddings"
_BY_VECTOR = {"query_id": "vec_id", "query_vector": "embedding", "chunk_id": "vec_id"}


def _certain(vectors, found):
    """What is certain of an approximate search: five rows a query, scores that are the cosines, and
    at least nine tenths of the true neighbours over all queries."""
    truth = search.knn_exact(vectors, vectors, 5, **_BY_VECTOR)
    recall = search.recall_at(found, truth)

    def side(name: str):
        return vectors.select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias(f"{name}_v"))

    both = found.join(side("query_id"), "query_id").join(side("chunk_id"), "chunk_id")

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    q, c = "query_id_v", "chunk_id_v"
    cosine = dot(q, c) / F.sqrt(dot(q, q) * dot(c, c))
    checked = both.groupBy("query_id").agg(
        F.count("*").alias("found"), F.bool_and(F.abs(cosine - F.col("score")) < 1e-8).alias("exact_scores")
    )
    return checked.join(F.broadcast(recall)).select(
        "query_id", "found", "exact_scores", (F.col("recall") >= 0.9).alias("recall_reached")
    )


@query("knn_approx", _CERTAIN)
def _(spark, sf):
    # The given vectors have no clusters, so most lists are visited.
    vectors = _vectors(spark, sf)
    return _certain(vectors, search.knn_approx(vectors, vectors, 5, probe_share=0.7, **_BY_VECTOR))


@query("knn_compressed", _CERTAIN)
def _(spark, sf):
    vectors = _vectors(spark, sf)
    return _certain(vectors, compressed.knn_compressed(vectors, vectors, 5, probe_share=0.7, keep=100, **_BY_VECTOR))


@query(
    "filter_metadata_knn",
    "SELECT query_id, chunk_id, rank FROM (" + sqltext.top(
        "SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity("
        "a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b "
        "WHERE b.label = 3", 5) + ")",
)
def _(spark, sf):
    vectors = _vectors(spark, sf)
    labelled = vectors.withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    corpus = relational.filter_metadata(labelled, {"label": 3})
    found = search.knn_exact(
        vectors, corpus, 5, query_id="vec_id", query_vector="embedding", chunk_id="vec_id"
    )
    return _ranks(found, "rank").drop("score")


@query(
    "window_topk_per_query",
    sqltext.branches() + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense",
)
def _(spark, sf):
    return _ranks(_dense(spark, sf), "rank").withColumn("score", F.round("score", 6))


@query("keyword_topk", sqltext.branches() + "SELECT query_id, chunk_id, rank, score FROM keyword")
def _(spark, sf):
    return _ranks(_keyword(spark, sf), "rank")


def _websearch() -> str:
    """Questions with phrases and negation against all documents; covers are listed one by one."""
    # kind of question, clause, negated, place in the clause, number of the word in the passage
    shape = ("(0, 0, false, 0, 1), (0, 0, false, 1, 2), (0, 1, false, 0, 5), (0, 2, false, 0, 7), (1, 0, false, 0, 1), (1, 0, false, 1, 2), "
             "(1, 0, false, 2, 3), (2, 0, false, 0, 2), (2, 0, false, 1, 3), (2, 1, true, 0, 5), (3, 0, false, 0, 1), (3, 1, false, 0, 4), "
             "(3, 2, true, 0, 2), (3, 2, true, 1, 3)")
    return f"""WITH RECURSIVE entries AS ({sqltext.entries("source || ' ' || lang", "text", "doc_id", "documents")}),
    asked AS (
      SELECT item_id AS query_id, clause, negated, at_, w[nth] AS word FROM (SELECT item_id, {sqltext.words('text')} AS w FROM benchmark),
        (VALUES {shape}) AS v(kind, clause, negated, at_, nth)
      WHERE item_id % 4 = kind AND nth <= len(w) AND w[nth] NOT IN ({sqltext._STOP})),
    known AS ({sqltext.stemmed('SELECT DISTINCT word FROM asked')}),
    listed AS (
      SELECT query_id, clause, negated, list(stem ORDER BY at_) AS terms, list(at_ - low ORDER BY at_) AS offs
      FROM (SELECT *, min(at_) OVER (PARTITION BY query_id, clause) AS low FROM asked JOIN known USING (word)) GROUP BY 1, 2, 3),
    clauses AS (SELECT query_id, min(clause) AS clause, negated, terms, offs FROM listed GROUP BY ALL),
    parts AS (SELECT query_id, clause, negated, len(terms) AS n, list_max(offs) AS reach, unnest(terms) AS term, unnest(offs) AS off FROM clauses),
    here AS (SELECT * FROM (SELECT DISTINCT query_id, term FROM parts) JOIN entries USING (term)),
    found AS (
      SELECT query_id, clause, negated, n, chunk_id, pos - off AS b, pos - off + reach AS e FROM parts JOIN entries USING (term)
      GROUP BY ALL HAVING count(*) = n),
    matched AS (
      SELECT query_id, chunk_id FROM found WHERE NOT negated
      UNION
      SELECT c.query_id, d.doc_id FROM clauses AS c, documents AS d WHERE negated AND NOT EXISTS (
        FROM found AS f WHERE f.query_id = c.query_id AND f.clause = c.clause AND f.chunk_id = d.doc_id)),
    single AS (
      SELECT *, EXISTS (FROM clauses AS c WHERE c.query_id = h.query_id AND CASE WHEN len(c.terms) > 1 THEN negated ELSE negated <> (c.terms[1] = h.term) END) AS holds,
        lead(pos) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS following FROM here AS h),
    coming AS (
      SELECT s.query_id, s.chunk_id, pos, first([b, e] ORDER BY e, b DESC) AS w FROM single AS s JOIN found AS f
        ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id AND b >= pos AND NOT negated WHERE NOT holds GROUP BY 1, 2, 3),
    steps AS (
      SELECT query_id, chunk_id, pos, pos AS b, pos AS e, following FROM single WHERE holds
      UNION ALL
      SELECT c.query_id, c.chunk_id, c.pos, s.pos, w[2], s.following FROM coming AS c JOIN single AS l
        ON l.query_id = c.query_id AND l.chunk_id = c.chunk_id AND l.pos = w[2] JOIN single AS s
        ON s.query_id = c.query_id AND s.chunk_id = c.chunk_id AND s.pos = CASE WHEN l.holds THEN w[2] ELSE w[1] END),
    walk AS (
      SELECT query_id, chunk_id, min(pos) AS pos FROM here GROUP BY 1, 2
      UNION ALL
      SELECT query_id, chunk_id, following FROM walk JOIN steps USING (query_id, chunk_id, pos) WHERE following IS NOT NULL),
    covers AS (SELECT query_id, chunk_id, b, e FROM walk JOIN steps USING (query_id, chunk_id, pos)),
    ranked AS (
      SELECT query_id, chunk_id, b, e, count(*) AS n, sum(1 / CASE WHEN weight = 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) AS inverse
      FROM covers JOIN here USING (query_id, chunk_id) WHERE pos BETWEEN b AND e GROUP BY ALL),
    scored AS (SELECT query_id, chunk_id, sum(n / inverse / (1 + (e - b) - (n - 1))) AS score FROM ranked GROUP BY ALL)
    SELECT * FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT query_id, chunk_id, round(coalesce(score, 0), 6) AS score FROM matched LEFT JOIN scored USING (query_id, chunk_id)))
    WHERE rank <= 20"""


@query("websearch_topk", _websearch())
def _(spark, sf):
    def word(n: int):
        return F.coalesce(F.get("w", F.lit(n - 1)), F.lit(""))

    def phrase(*numbers: int):
        return F.concat(F.lit('"'), F.concat_ws(" ", *map(word, numbers)), F.lit('"'))

    kind = F.col("query_id") % 4
    text = (
        F.when(kind == 0, F.concat_ws(" ", phrase(1, 2), word(5), word(7))).when(kind == 1, phrase(1, 2, 3))
        .when(kind == 2, F.concat(phrase(2, 3), F.lit(" -"), word(5)))
        .otherwise(F.concat(word(1), F.lit(" or "), word(4), F.lit(" -"), phrase(2, 3)))
    )
    passages = t.search_queries(spark, sf).withColumn("w", fulltext.words_of(F.col("text")))
    clauses = fulltext.parse_questions(passages.select("query_id", text.alias("text")))
    blocks = fulltext.block_index(t.chunks(spark, sf), only=fulltext.asked_terms(clauses))
    return _ranks(fulltext.search_blocks(blocks, clauses, 20), "rank")


@query(
    "window_rank_position",
    sqltext.branches() + "SELECT query_id, chunk_id, dense_rank, keyword_rank FROM fused",
)
def _(spark, sf):
    scores = fusion.rrf_scores([_dense(spark, sf), _keyword(spark, sf)])
    return _ranks(
        scores.select(
            "query_id", "chunk_id", F.col("rank_0").alias("dense_rank"),
            F.col("rank_1").alias("keyword_rank"),
        ),
        "dense_rank", "keyword_rank",
    )


@query(
    "rrf_fuse",
    sqltext.branches() + "SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM fused",
)
def _(spark, sf):
    fused = fusion.rrf_fuse([_dense(spark, sf), _keyword(spark, sf)])
    return _ranks(fused, "rank").select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@query(
    "hybrid_search",
    sqltext.branches() + "SELECT query_id, chunk_id, rank, round(score, 9) AS score, dense_rank, "
    "keyword_rank, source_id, section, content FROM fused JOIN chunks USING (chunk_id) WHERE rank <= 5",
)
def _(spark, sf):
    hits = _ranks(_hits(spark, sf), "rank", "dense_rank", "keyword_rank")
    return hits.select(
        "query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "dense_rank",
        "keyword_rank", "source_id", "section", "content",
    )


@query(
    "join_id_lookup",
    sqltext.branches(5) + "SELECT query_id, rank, chunk_id, source_id, title, content FROM dense "
    "JOIN chunks USING (chunk_id)",
)
def _(spark, sf):
    chunks = t.chunks(spark, sf).select("chunk_id", "source_id", "title", "content")
    bound = 5 * t.search_queries(spark, sf).count()
    return _ranks(search.id_lookup(_dense(spark, sf, 5), chunks, bound), "rank").drop("score")


def _overlap() -> str:
    wanted, passage = (f"list_distinct({sqltext.words(c)})" for c in ("b.text", "c.content"))
    return f"len(list_intersect({wanted}, {passage})) / CAST(len({wanted}) AS DOUBLE)"


@query(
    "rerank",
    sqltext.branches() + "SELECT query_id, chunk_id, round(score, 6) AS score, fused_rank, rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM "
    f"(SELECT query_id, chunk_id, rank AS fused_rank, {_overlap()} AS score FROM fused JOIN chunks c "
    "USING (chunk_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20)) WHERE rank <= 5",
)
def _(spark, sf):
    pool = _hits(spark, sf, 20).join(t.search_queries(spark, sf), "query_id")
    ranked = _ranks(search.rerank(pool, 5), "rank", "fused_rank")
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "fused_rank", "rank")


_FRENCH = "lang = 'fr' AND source <> 'src1'"


def _stored(spark, sf):
    """The chunk table with vectors, as an index holds it."""
    chunks = t.chunks(spark, sf).where(F.col("title") != "src1")
    return embed.embed_batch(chunks, "content", prefix=PASSAGE_PREFIX)


@query(
    "retrieve_filtered",
    sqltext.branches(20, _FRENCH) + "SELECT query_id, chunk_id, rank, round(score, 9) AS score, dense_rank, "
    "keyword_rank, source_id FROM fused JOIN chunks USING (chunk_id) WHERE rank <= 5",
)
def _(spark, sf):
    hits = retrieval.retrieve(t.search_queries(spark, sf), _stored(spark, sf), "doc", filters={"lang": "fr"})
    return _ranks(hits, "rank", "dense_rank", "keyword_rank").select(
        "query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "dense_rank", "keyword_rank", "source_id")


@query(
    "retrieve_reranked",
    sqltext.branches(20, _FRENCH) + "SELECT query_id, chunk_id, round(score, 6) AS score, fused_rank, rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM "
    "(SELECT query_id, chunk_id, dense_rank AS fused_rank, len(list_intersect(list_distinct("
    f"{sqltext.words('b.text')}), list_distinct({sqltext.words('c.content')}))) / CAST(len(list_distinct({sqltext.words('b.text')})) AS DOUBLE) "
    "AS score FROM (SELECT query_id, chunk_id, rank AS dense_rank FROM dense) JOIN chunks c USING (chunk_id) "
    "JOIN benchmark b ON b.item_id = query_id)) WHERE rank <= 5",
)
def _(spark, sf):
    hits = retrieval.retrieve(
        t.search_queries(spark, sf), _stored(spark, sf), "doc", filters={"lang": "fr"}, mode="dense", rerank=True)
    return _ranks(hits, "rank", "fused_rank").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "fused_rank", "rank")


@query(
    "filter_path",
    sqltext.branches() + "SELECT query_id, rank, chunk_id, title AS source_id FROM fused JOIN chunks "
    "USING (chunk_id) WHERE rank <= 5 AND title = 'src3'",
)
def _(spark, sf):
    # The source plays the file that several chunks come from.
    hits = _hits(spark, sf).withColumn("source_id", F.col("title"))
    kept = search.filter_path(hits, "src3")
    return _ranks(kept, "rank").select("query_id", "rank", "chunk_id", "source_id")


@query(
    "citation",
    "SELECT chunk_id, '[' || source_id || ' §' || lang || ']' AS citation FROM chunks UNION ALL "
    "SELECT p_partkey, 'p' || p_partkey || '.py:L' || p_size || '-L' || (p_size + 3) FROM part",
    "chunks",
)
def _(spark, sf):
    code = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("chunk_id"), F.lit("code").alias("source_type"),
        F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("source_id"),
        F.col("p_name").alias("section"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + 3).alias("end_line"),
    )
    both = t.chunks(spark, sf).select(*code.columns).unionByName(code)
    return search.with_citation(both).select("chunk_id", "citation")


@query(
    "evidence_context",
    sqltext.branches() + "SELECT item_id AS query_id, coalesce(context, '(no document matched)') AS "
    "context FROM benchmark LEFT JOIN (SELECT query_id, string_agg('--- SOURCE [' || source_id || ' §' || "
    "split_part(section, ' > ', 2) || '] (titre: ' || title || ') ---' || chr(10) || "
    "content, chr(10) || chr(10) ORDER BY rank) AS context FROM fused JOIN chunks USING "
    "(chunk_id) WHERE rank <= 5 GROUP BY 1) ON query_id = item_id",
)
def _(spark, sf):
    return search.evidence_context(
        t.search_queries(spark, sf), search.with_citation(_hits(spark, sf))
    )


def _nearest(k: int) -> str:
    return (
        f"WITH qcells AS ({sqltext.cells('doc_id', 'text', 'query: ', 'documents')}), ccells AS "
        f"({sqltext.cells('item_id', 'text', 'query: ', 'benchmark')}) SELECT * FROM "
        f"({sqltext.top(sqltext.similarities('qcells', 'ccells'), k)})"
    )


def _questions_and_examples(spark, sf):
    documents = t.spread_table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    questions = embed.embed_batch(documents, "text", "vector", prefix=QUERY_PREFIX)
    examples = _queries(spark, sf).select(F.col("query_id").alias("chunk_id"), F.col("vector").alias("embedding"))
    return questions, examples


@query(
    "fewshot_nearest",
    f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({_nearest(4)})",
)
def _(spark, sf):
    found = search.fewshot_nearest(*_questions_and_examples(spark, sf), k=4)
    return _ranks(found, "rank").withColumn("score", F.round("score", 6))


@query(
    "join_cross_similarity",
    f"SELECT query_id, chunk_id, round(score, 6) AS score FROM ({_nearest(1)})",
)
def _(spark, sf):
    best = leakage.best_similarity(*_questions_and_examples(spark, sf))
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "leakage_embedding",
    "SELECT query_id AS question_id, chunk_id AS example_id, round(score, 6) AS similarity FROM "
    f"({_nearest(1)}) WHERE score > 0.6",
)
def _(spark, sf):
    found = leakage.leakage_embedding(*_questions_and_examples(spark, sf), limit=0.6)
    return found.withColumn("similarity", F.round("similarity", 6))
