import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.operators import embed, fulltext, fusion, search
from lamina.session import ARROW_BATCH_LIMIT, bound_batches
from tests.conftest import rows


def branch(spark, *rankings):
    data = [(q, c, r) for q, ranking in enumerate(rankings) for r, c in enumerate(ranking, 1)]
    return spark.createDataFrame(data, "query_id int, chunk_id string, rank int")


def loop_fusion(rankings, k):
    scores, seen = {}, []
    for ranking in rankings:
        for rank, item in enumerate(ranking, 1):
            scores[item] = scores.get(item, 0.0) + 1 / (k + rank)
            if item not in seen:
                seen.append(item)
    return sorted(scores, key=lambda i: (-round(scores[i], 12), seen.index(i))), scores


@pytest.mark.parametrize("k", [1, 60])
def test_fusion_equals_a_plain_loop(spark, k):
    rng = np.random.default_rng(3)
    cases = [([["x", "s"], ["y", "s"]]), ([["a", "b"], ["b", "a"]]), ([["a"], ["b"]]), ([[], ["b"]])]
    for _ in range(40):
        cases.append([list(rng.permutation(list("abcdefgh"))[: rng.integers(0, 8)]) for _ in range(2)])
    fused = fusion.rrf_fuse([branch(spark, *[c[b] for c in cases]) for b in (0, 1)], k=k)
    found = {q: list(g.sort_values("rank")["chunk_id"]) for q, g in fused.toPandas().groupby("query_id")}
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in fused.collect()}
    for q, case in enumerate(cases):
        order, expected = loop_fusion(case, k)
        assert found.get(q, []) == order
        assert all(scores[q, item] == pytest.approx(s) for item, s in expected.items())


@pytest.fixture(scope="module")
def vectors(spark):
    """300 vectors in 12 clusters; a third of them are copies of one vector."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(0, 12, 300)] + 0.2 * rng.normal(size=(300, 16))
    points[:100] = points[0]
    data = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame([*data, (999, None)], "chunk_id int, embedding array<float>").repartition(5)
    matrix = np.array([p for _, p in data])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return df, np.round(unit @ unit.T, 9)


PLANS = {
    "small corpus": {},
    "few queries": {"broadcast_rows": 5},
    "blocks": {"broadcast_rows": 0, "block_rows": 40},
}


@pytest.mark.parametrize("plan", PLANS)
def test_every_exact_plan_equals_brute_force(vectors, plan, monkeypatch):
    df, similar = vectors
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    if plan == "few queries":
        queries = queries.filter("query_id IN (0, 5, 150, 299)")
    found = search.knn_exact(queries, df, 4, **PLANS[plan]).toPandas()
    wanted = sorted(found["query_id"].unique())
    assert len(wanted) == (4 if plan == "few queries" else 300)
    for q, group in found.groupby("query_id"):
        best = sorted(range(300), key=lambda c: (-similar[q, c], c))[:4]
        assert list(group.sort_values("rank")["chunk_id"]) == best


def test_blocks_are_scored_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    queries, chunks = rng.normal(size=(37, 8)), rng.normal(size=(50, 8))
    whole = search._best(np.arange(37), queries, np.arange(50), chunks, 3)
    monkeypatch.setattr(search, "SCORE_CELLS", 120)
    assert search._best(np.arange(37), queries, np.arange(50), chunks, 3).equals(whole)


def test_approximate_search_finds_most_neighbours(vectors):
    df, _ = vectors
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = search.knn_exact(queries, df, 4)
    found = search.knn_approx(queries, df, 4, lists=8, probe_share=3 / 8, block_rows=40)
    assert found.groupBy("query_id").count().filter("count > 4").count() == 0
    assert search.recall_at(found, exact).first()[0] > 0.9


def test_search_of_nothing(spark, vectors):
    df, _ = vectors
    none = df.filter("chunk_id < 0")
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert search.knn_exact(queries, none, 3).count() == 0
    assert search.knn_exact(queries.limit(0), df, 3, broadcast_rows=5).count() == 0


def test_embedding_is_a_unit_vector_with_prefix(spark):
    df = spark.createDataFrame([(0, "tôle K_Scratch tôle"), (1, ""), (2, None)], "id int, text string")
    found = {r["id"]: r["v"] for r in embed.embed_batch(df, "text", "v", prefix="").collect()}
    assert np.linalg.norm(found[0]) == pytest.approx(1.0) and found[1] is None and found[2] is None
    other = embed.embed_batch(df, "text", "v").filter("id = 0").first()["v"]
    assert other != found[0]


def test_encoder_width_is_checked(spark):
    def narrow():
        return lambda texts: np.ones((len(texts), 3))

    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="3 dimensions"):
        embed.embed_batch(df, "text", encoder=narrow).collect()
    assert embed.embed_batch(df, "text", encoder=narrow, expected_dim=3).first()["embedding"] == pytest.approx([3**-0.5] * 3)


def test_keyword_search_weighs_headings(spark):
    postings = spark.createDataFrame(
        [(1, "actions", "A", 1), (2, "actions", "B", 2), (3, "other", "B", 9), (1, "rayure", "B", 1)],
        "chunk_id int, term string, weight string, tf bigint",
    )
    queries = spark.createDataFrame([(0, "Actions: rayure, actions ?"), (1, "absent")], "query_id int, text string")
    wanted = search.query_terms(queries, stem=False)
    assert rows(search.keyword_topk(postings, wanted), "query_id", "chunk_id", "rank", "score") == [
        (0, 1, 1, 1.4), (0, 2, 2, 0.8),
    ]


def test_hybrid_modes_and_rerank(spark):
    dense, keyword = branch(spark, ["a", "b", "c"]), branch(spark, ["d", "b", "e"])
    chunks = spark.createDataFrame([(c, f"text {c}", f"s{c}") for c in "abcde"], "chunk_id string, content string, source_id string")
    hits = search.hybrid_search(dense, keyword, chunks, 3)
    assert rows(hits, "rank", "chunk_id", "dense_rank", "keyword_rank", "content") == [
        (1, "b", 2, 2, "text b"), (2, "a", 1, None, "text a"), (3, "d", None, 1, "text d"),
    ]
    alone = search.hybrid_search(dense, None, chunks, 2)
    assert rows(alone, "rank", "chunk_id", "keyword_rank") == [(1, "a", None), (2, "b", None)]
    pool = hits.withColumn("text", F.lit("d"))
    assert rows(search.rerank(pool, 2), "rank", "chunk_id") == [(1, "d"), (2, "b")]

    @F.pandas_udf("double")
    def longest(query: pd.Series, passage: pd.Series) -> pd.Series:
        return passage.str.contains("a$").astype(float)

    scored = search.rerank(pool, 3, longest("text", "content"))
    assert rows(scored, "rank", "chunk_id") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(search.filter_path(hits, "sa"), "chunk_id") == [("a",)]


def test_evidence_context(spark):
    hits = spark.createDataFrame(
        [(0, 2, "doc", "D", "T > A", None, None, "x" * 1300, "Titre"), (0, 1, "code", "q.sql", "one", 3, 5, "SELECT 1", None)],
        "query_id int, rank int, source_type string, source_id string, section string, start_line int, end_line int, "
        "content string, title string",
    )
    queries = spark.createDataFrame([(0,), (1,)], "query_id int")
    # Whole passages, unless a cut is asked for.
    for options, size in (({}, 1300), ({"max_chars": 1200}, 1200)):
        found = dict(rows(search.evidence_context(queries, search.with_citation(hits), **options)))
        assert found[0] == (
            "--- SOURCE q.sql:L3-L5 (one) ---\n```sql\nSELECT 1\n```\n\n"
            "--- SOURCE [D §A] (titre: Titre) ---\n" + "x" * size
        )
        assert found[1] == "(no document matched)"


def test_what_blocks_move_grows_with_rows_and_not_with_pairs(spark, vectors, monkeypatch):
    df, similar = vectors
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    side = search._side(queries, "query_id", "vector", "query_id").coalesce(1)
    blocks = search.packed(side, "q", 64 * 16)
    assert blocks.count() == 19 and blocks.agg(F.sum(F.length("q_vectors"))).first()[0] == 300 * 64
    # Blocks of sixteen vectors, scored one query at a time; ids are texts and one is missing.
    monkeypatch.setattr(search, "BLOCK_BYTES", 64 * 16)
    monkeypatch.setattr(search, "SIDE_BYTES", 64 * 40)
    named = df.select(F.when(F.col("chunk_id") != 299, F.format_string("c%03d", "chunk_id")).alias("chunk_id"), "embedding")
    found = search.knn_exact(queries, named, 4, broadcast_rows=0, block_rows=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroups" not in plan
    for q, group in found.toPandas().groupby("query_id"):
        best = sorted(range(300), key=lambda c: (-similar[q, c], c))[:4]
        assert list(group.sort_values("rank")["chunk_id"].fillna("c299")) == [f"c{c:03d}" for c in best]


def test_a_vector_that_is_no_number_hides_no_other(spark):
    rows_ = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows_, "chunk_id int, embedding array<double>")
    asked = df.where("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert rows(search.knn_exact(asked, df, 2), "chunk_id", "rank") == [(0, 1), (2, 2)]


def test_texts_are_taken_in_bounded_slices():
    import pyarrow as pa

    from lamina.operators.slices import text_slices

    texts = pa.array(["ab", None, "é" * 5, "x" * 30, "", "y"])
    assert list(text_slices(texts, 12)) == [(0, 3), (3, 4), (4, 6)]
    assert list(text_slices(texts, 100, 2)) == [(0, 2), (2, 4), (4, 6)]
    assert list(text_slices(texts[:0])) == []


def test_an_encoder_sees_bounded_slices(spark):
    def most():
        return lambda texts: np.array([[float(len(texts))]] * len(texts)) * (1 if len(texts) <= 1024 else np.nan)

    df = spark.range(5000).coalesce(1).withColumn("text", F.lit("word"))
    found = embed.embed_batch(df, "text", "v", encoder=most, expected_dim=1)
    assert rows(found.groupBy("v").count()) == [([1.0], 5000)]


@pytest.fixture
def no_limit_named(spark):
    before = spark.conf.get(ARROW_BATCH_LIMIT)
    spark.conf.unset(ARROW_BATCH_LIMIT)
    yield
    spark.conf.set(ARROW_BATCH_LIMIT, before)


def small_batches_only(df):
    """The same rows; a batch well above 8 MB fails the job."""
    def check(batches):
        for batch in batches:
            if batch.nbytes > 12 << 20:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            yield batch

    return df.mapInArrow(check, df.schema)


def test_pairs_of_blocks_reach_a_worker_in_small_batches(spark, no_limit_named, monkeypatch):
    component = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.hash("chunk_id", i) % 1000).cast("float"))
    corpus = spark.range(80_000, numPartitions=2).select(F.col("id").alias("chunk_id")).withColumn("embedding", component)
    asked = corpus.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    plain = search.paired
    monkeypatch.setattr(search, "paired", lambda left, right: small_batches_only(plain(left, right)))
    found = search.knn_exact(asked, corpus, 1, broadcast_rows=0)
    assert rows(found, "query_id", "chunk_id") == sorted(((n, n) for n in range(20)), key=repr)


def test_a_named_limit_of_batches_is_kept(spark, no_limit_named):
    spark.conf.set(ARROW_BATCH_LIMIT, "33m")
    bound_batches(spark)
    assert spark.conf.get(ARROW_BATCH_LIMIT) == "33m"
    spark.conf.unset(ARROW_BATCH_LIMIT)
    bound_batches(spark)
    assert spark.conf.get(ARROW_BATCH_LIMIT) == "8m"


def test_texts_reach_the_index_in_small_batches(spark, no_limit_named):
    text = F.concat(F.lit("laminoir "), F.repeat(F.lit("x"), 20_000))
    chunks = spark.range(2_000, numPartitions=1).select(F.col("id").alias("chunk_id"), F.lit("titre").alias("heading"), text.alias("content"))
    asked = fulltext.parse_questions(spark.createDataFrame([(0, "laminoir")], "query_id int, text string"), analysis=fulltext.SIMPLE)
    blocks = fulltext.block_index(small_batches_only(chunks), analysis=fulltext.SIMPLE)
    assert rows(fulltext.search_blocks(blocks, asked, 2), "chunk_id", "rank") == [(0, 1), (1, 2)]
