"""Top-k retrieval for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.constants import CANDIDATES_PER_BRANCH, RRF_K, TOP_K
from lamina.functions.text import citation
from lamina.operators import fulltext
from lamina.operators.fusion import rrf_fuse
from lamina.operators.index import terms, weight_value
from lamina.operators.relational import top_per_group
from lamina.session import bound_batches, durable

# A side is held whole in every worker only up to this many vectors and bytes as doubles.
BROADCAST_ROWS = 8_192
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 16_384
# Bytes of vectors that travel as one row, and of those that a task holds of one side.
BLOCK_BYTES, SIDE_BYTES = 1 << 20, 64 << 20
# Scores held at once by a task, 8 MB, and pairs of vectors scored exactly at once.
SCORE_CELLS, PAIR_ROWS = 2_000_000, 16_384
# Vectors of an Arrow batch that are taken at once.
SLICE_ROWS = 2_048
# A ranked list holds a few numbers per row: this many rows are a few megabytes.
LOOKUP_BROADCAST_ROWS = 200_000
# Similarities are compared after rounding, so that copies of a vector tie on every machine.
_DIGITS = 9


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def flat_rows(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of their own type; a null component is NaN."""
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors have from {min(widths)} to {max(widths)} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), widths[0] if widths else 0)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids that sort; those with nulls or of other types than numbers as objects."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return np.array([*column.to_pylist(), None], object)[:-1]
    return column.to_numpy(zero_copy_only=False)


class Nearest:
    """The ``k`` best chunks of every row of a block of queries, as blocks of chunks pass by.

    Products in single precision find what may be among the best, with more room than their error needs; that little
    is scored in double precision. Queries are taken in slices, so that a score matrix never exceeds ``SCORE_CELLS``.
    """

    def __init__(self, queries: np.ndarray, k: int, block_rows: int = BLOCK_ROWS):
        self.unit, self.k, self.block_rows = _unit(queries.astype(np.float64)), k, block_rows
        self.small = self.unit.astype(np.float32)
        self.margin = (self.unit.shape[1] + 8) * 2.0**-22
        self.floor = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, ids: np.ndarray, chunks: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Chunks as unit rows, for all queries or those numbered ``rows``. What is no number is near nothing."""
        if not np.isfinite(chunks).all():
            usable = np.isfinite(chunks).all(axis=1)
            ids, chunks = ids[usable], chunks[usable]
        rows = np.arange(len(self.unit)) if rows is None else rows
        if not len(chunks) or not len(rows):
            return
        small = chunks.astype(np.float32).T
        step = max(1, min(self.block_rows, SCORE_CELLS // len(chunks)))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            near = self.small[some] @ small
            floor = self.floor[some]
            new = np.flatnonzero(np.isneginf(floor))
            if len(new) and len(chunks) > self.k:
                floor[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k] - self.margin
                self.floor[some] = floor
            row, column = np.nonzero(near >= (floor - self.margin)[:, None].astype(np.float32))
            for begin in range(0, len(row), PAIR_ROWS):
                r, c = some[row[begin:begin + PAIR_ROWS]], column[begin:begin + PAIR_ROWS]
                self.add(r, ids[c], np.round(np.einsum("ij,ij->i", self.unit[r], chunks[c]), _DIGITS))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = scores >= self.floor[rows]
        self.held.append((rows[kept], ids[kept], scores[kept]))
        self.waiting += int(kept.sum())
        if self.waiting > PAIR_ROWS + 2 * self.k * len(self.unit):
            self._prune()

    def _prune(self) -> None:
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if ids.dtype == object:
            frame = pd.DataFrame({"row": rows, "score": scores, "id": ids})
            order = frame.sort_values(["row", "score", "id"], ascending=[True, False, True]).index.to_numpy()
        else:
            order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.floor[rows[last]] = scores[last]
        self.held, self.waiting = [(rows[place < self.k], ids[place < self.k], scores[place < self.k])], 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, id, score)`` by row, best first, ties by id."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self._prune()
        return self.held[0]


def _best(
    query_ids: np.ndarray, queries: np.ndarray, chunk_ids: np.ndarray, chunks: np.ndarray, k: int
) -> pd.DataFrame:
    """Top ``k`` chunks of every query within one block, ties by chunk id."""
    found = Nearest(queries, k)
    found.offer(chunk_ids, _unit(chunks))
    rows, ids, scores = found.best()
    return pd.DataFrame({"query_id": query_ids[rows], "chunk_id": ids, "score": scores})


def _side(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    single = df.schema[vector].dataType == T.ArrayType(T.FloatType())
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    return df.select(F.col(key).alias(name), v.alias("vector")).filter("vector IS NOT NULL")


def _fits(df: DataFrame, vector: str, rows: int) -> bool:
    """Whether a side has at most ``rows`` vectors and few enough bytes; reads no more than that."""
    count, longest = df.select(F.size(vector).alias("_d")).limit(rows + 1).agg(
        F.count("*"), F.coalesce(F.max("_d"), F.lit(0))).first()
    return count <= rows and count * longest * 8 <= BROADCAST_BYTES


def _output(queries: DataFrame, corpus: DataFrame) -> str:
    kind = {name: df.schema[name].dataType.simpleString() for df, name in
            ((queries, "query_id"), (corpus, "chunk_id"))}
    return f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score double"


def found_rows(best: Nearest, query_ids: pa.Array, chunk_type: pa.DataType) -> pa.RecordBatch:
    rows, ids, scores = best.best()
    return pa.RecordBatch.from_arrays(
        [query_ids.take(pa.array(rows, pa.int64())), pa.array(ids, chunk_type), pa.array(scores, pa.float64())],
        ["query_id", "chunk_id", "score"])


def _collected(side: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a side known to be small."""
    local = side.toArrow().combine_chunks().to_batches()
    return (local[0].column(0), flat_rows(local[0].column(1))) if local and local[0].num_rows else (pa.array([]), np.zeros((0, 0)))


def _against_all_chunks(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Small corpus: it is broadcast, every query is answered in place, nothing is shuffled."""
    ids, vectors = _collected(corpus)
    if not len(ids):
        return queries.sparkSession.createDataFrame([], _output(queries, corpus))
    shared = queries.sparkSession.sparkContext.broadcast((ids_of(ids), _unit(vectors.astype(np.float64)), ids.type))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids, chunks, kind = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found = Nearest(flat_rows(batch.column(1)), k)
                found.offer(chunk_ids, chunks)
                yield found_rows(found, batch.column(0), kind)

    return queries.mapInArrow(search, _output(queries, corpus))


def _against_all_queries(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Few queries: they are broadcast and a task forwards its own k best chunks for each."""
    ids, vectors = _collected(queries)
    if not len(ids):
        return queries.sparkSession.createDataFrame([], _output(queries, corpus))
    shared = queries.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = shared.value
        found, kind = Nearest(asked, k), None
        for whole in batches:
            kind = whole.column(0).type
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found.offer(ids_of(batch.column(0)), _unit(flat_rows(batch.column(1)).astype(np.float64)))
        if kind is not None:
            yield found_rows(found, query_ids, kind)

    return corpus.mapInArrow(search, _output(queries, corpus))


def packed(side: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """Rows (key, vector, further columns) as blocks of bounded bytes, one row each: arrays of all columns but the vectors,
    which are one binary of ``width`` numbers a row, and the block's number."""
    kinds = {f.name: f.dataType.simpleString() for f in side.schema if f.name != "vector"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            rows = flat_rows(whole.column("vector"))
            step = max(1, block_bytes // max(1, rows.shape[1] * rows.itemsize))
            for at in range(0, len(rows), step):
                some, number = whole.slice(at, step), number + 1
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(n)) for n in kinds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *lists, pa.array([rows[at:at + step].tobytes()], pa.binary()), pa.array([rows.shape[1]], pa.int32())],
                    [f"{name}_block", *[f"{name}_{n}" for n in kinds], f"{name}_vectors", f"{name}_width"])

    columns = ", ".join(f"{name}_{n} array<{k}>" for n, k in kinds.items())
    return side.mapInArrow(pack, f"{name}_block bigint, {columns}, {name}_vectors binary, {name}_width int")


def unpacked(batch: pa.RecordBatch, row: int, name: str, single: bool) -> np.ndarray:
    """Vectors of a block."""
    found = np.frombuffer(batch.column(f"{name}_vectors")[row].as_buffer(), np.float32 if single else np.float64)
    return found.reshape(-1, max(1, batch.column(f"{name}_width")[row].as_py()))


def is_single(df: DataFrame) -> bool:
    return df.schema["vector"].dataType == T.ArrayType(T.FloatType())


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of the left side next to every block of the right one, without a shuffle.

    Both come from storage: a task reads some blocks of the left side and, for each of them, all
    of its part of the right one, ``SIDE_BYTES`` of it at most. A worker gets the pairs a few at a time: the
    session's limit of Arrow batches is lowered unless it was set.
    """
    bound_batches(left.sparkSession)
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def query_blocks(queries: DataFrame, block_bytes: int) -> DataFrame:
    """Stored blocks of queries in enough parts for all cores."""
    parts = 3 * queries.sparkSession.sparkContext.defaultParallelism
    return durable(packed(queries.repartition(parts), "q", block_bytes))


def _in_blocks(
    queries: DataFrame, corpus: DataFrame, k: int, block_rows: int, centres: Broadcast | None = None, visited: int = 0,
) -> DataFrame:
    """Every block of queries against every block of chunks, each side packed and stored once.

    What is moved grows with the rows of both sides; the products, which do not, stay inside tasks, and a task hands on k rows
    a query. With ``centres``, chunks have a ``cell`` and queries meet those of the ``visited`` nearest cells only.
    """
    left = query_blocks(queries, BLOCK_BYTES)
    if centres is None:
        right = durable(packed(corpus, "c", BLOCK_BYTES))
    else:
        # Chunks of a cell lie side by side; a cell of any size is cut like the rest.
        parts = corpus.sparkSession.sparkContext.defaultParallelism
        right = durable(packed(corpus.repartitionByRange(parts, "cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell"), "c", BLOCK_BYTES))
    held = right.agg(F.coalesce(F.sum(F.length("c_vectors")), F.lit(0))).first()[0]
    right = right.coalesce(max(1, -(-held // SIDE_BYTES)))
    single = is_single(queries), is_single(corpus)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, asked, visits, kind = None, None, None, None, None
        for batch in batches:
            kind = batch.column("c_chunk_id").type.value_type
            for row, block in enumerate(batch.column("q_block").to_pylist()):
                if block != now:
                    if found is not None:
                        yield found_rows(found, asked, kind)
                    now, asked = block, batch.column("q_query_id")[row].values
                    found = Nearest(unpacked(batch, row, "q", single[0]), k, block_rows)
                    if centres is not None:
                        order = np.argsort(-(found.unit @ centres.value.T), axis=1, kind="stable")[:, :visited]
                        visits = np.zeros((len(found.unit), len(centres.value)), bool)
                        np.put_along_axis(visits, order, True, axis=1)
                ids, chunks = ids_of(batch.column("c_chunk_id")[row].values), _unit(unpacked(batch, row, "c", single[1]).astype(np.float64))
                if centres is None:
                    found.offer(ids, chunks)
                    continue
                cells = batch.column("c_cell")[row].values.to_numpy()
                edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
                for a, b in zip(edges, edges[1:]):
                    found.offer(ids[a:b], chunks[a:b], np.flatnonzero(visits[:, cells[a]]))
        if found is not None:
            yield found_rows(found, asked, kind)

    return paired(left, right).mapInArrow(meet, _output(queries, corpus))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def knn_exact(
    queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
    query_vector: str = "vector", chunk_id: str = "chunk_id", chunk_vector: str = "embedding",
    broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest chunks of every query by cosine, as (query_id, chunk_id, rank, score).

    Rows without a vector take no part. Filters on the corpus belong before this call. Of two large sides at
    most ``block_rows`` queries are scored at once; their blocks are cut by bytes.
    """
    q = _side(queries, query_id, query_vector, "query_id")
    c = _side(corpus, chunk_id, chunk_vector, "chunk_id")
    if _fits(corpus, chunk_vector, broadcast_rows):
        found = _against_all_chunks(q, c, k)
    elif _fits(queries, query_vector, broadcast_rows):
        found = _against_all_queries(q, c, k)
    else:
        found = _in_blocks(q, c, k, block_rows)
    return _ranked(found, k)


def knn_approx(
    queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
    query_vector: str = "vector", chunk_id: str = "chunk_id", chunk_vector: str = "embedding",
    lists: int | None = None, probe_share: float = 0.25, sample_rows: int = 20_000,
    block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> DataFrame:
    """Approximate neighbours: spherical k-means lists, of which each query visits a share.

    The work per query shrinks by about ``probe_share`` against ``knn_exact``; inside the visited
    lists the search is exact. There are as many lists as the root of the number of chunks, but no more
    than a sixteenth of the sample. They are fitted on a bounded sample, the ``sample_rows`` chunks with the smallest hashes; every chunk
    is listed. Lists of any size are cut into bounded blocks, and a block of queries meets each once,
    however many lists it visits. Vectors without clusters need a larger share for the same recall.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    q = _side(queries, query_id, query_vector, "query_id")
    c = _side(corpus, chunk_id, chunk_vector, "chunk_id")
    features = c.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    lists = lists or max(2, min(round(c.count() ** 0.5), sample_rows // 16))
    sample = features.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows)
    model = KMeans(
        k=lists, seed=seed, distanceMeasure="cosine", maxIter=10, predictionCol="cell"
    ).fit(sample.select("features"))
    centres = queries.sparkSession.sparkContext.broadcast(_unit(np.array(model.clusterCenters())))  # bounded by the sample
    visited = max(1, round(len(centres.value) * probe_share))

    listed = model.transform(features).select("chunk_id", "vector", "cell")
    return _ranked(_in_blocks(q, listed, k, block_rows, centres, visited), k)


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, over all queries."""
    hit = truth.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left"
    )
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text",
                stop_words: tuple[str, ...] = (), stem: bool = True) -> DataFrame:
    """Distinct terms of every query, cut the same way as the postings."""
    analysis = fulltext.Analysis(tuple(stop_words), stem)
    clauses = fulltext.parse_questions(queries, query_id, text, analysis, syntax=False)
    return clauses.select("query_id", F.explode("terms").alias("term")).distinct()


def keyword_topk(postings: DataFrame, wanted: DataFrame, k: int = CANDIDATES_PER_BRANCH) -> DataFrame:
    """Chunks that share a term with a query, by weighted occurrences.

    Postings of terms nobody asks for go first; the rest, a few bytes each, is dealt by chunk.
    With query terms small enough to broadcast, the sum per (query, chunk) and the cut to ``k``
    run there, and only k rows per query and task are shuffled. Larger query tables are joined
    by term, where adaptive execution splits the postings of a common one.
    """
    asked = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    hits = asked.repartition("chunk_id").join(wanted, "term").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("tf") * weight_value()), 6).alias("score")
    )
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def hybrid_search(
    dense: DataFrame, keyword: DataFrame | None, chunks: DataFrame, k: int = TOP_K,
    rrf_k: int = RRF_K, query_count: int | None = None,
) -> DataFrame:
    """Fuse the ranked branches and fetch the rows of the chunks that remain.

    ``keyword=None`` is the dense-only mode. Chunk text is read after the cut to ``k``;
    ``query_count``, when known, bounds the list of remaining ids.
    """
    branches = [dense] if keyword is None else [dense, keyword]
    fused = rrf_fuse(branches, k, rrf_k).withColumnRenamed("rank_0", "dense_rank")
    if keyword is None:
        fused = fused.withColumn("rank_1", F.lit(None).cast("int"))
    ranked = fused.withColumnRenamed("rank_1", "keyword_rank")
    return id_lookup(ranked, chunks, None if query_count is None else k * query_count)


def id_lookup(ranked: DataFrame, chunks: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Full chunk rows of a ranked id list.

    A list known to hold at most ``row_bound`` rows is broadcast when that is few, so the chunk
    table is only scanned. Without a bound, or with a large one, both sides meet by chunk id.
    """
    if row_bound is not None and row_bound <= LOOKUP_BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    return ranked.join(chunks, "chunk_id")


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the distinct query terms that occur in a passage."""
    def share(wanted: Column) -> Column:
        shared = F.size(F.array_intersect(wanted, terms(passage)))
        return F.when(F.size(wanted) > 0, shared / F.size(wanted).cast("double")).otherwise(0.0)

    # Binding the terms to a lambda cuts the query into words once.
    return F.transform(F.array(F.array_distinct(terms(query))), share)[0]


def rerank(
    hits: DataFrame, k: int = TOP_K, score: Column | None = None, query: str = "text",
    passage: str = "content",
) -> DataFrame:
    """Re-order a pool of hits by a pair score, keeping the fused order among equals.

    ``score`` may be a model's pandas UDF over (query, passage); without one the share of
    query terms in the passage is used.
    """
    pair = overlap_score(F.col(query), F.col(passage)) if score is None else score
    # Pools are few bytes but costly to score: a fixed number of partitions keeps adaptive
    # execution from putting them all into one task.
    partitions = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hits.repartition(partitions, "query_id", "chunk_id")
    scored = spread.withColumn("score", pair).withColumnRenamed("rank", "fused_rank")
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("fused_rank")], k)


def filter_path(hits: DataFrame, path: str) -> DataFrame:
    """Keep hits of one file, after ranking: fewer than k may remain."""
    return hits.filter(F.col("source_id") == path)


def with_citation(hits: DataFrame) -> DataFrame:
    """Add the citation string of every hit."""
    columns = ("source_type", "source_id", "section", "start_line", "end_line")
    return hits.withColumn("citation", citation(*[F.col(c) for c in columns]))


def evidence_context(
    queries: DataFrame, hits: DataFrame, title: str = "title", max_chars: int | None = None
) -> DataFrame:
    """All hits of a query as one labelled text; ``hits`` hold at most k rows per query.

    Passages are whole unless ``max_chars`` cuts them; ``EVIDENCE_MAX_CHARS`` is a usual cut.
    """
    content = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    head = F.concat(F.lit("--- SOURCE "), F.col("citation"))
    doc = F.concat(head, F.lit(" (titre: "), F.col(title), F.lit(") ---\n"), content)
    symbol = F.when(F.length("section") > 0, F.concat(F.lit(" ("), "section", F.lit(")"))).otherwise("")
    language = F.when(F.col("source_id").endswith(".sql"), "sql").otherwise("python")
    code = F.concat(head, symbol, F.lit(" ---\n```"), language, F.lit("\n"), content, F.lit("\n```"))
    block = F.when(F.col("source_type") == "doc", doc).otherwise(code)
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context")
    )
    missing = F.coalesce("context", F.lit("(no document matched)"))
    return queries.select("query_id").join(joined, "query_id", "left").withColumn("context", missing)


def fewshot_nearest(questions: DataFrame, examples: DataFrame, k: int = 4, **columns: str) -> DataFrame:
    """The ``k`` examples closest to every question."""
    return knn_exact(questions, examples, k, **columns)
