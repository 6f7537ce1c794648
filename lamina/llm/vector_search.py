"""Nearest neighbours by an inverted file whose lists are scanned dimension by dimension.

Vectors are unit length, turned by a random rotation and held in column blocks. Each lies in the list of
its nearest centre; a query probes the lists of its nearest centres. Inside a list the squared distance of
all candidates grows block by block. After t of D dimensions the distance so far, times D / t, estimates
the whole: a candidate is abandoned when the estimate exceeds the query's bound by the factor
(1 + epsilon / sqrt(t))^2, the test of Gao and Long, "High-Dimensional Approximate Nearest Neighbor
Search: with Reliable and Efficient Distance Comparison Operations". The bound is the k-th best of the lists
scanned so far in the task. Survivors are scored in double precision on the vectors as
given.

The centres are fitted on a bounded sample; every row is indexed. Lists are gathered to shards of about
``shard_rows`` rows, long lists being split, and queries to blocks of ``query_rows``: a task meets one shard
with one block, so both its sides are bounded whatever their sum. A task returns k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.vectors import cosines, matrix, unit, usable
from lamina.session import durable


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        owner = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def scan_list(queries: np.ndarray, bounds: np.ndarray, candidates: np.ndarray, blocks: list[tuple[int, int]], epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, squared distance)`` of the pairs that no test abandons."""
    dim, (begin, end) = queries.shape[1], blocks[0]
    a, b = queries[:, begin:end], candidates[:, begin:end]
    sums = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
    limit = lambda t: bounds * (t / dim) * (1 + epsilon / np.sqrt(t)) ** 2 if t < dim else bounds * (1 + 1e-9) + 1e-12
    q, c = np.nonzero(sums <= limit(end)[:, None])
    far = sums[q, c]
    for begin, end in blocks[1:]:
        for at in range(0, len(q), 200_000):
            some = slice(at, at + 200_000)
            step = queries[q[some], begin:end] - candidates[c[some], begin:end]
            far[some] += np.einsum("ij,ij->i", step, step)
        kept = far <= limit(end)[q]
        q, c, far = q[kept], c[kept], far[kept]
    return q, c, far


def _best(q: np.ndarray, rank_by: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest of each q, ties to the smaller id."""
    order = np.lexsort((ids, rank_by, q))
    begins = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
    return order[rank < k]


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, dim: int | None = None,
    sample_rows: int = 16_384, lists: int | None = None, probe_share: float = 0.7, shard_rows: int = 16_384, query_rows: int = 65_536,
    epsilon: float = 2.1, column_block: int = 16, rounds: int = 8, seed: int = 5,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` holds for, the k rows found nearest by cosine.

    A query's own id is no candidate. All candidates are returned if there are fewer than k. Null, empty
    and zero vectors, vectors with null or non-finite components, rows without an id and vectors not of
    ``dim`` components when given take no part. When not given, each vector length is indexed and searched
    by itself. Equal scores go to the
    smaller id. No rows: no rows. Further columns are not read.

    ``sample_rows`` bounds the rows on which centres are fitted: those with the smallest hashes. The number of lists is the root of the number of rows; ``probe_share`` is
    the share of lists that a query probes. Vectors without structure need a large one.
    """
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    if dim is None:
        # One row per vector length.
        dims = sorted(r["d"] for r in good.select(F.size("vec").alias("d")).distinct().collect())
        each = [nearest(vectors, is_query, id_col, vector_col, k, d, sample_rows, lists, probe_share, shard_rows, query_rows, epsilon, column_block, rounds, seed)
                for d in dims or [1]]
        return reduce(DataFrame.unionByName, each)
    good = good.where(F.size("vec") == dim)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    total = good.count()
    if not total:
        return spark.createDataFrame([], schema)
    order = F.xxhash64("id", F.lit(seed))
    drawn = good.select("id", "vec").orderBy(order, "id").limit(sample_rows).select("vec").toArrow()
    lists = lists or max(1, round(total ** 0.5))
    centres = fit_centres(unit(matrix(drawn["vec"].combine_chunks())), lists, rounds, seed)
    lists = len(centres)
    probes = max(1, round(lists * probe_share))
    sent = spark.sparkContext.broadcast(centres)  # bounded by sample_rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                owner = np.argmax(unit(matrix(some.column(1))) @ sent.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(owner.astype(np.int32))], ["id", "vec", "asks", "list"])

    indexed = durable(good.mapInArrow(assign, "id long, vec array<double>, asks boolean, list int"))
    # One row per list; their number is bounded by the sample.
    counts = np.zeros(lists, np.int64)
    for row in indexed.groupBy("list").count().collect():
        counts[row["list"]] = row["count"]
    pieces = np.maximum(1, -(-counts // shard_rows))
    shard_of, shard, filled = np.zeros(lists, np.int64), 0, 0
    for at in range(lists):
        if filled and filled + counts[at] > shard_rows:
            shard, filled = shard + 1, 0
        shard_of[at] = shard
        filled += counts[at]
        if pieces[at] > 1:
            shard, filled = shard + pieces[at], 0
    shards = int(shard_of[-1] + pieces[-1])
    asking = int(indexed.where("asks").count())
    query_blocks = max(1, -(-asking // query_rows))

    def route_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                if not some.num_rows:
                    continue
                ids, close = some.column(0).to_numpy(), unit(matrix(some.column(1))) @ sent.value.T
                order = np.argsort(-close, axis=1, kind="stable")
                # More lists where the nearest hold too few rows for k and the query itself.
                held = np.cumsum(counts[order], axis=1)
                take = np.minimum(np.maximum(probes, (held <= k).sum(axis=1) + 1), lists)
                near = [o[:n] for o, n in zip(order, take, strict=True)]
                least = close[np.arange(len(ids)), order[np.arange(len(ids)), take - 1]]
                rows, shard = [], []
                for row, mine in enumerate(near):
                    to = np.unique(np.concatenate([shard_of[l] + np.arange(pieces[l]) for l in mine]))
                    rows.append(np.full(len(to), row))
                    shard.append(to)
                rows, shard = np.concatenate(rows), np.concatenate(shard)
                block = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % query_blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(block[rows]), pa.array(ids[rows]), some.column(1).take(pa.array(rows)), pa.array(least[rows])],
                    ["shard", "block", "id", "vec", "least"])

    queries = indexed.where("asks").mapInArrow(route_queries, "shard long, block long, id long, vec array<double>, least double")
    first, many = F.array(*[F.lit(int(x)) for x in shard_of]), F.array(*[F.lit(int(x)) for x in pieces])
    at = F.col("list") + 1
    candidates = indexed.select(
        (F.element_at(first, at) + F.pmod(F.xxhash64("id"), F.element_at(many, at))).cast("long").alias("shard"), "id", "vec", "list",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("block"))
    blocks = [(b, min(b + column_block, dim)) for b in range(0, dim, column_block)]

    def meet(key, asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not there.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        turn = rotation(dim, seed)
        there = there.sort_by("list")
        c_ids, c_list, c_vec = there["id"].to_numpy(), there["list"].to_numpy(), matrix(there["vec"].combine_chunks())
        c_turned = unit(c_vec) @ turn
        q_ids, q_vec = asked["id"].to_numpy(), matrix(asked["vec"].combine_chunks())
        bound = np.full(len(q_ids), 4.0)
        q_turned = unit(q_vec) @ turn
        # A query probes the lists whose centres are as near as the last of its share; rounding may differ.
        lists_here = np.unique(c_list)
        probed = unit(q_vec) @ sent.value[lists_here].T >= asked["least"].to_numpy()[:, None] - 1e-12
        held_q, held_c, held_far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for column, number in enumerate(lists_here):
            begin, end = np.searchsorted(c_list, [number, number + 1])
            mine = np.flatnonzero(probed[:, column])
            for some in np.array_split(mine, max(1, len(mine) * (end - begin) // 2_000_000 + 1)):
                if not len(some):
                    continue
                q, c, far = scan_list(q_turned[some], bound[some], c_turned[begin:end], blocks, epsilon)
                q, c = some[q], c + begin
                other = q_ids[q] != c_ids[c]
                q, c, far = np.r_[held_q, q[other]], np.r_[held_c, c[other]], np.r_[held_far, far[other]]
                # One more than k: rounding may reorder the last places, which exact scores decide.
                best = _best(q, far, c_ids[c], k + 1)
                held_q, held_c, held_far = q[best], c[best], far[best]
                full = np.bincount(held_q, minlength=len(q_ids)) > k
                worst = np.full(len(q_ids), -1.0)
                np.maximum.at(worst, held_q, held_far)
                bound = np.where(full, np.minimum(bound, worst), bound)
        score = cosines(q_vec[held_q], c_vec[held_c]) if len(held_q) else np.zeros(0)
        best = _best(held_q, -score, c_ids[held_c], k)
        return pa.table([pa.array(q_ids[held_q[best]]), pa.array(c_ids[held_c[best]]), pa.array(score[best])], names=names)

    found = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
