"""Ranked lexical search of all documents for a table of items, by dense products of blocks.

An item tile is a few hundred items with the terms they hold, numbered without gaps. A document tile is
the impacts of those terms in up to a thousand documents. Their product in double precision is a tile
of scores. Weights and impacts are whole numbers, and the terms of a tile are cut where a sum could
reach 2^53, so every product is exact and the parts are added as 64-bit integers. Of each tile only what can
still be among the best k of a task stays. Texts are not shuffled: a task sends k rows per item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.batches import cut
from lamina.llm.terms import utf8, words_of
from lamina.session import durable

#: Items go to the tasks in chunks of at most this many pairs of item and term (one item alone may have more).
CHUNK_PAIRS = 500_000
TILE_ITEMS = 256
TILE_TERMS = 4096
TILE_DOCS = 1024
#: Postings of the documents that wait for their tile.
HELD_POSTINGS = 2_000_000
#: No impact reaches this, and no sum of products may reach 2 ** 53.
IMPACT_LIMIT = 1_000_000
EXACT = 1 << 53


@dataclass
class ItemTile:
    """Items ``first`` to ``first + count``; parts are ``(terms, term of entry, item of entry, weight)``."""

    first: int
    count: int
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def item_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int) -> list[ItemTile]:
    """Tiles of the entries ``(item, term, weight)``, which are sorted by item and have no repeats."""
    begins = np.searchsorted(item, np.arange(items + 1))
    tiles, first = [], 0
    while first < items:
        last, known = first, 0
        # Items join while the tile's terms, counted with repeats, are few; a long item is a tile of its own.
        while last < items and last - first < TILE_ITEMS and (last == first or known + begins[last + 1] - begins[last] <= 2 * TILE_TERMS):
            known += begins[last + 1] - begins[last]
            last += 1
        mine = slice(begins[first], begins[last])
        t, i, w = term[mine], item[mine] - first, weight[mine]
        vocabulary, column = np.unique(t, return_inverse=True)
        parts, begin = [], 0
        order = np.argsort(column, kind="stable")
        column, i, w = column[order], i[order], w[order]
        starts = np.searchsorted(column, np.arange(len(vocabulary) + 1))
        sums = np.zeros(last - first, np.int64)
        for at in range(len(vocabulary) + 1):
            some = slice(starts[at], starts[at + 1]) if at < len(vocabulary) else slice(0, 0)
            grown = sums[i[some]] + w[some] * IMPACT_LIMIT
            if at == len(vocabulary) or at - begin >= TILE_TERMS or (len(grown) and grown.max() >= EXACT):
                if at > begin:
                    held = slice(starts[begin], starts[at])
                    parts.append((vocabulary[begin:at], column[held] - begin, i[held], w[held]))
                begin, sums = at, np.zeros(last - first, np.int64)
                grown = w[some] * IMPACT_LIMIT
            sums[i[some]] = grown
        tiles.append(ItemTile(first, last - first, parts))
        first = last
    return tiles


def tile_scores(tile: ItemTile, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Scores of ``docs`` documents (rows) for the items of a tile, from their postings."""
    scores = np.zeros((docs, tile.count), np.int64)
    local = np.full(terms, -1, np.int64)
    for vocabulary, column, item, weight in tile.parts:
        local[vocabulary] = np.arange(len(vocabulary))
        place = local[term]
        here = place >= 0
        impacts = np.zeros((docs, len(vocabulary)))
        impacts[doc[here], place[here]] = impact[here]
        weights = np.zeros((len(vocabulary), tile.count))
        weights[column, item] = weight
        scores += (impacts @ weights).astype(np.int64)
        local[vocabulary] = -1
    return scores


class Best:
    """The k best documents of each item so far: higher scores first, ties to smaller ids, no id last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        empty = np.zeros(0, np.int64)
        self.item, self.score, self.lacks, self.id = empty, empty, empty, empty

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, lacks: np.ndarray) -> None:
        """Take in a tile. Scores equal to the k-th stay until ids decide."""
        floor = self.floor[first:first + scores.shape[1]]
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k])
        row, column = np.nonzero(scores >= np.maximum(floor, 1))
        if not len(row):
            return
        item = np.r_[self.item, column + first]
        score, lack, key = np.r_[self.score, scores[row, column]], np.r_[self.lacks, lacks[row]], np.r_[self.id, ids[row]]
        order = np.lexsort((key, lack, -score, item))
        item = item[order]
        begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(begins, np.diff(np.r_[begins, len(item)]))
        kept = order[place < self.k]
        self.item, self.score, self.lacks, self.id = item[place < self.k], score[kept], lack[kept], key[kept]
        full = place == self.k - 1
        self.floor[item[full]] = score[order[full]]


def postings(texts: list[bytes | None], numbers: dict[bytes, int], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """``(document, term, occurrences)`` of the numbered terms, and the number of all terms of each document."""
    number, parts, lengths = numbers.get, [], []
    for at, text in enumerate(texts):
        words = words_of(text)
        lengths.append(len(words))
        found = [n for n in map(number, words) if n is not None]
        if found:
            parts.append(np.array(found, np.int64) + at * terms)
    pair, tf = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    return pair // max(terms, 1), pair % max(terms, 1), tf.astype(np.int64), lengths


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The different ``(item, term)``; items without a term have none."""
    kind = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, 1):
                found = [sorted(set(words_of(text))) for text in batch.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array([w for f in found for w in f], pa.binary())], ["item", "term"])

    return items.select(F.col(id_col).alias("item"), utf8(F.col(text_col)).alias("text")).mapInArrow(split, f"item {kind}, term binary").distinct()


def _chunks(pairs: DataFrame, most: int) -> tuple[int, Column]:
    """Into how many chunks the items are hashed so that each has at most ``most`` pairs or one item, and the chunk of a row."""
    sizes = durable(pairs.groupBy("item").agg(F.count("*").alias("n")))
    number = max(1, -(-2 * (sizes.agg(F.sum("n")).first()[0] or 0) // most)) if sizes.count() else 1
    number = 1 if number <= 2 else number
    while True:
        chunk = F.pmod(F.xxhash64(F.col("item")), F.lit(number))
        worst = sizes.groupBy(chunk.alias("chunk")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).where(
            (F.col("n") > most) & (F.col("items") > 1)).limit(1).count()
        if not worst:
            return number, chunk
        number *= 2


def _corpus_counts(texts: DataFrame, numbers, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents by numbered term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, every, per_term = 0, 0, np.zeros(terms, np.int64)
        for whole in batches:
            for batch in cut(whole, 1):
                _, term, _, lengths = postings(batch.column(1).to_pylist(), numbers.value, terms)
                holding += sum(n > 0 for n in lengths)
                every += sum(lengths)
                per_term += np.bincount(term, minlength=terms)
        held = np.flatnonzero(per_term)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, held]), pa.array(np.r_[holding, every, per_term[held]])], ["term", "n"])

    counts = np.zeros(terms + 2, np.int64)
    for row in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row["term"] + 2] = row["n"]
    return int(counts[0]), int(counts[1]), counts[2:]


def term_weights(documents: int, holding: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of (2N + 2) / (2 df + 1)."""
    return np.array([math.floor(1000 * math.log((2.0 * documents + 2.0) / (2.0 * int(df) + 1.0))) for df in holding], np.int64)


def _search_chunk(texts: DataFrame, pairs: DataFrame, kind: str, k: int, length_share: int, saturation: int) -> DataFrame:
    schema = f"item {kind}, doc long, score long"
    collected = pairs.select("item", "term").toArrow()  # at most CHUNK_PAIRS rows, or one item
    spark = texts.sparkSession
    if not collected.num_rows:
        return spark.createDataFrame([], schema)
    item_type = collected.schema.field("item").type
    items, terms = collected["item"].to_pylist(), collected["term"].to_pylist()
    names = sorted(set(items), key=lambda i: (i is None, i))
    vocabulary = {t: n for n, t in enumerate(sorted(set(terms)))}
    numbers = spark.sparkContext.broadcast(vocabulary)
    documents, every, holding = _corpus_counts(texts, numbers, len(vocabulary))
    if not documents:
        return spark.createDataFrame([], schema)
    number = {name: n for n, name in enumerate(names)}
    pair = np.array(sorted({(number[i], vocabulary[t]) for i, t in zip(items, terms, strict=True)}), np.int64)
    weights = term_weights(documents, holding)[pair[:, 1]]
    useful = (weights > 0) & (holding[pair[:, 1]] > 0)
    tiles = item_tiles(pair[useful, 0], pair[useful, 1], weights[useful], len(names))
    sent = spark.sparkContext.broadcast((names, tiles))
    size = len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tiles = sent.value
        best = Best(len(names), k)
        held, waiting, entries = [], 0, 0

        def flush() -> None:
            doc, term, impact, ids, lacks = (np.concatenate(x) for x in zip(*held, strict=True))
            for begin in range(0, len(ids), TILE_DOCS):
                end = min(begin + TILE_DOCS, len(ids))
                here = slice(*np.searchsorted(doc, [begin, end]))
                for tile in tiles:
                    scores = tile_scores(tile, doc[here] - begin, term[here], impact[here], end - begin, size)
                    best.add(tile.first, scores, ids[begin:end], lacks[begin:end])

        for whole in batches:
            for batch in cut(whole, 1):
                doc, term, tf, lengths = postings(batch.column(1).to_pylist(), numbers.value, size)
                m = np.array([100 - length_share + length_share * n * documents // every for n in lengths], np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + saturation * m[doc]) if len(doc) else tf
                key = batch.column(0)
                ids, lacks = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False)
                held.append((doc + waiting, term, impact, ids, lacks.astype(np.int64)))
                waiting, entries = waiting + len(ids), entries + len(doc)
                if waiting >= TILE_DOCS or entries >= HELD_POSTINGS:
                    flush()
                    held, waiting, entries = [], 0, 0
        if waiting:
            flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[n] for n in best.item], item_type), pa.array(best.id, pa.int64(), mask=best.lacks.astype(bool)), pa.array(best.score)],
            ["item", "doc", "score"])

    return texts.mapInArrow(search, schema)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", length_share: int = 90, saturation: int = 8, chunk_pairs: int = CHUNK_PAIRS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest score above 0 for each item.

    A term weighs by the share of documents without it; its impact in a document saturates with its occurrences, the
    later the longer the document, of which ``length_share`` is the part in a hundred that depends on length.
    Null and empty texts hold no term. Equal scores go to the smaller ``doc_id``. Rows that repeat an id are documents
    of their own, and one without an id comes last among equals. Item rows that repeat an id, or have none, are
    one item with the terms of all. An item without a term, or none of whose terms occurs, has no row. No
    documents or no items: no rows. Document ids are whole numbers. Further columns are not read.

    Documents are read twice for every ``chunk_pairs`` pairs of item and term.
    """
    kind = items.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), utf8(F.col(text_col)).alias("text"))
    pairs = durable(item_terms(items, item_col, item_text))
    number, chunk = _chunks(pairs, chunk_pairs)
    found = reduce(DataFrame.unionByName, [_search_chunk(texts, pairs.where(chunk == at), kind, k, length_share, saturation) for at in range(number)])
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
