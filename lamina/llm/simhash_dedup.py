"""Near copies by SimHash fingerprints, found through a perfect Golay code.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that differ in at most two
bits, some segment agrees in full while the segment after it (the first follows the last) differs in
at most one bit: the errors (2,0,0) and (1,1,0) in any order leave such a pair. So every fingerprint
is filed three times under one whole segment and the code words near the next one.

The binary Golay code has 4,096 words of 23 bits, and every word of 23 bits lies within three bits of
exactly one of them. A segment is filed under the code word it decodes to and those its one-bit
neighbours decode to (one, or about six). Two segments one bit apart then share the code word of
either, so the join on (segment pair, whole segment, code word) loses no pair. Candidates are
verified by counting differing bits.

Only different fingerprints meet; copies are one row with their smallest id. A key shared by more
than ``bucket`` fingerprints makes no pairs: its members are filed again under themselves and their
64 one-bit neighbours. Two fingerprints at distance two or less share such a neighbour, all that
share one are within distance two, so a star to the smallest is enough. That is exact and linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.batches import map_texts
from lamina.llm.components import connected_components
from lamina.session import durable

#: The generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1, and the
#: segment widths; shorter segments are padded with zeros to 23 bits.
GENERATOR = 0b101011100011
WIDTHS = (22, 21, 21)
SEED = 42


def golay_decoder() -> np.ndarray:
    """For each word of 23 bits, the number of the code word within three bits of it."""
    codes = np.zeros(1, np.uint32)
    for shift in range(12):
        codes = np.concatenate([codes, codes ^ np.uint32(GENERATOR << shift)])
    ones = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = np.concatenate(
        [[np.uint32(0)], ones,
         [a | b for i, a in enumerate(ones) for b in ones[i + 1:]],
         [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1:], i + 1) for c in ones[j + 1:]]]
    ).astype(np.uint32)
    table = np.empty(1 << 23, np.uint16)
    for number, code in enumerate(codes):
        table[errors ^ code] = number
    return table


def golay_keys(fingerprints: np.ndarray, decoder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row number and the key of every filing of ``fingerprints`` (unsigned 64-bit)."""
    segments, shift = [], 0
    for width in WIDTHS:
        segments.append(((fingerprints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint32))
        shift += width
    rows, keys = [], []
    for at, whole in enumerate(segments):
        after = (at + 1) % 3
        flips = np.concatenate([[0], 1 << np.arange(WIDTHS[after])]).astype(np.uint32)
        near = np.sort(decoder[segments[after][:, None] ^ flips[None, :]], axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(first)
        rows.append(row)
        keys.append((np.int64(at) << 34) | (whole[row].astype(np.int64) << 12) | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _majority() -> np.ndarray:
    """For each byte, its eight bits as eight counters of one byte each, in an unsigned 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def fingerprints_of(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; null and blank texts have zero.

    Bytes are split at ASCII white space only, and only A-Z are lower-cased, which is what ``bytes``
    methods do.
    """
    import xxhash

    digest, counters = xxhash.xxh64_intdigest, _majority()
    hashes: list[np.ndarray] = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if len(words) <= shingle:
            hashes.append(np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
        hashes.append(np.fromiter((digest(joined[s], SEED) for s in spans), np.uint64, len(words) - shingle + 1))
    lengths = np.array([len(h) for h in hashes], np.int64)
    result = np.zeros(len(texts), np.uint64)
    if not lengths.sum():
        return result
    # A counter of one byte holds 255 additions: texts are summed in runs of that many hashes.
    runs = -(-lengths // 255)
    owner = np.repeat(np.arange(len(texts)), runs)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = np.repeat(np.cumsum(lengths) - lengths, runs) + inside * 255
    every = np.ascontiguousarray(np.concatenate(hashes)).view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(counters[every], begins, axis=0).view(np.uint8).reshape(len(owner), 64)
    bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.add.reduceat(sums.astype(np.int64), bounds, axis=0)
    bits = counts * 2 > lengths[owner[bounds]][:, None]
    result[owner[bounds]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def text_mark(text: Column) -> Column:
    """A hash that tells texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, marked: bool = False) -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text, as a signed long with the same bits; if ``marked`` with its ``mark``."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = fingerprints_of(batch.column(1).to_pylist(), shingle).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["id", "fp", "mark"][:batch.num_columns])

        return step

    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *[text_mark(text).alias("mark")] * marked)
    return map_texts(picked, 1, work, "id long, fp long" + ", mark binary" * marked)


def _filed(fingerprints: DataFrame) -> DataFrame:
    def run(batches):
        decoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            decoder = golay_decoder() if decoder is None else decoder
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, keys = golay_keys(fps.view(np.uint64), decoder)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "key long, fp long")


def near_links(fingerprints: DataFrame, bucket: int = 32) -> DataFrame:
    """``(a, b)``: edges whose components are those of all pairs of ``fp`` within two bits.

    ``fp`` must not repeat. ``bucket`` decides only which of two exact ways a key takes.
    """
    # Most keys hold one fingerprint and end here; those left are few.
    filed = durable(_filed(fingerprints))
    shared = durable(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = filed.join(shared, "key")
    small = members.where(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        small.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.explode("fps").alias("a"), "fps")
        .select("a", F.explode(F.filter("fps", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= 2))).alias("b"))
    )
    ones = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    balls = members.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(ones).alias("one")).select(
        F.col("fp").bitwiseXOR(F.col("one")).alias("centre"), "fp")
    least = balls.groupBy("centre").agg(F.min("fp").alias("least"))
    stars = balls.join(least, "centre").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars)


def _components(each: DataFrame, bucket: int) -> DataFrame:
    """``(fp, component)`` of rows ``(id, fp)``: the smallest id of each group of fingerprints."""
    distinct = durable(each.groupBy("fp").agg(F.min("id").alias("first")))
    linked = connected_components(near_links(distinct, bucket))
    grouped = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    return grouped.join(least, "root").select("fp", "root", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 32) -> DataFrame:
    """``(id, fp, component)``: one row per row of ``docs``; groups of texts within two bits, transitively.

    ``component`` is the smallest id of the group. Null and blank texts share the fingerprint zero and
    are linked like any other. Repeated rows stay repeated. A null id keeps its row and counts only
    when a group has no other. No rows: no rows. Further columns of ``docs`` are not read.
    """
    each = durable(simhash(docs, id_col, text_col, shingle))
    return each.join(_components(each, bucket), "fp").select("id", "fp", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 32) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, of several that of the smallest hash of the text.

    Rows are told by id and text: texts that share an id and are no near copies all stay, and so do those of
    rows without an id, which come last in their group. Equal rows are near copies. No rows: no rows.
    """
    key = ["lacks", "id", "mark"]  # without nulls, so that the join and what follows it need one exchange of the texts

    def keyed(id: Column) -> list[Column]:
        return [id.isNull().alias("lacks"), F.coalesce(id, F.lit(0).cast("long")).alias("id")]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keyed(F.col(f"`{id_col}`").cast("long")),
                       text_mark(F.col(f"`{text_col}`")).alias("mark"))
    each = durable(simhash(docs, id_col, text_col, shingle, marked=True))
    known = _components(each, bucket).select("fp", "root")
    first = F.min(F.struct(*keyed(F.col("id")), "mark")).alias("first")
    kept = each.join(known, "fp").groupBy("root").agg(first).select("first.*")
    chosen = rows.join(kept, key, "left_semi")
    order = Window.partitionBy(*key).orderBy(F.col(f"row.`{text_col}`").isNull())
    one = chosen.withColumn("place", F.row_number().over(order)).where("place = 1")
    return one.select(*[F.col(f"row.`{c}`") for c in docs.columns])
