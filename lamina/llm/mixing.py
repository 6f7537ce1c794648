"""Mixing sources to target weights, in DataFrame operations only.

Source s with the share p of all tokens gets the weight p^a / sum(p^a). The exponent a (one over the
temperature) is a multiple of one millionth between 0, where all sources weigh the same, and ``MOST``:

* the largest whose entropy is at least ``evenness`` times that of equal weights,
* or the smallest, up to 1, that repeats no source more than ``max_repeats`` times,
* with both, the larger of the two: the limit on repeats is kept.

Entropy falls as a rises, and so do the repeats of the smallest source up to 1, where all sources are
repeated alike. Either is a bisection. A pass over the table of sources tries 64 exponents at once, which is six halvings.

A source's weight times the budget is its number of tokens. Its documents lie in blocks by hash; every
epoch reads the blocks in a permutation of its own, and the last one ends at the document with which
the budget would be exceeded. A block's place in a permutation is arithmetic, so what a source needs is
one row: whole epochs, and the place and hash at which the last one ends. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import durable

STEP = 1_000_000
MOST = 4 * STEP
TRIED = 64
#: Primes above any number of blocks, so that multiplying by one permutes the blocks.
PRIMES = (1000003, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823)
MOST_BLOCKS = 4096
#: A table of at most this many sources (a few hundred bytes each) is sent to every task.
SENT_SOURCES = 10_000


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long")


def _digits(key: Column, first: int, count: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), first, count), 16, 10).cast("long")


def block_hash(key: Column) -> Column:
    return _digits(key, 1, 8)


def order_hash(key: Column) -> Column:
    return _digits(key, 9, 15)


def block_place(block: Column, blocks: Column, epoch: Column) -> Column:
    """Where ``block`` comes in the permutation of ``epoch``."""
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (epoch % len(PRIMES) + 1).cast("int"))
    return F.pmod(block * F.pmod(prime, blocks) + epoch * 7919 + 1, blocks)


def _first_holding(sources: DataFrame, exponent_holds: Column, most: int) -> int:
    """The smallest exponent, in steps, from which on the condition holds; ``most`` if it never does.

    ``exponent_holds`` is an aggregate over rows with ``p`` (the share), ``w`` (the weight, not yet
    divided by the sum over sources, ``total``) and ``repeats``.
    """
    low, high = 0, most  # the answer lies in [low, high]
    while low < high:
        width = -(-(high - low) // TRIED)
        tried = sources.select("*", F.explode(F.sequence(F.lit(low), F.lit(high - 1), F.lit(width))).alias("k")).withColumn(
            "w", F.pow("p", F.col("k") / STEP))
        held = {r["k"]: r["held"] for r in tried.groupBy("k").agg(exponent_holds.alias("held")).collect()}
        failing = [k for k, held_here in held.items() if not held_here]
        holding = [k for k, held_here in held.items() if held_here]
        low = max(failing) + 1 if failing else low
        high = min(holding) if holding else high
    return low


def source_plan(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None,
    evenness: float | None = None, max_repeats: float | None = None, budget: int | None = None,
    whole: bool = False, block_tokens: int = 1_000_000,
) -> DataFrame:
    """One row per source (null is one): ``source, tokens, exponent, weight, wanted, epochs, blocks, last_place, last_hash``.

    ``weight`` is in parts per billion, ``wanted`` in tokens.
    ``budget`` counts tokens and is that of the corpus when not given. With ``whole`` it is instead
    the least at which each source is read in full. No rows give no rows.
    """
    if evenness is None and max_repeats is None:
        raise ValueError("give an evenness, a limit on repeats or both")
    tokens = token_estimate(F.col("text")) if tokens is None else tokens
    # The texts are read once here; what follows needs a few bytes of each row.
    rows = durable(docs.select(F.col(source_col).alias("_source"), F.col(id_col).alias("_id"), tokens.alias("_tokens")))
    counted = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_tokens").alias("tokens"))
    sums = counted.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    total, number, largest = int(sums[0] or 0), int(sums[1]), int(sums[2] or 0)
    if not number:
        return counted.select("source", "tokens", *[F.lit(0).cast(t).alias(n) for n, t in (
            ("exponent", "double"), ("weight", "long"), ("wanted", "long"), ("epochs", "long"), ("blocks", "long"),
            ("last_place", "long"), ("last_hash", "long"))])
    budget = total if budget is None else budget
    shares = durable(counted.coalesce(max(1, min(200, number // 1000))).withColumn("p", F.col("tokens") / F.lit(total)))
    exponent = 0
    if max_repeats is not None:
        # A source is read weight * budget / tokens times; with ``whole``, the least-read one once.
        most = F.max(F.col("w") / F.col("p"))
        repeats = most / F.min(F.col("w") / F.col("p")) if whole else most / F.sum("w") * (budget / total)
        exponent = _first_holding(shares, repeats <= max_repeats, STEP)
    if evenness is not None:
        entropy = F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")
        below = _first_holding(shares, entropy < evenness * F.log(F.count("*").cast("double")), MOST)
        exponent = max(exponent, below - 1, 0)
    powered = shares.withColumn("w", F.pow("p", F.lit(exponent / STEP)))
    one = powered.agg(F.sum("w"), F.max(F.col("tokens") / F.col("w"))).first()
    reach = one[1] if whole else budget / one[0]
    weighed = powered.select(
        "source", "tokens", F.lit(exponent / STEP).alias("exponent"), F.round(F.col("w") / one[0] * 1e9).cast("long").alias("weight"),
        F.round(F.col("w") * reach).cast("long").alias("wanted"),
    ).select(
        "*", F.floor(F.col("wanted") / F.col("tokens")).cast("long").alias("epochs"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
    ).withColumn("left", F.col("wanted") - F.col("epochs") * F.col("tokens"))
    weighed = durable(weighed)
    # Where the last epoch ends: the block in which the tokens left run out, then the hash inside it.
    placed = _with_plan(rows, weighed, "_source", number).withColumn("place", block_place(
        F.pmod(block_hash(F.col("_id")), F.col("blocks")), F.col("blocks"), F.col("epochs")))
    per_block = placed.groupBy("source", "left", "place").agg(F.sum("_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("place")
    ends = (
        per_block.withColumn("upto", F.sum("n").over(before)).where(F.col("upto") > F.col("left"))
        .groupBy(F.col("source").alias("e_source"))
        .agg(F.min(F.struct("place", (F.col("left") - F.col("upto") + F.col("n")).alias("room"))).alias("e")).select("e_source", "e.*")
    )
    ends = durable(ends.select("e_source", F.col("place").alias("e_place"), "room"))
    inside = _with_plan(placed.select("_source", "_id", "_tokens", "place"), ends.withColumnRenamed("e_source", "source"), "_source", number).where(
        F.col("place") == F.col("e_place")).groupBy("source", "room", order_hash(F.col("_id")).alias("h")).agg(F.sum("_tokens").alias("n"))
    cuts = (
        inside.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("h"))).where(F.col("upto") > F.col("room"))
        .groupBy(F.col("source").alias("c_source")).agg(F.min("h").alias("last_hash"))
    )
    marks = ends.join(cuts, F.col("e_source").eqNullSafe(F.col("c_source"))).select("e_source", F.col("e_place").alias("last_place"), "last_hash")
    return durable(weighed.join(marks, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source", "left"))


def _with_plan(rows: DataFrame, plan: DataFrame, column: str, number: int) -> DataFrame:
    small = F.broadcast(plan) if number <= SENT_SOURCES else plan
    return rows.join(small, F.col(column).eqNullSafe(F.col("source")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, **how,
) -> DataFrame:
    """``docs`` as often as the mix takes them, with ``mix_epoch``, ``mix_place`` (of the block in the
    epoch), ``mix_order`` (inside the block), ``mix_weight`` (parts per billion) and ``mix_exponent``.

    ``how`` is passed to ``source_plan``. Reading by source, epoch, place and order gives the sequence.
    Null sources are one source. Null and empty texts count as one token. Rows that repeat an id are
    taken or left together, as are rows without an id. No rows: no rows. Columns of ``docs`` whose names
    begin with ``mix_`` are left out.
    """
    plan = source_plan(docs, id_col, source_col, tokens, **how)
    number = plan.count()
    sent = plan.withColumnRenamed("source", "plan_source")
    small = F.broadcast(sent) if number <= SENT_SOURCES else sent
    columns = [c for c in docs.columns if not c.startswith("mix_")]
    # The given columns travel as one struct, so their names meet no others.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{source_col}`").alias("of"),
                       block_hash(F.col(f"`{id_col}`")).alias("hash"), order_hash(F.col(f"`{id_col}`")).alias("mix_order"))
    joined = rows.join(small, F.col("of").eqNullSafe(F.col("plan_source"))).withColumn("block", F.pmod("hash", "blocks"))
    last = block_place(F.col("block"), F.col("blocks"), F.col("epochs"))
    extra = (last < F.col("last_place")) | ((last == F.col("last_place")) & (F.col("mix_order") < F.col("last_hash")))
    times = F.col("epochs") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    counted = joined.withColumn("times", times).where("times > 0")
    each = counted.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    made = each.select(
        "row", "mix_epoch", block_place(F.col("block"), F.col("blocks"), F.col("mix_epoch")).alias("mix_place"),
        "mix_order", F.col("weight").alias("mix_weight"), F.col("exponent").alias("mix_exponent"))
    return made.select(*[F.col(f"row.`{c}`") for c in columns], *[c for c in made.columns if c != "row"])
