"""Toxicity by a convolutional network over hashed words, trained in numpy.

A word's embedding is the sum of embeddings of its hashed parts: the word and its beginnings. Filters
several words wide slide over the text, each keeps its largest value, and a logistic layer joins them.
Parts seen in few training texts share nothing: they have no embedding, so a long text of rare words
collects no chance hits. What a filter adds for a word type at each of its places is worked out once per
batch; a text then costs sums and a maximum.

The network is fitted on every labelled text, read whole. The texts are dealt by hash to shares of about
``SHARE_ROWS``, each held by one task, so that no result depends on how the rows were laid out. Parts are counted
over all shares. Each round every share trains on its own texts from the same parameters, and the means of what
they reach begin the next: of a part over the words that have it, of all else over the texts. One share alone
trains all rounds in one go. The driver holds the parameters and counts only, 48 bytes for each part.

A fourth of each share fits nothing but one threshold per language; scores are shifted in log odds so that each threshold becomes
``threshold``. The language is told from function words of the text; texts without any share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import cut, map_texts
from lamina.llm.words import join_words, number_words, prefix_features
from lamina.session import durable

#: Function words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by not but",
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus o este mi",
}
WIDTHS = (1, 2, 3)
#: A share of the training texts has about so many rows, and about so many code points at most.
SHARE_ROWS, SHARE_CHARS = 6000, 32 << 20
#: So many words at a time, or one text, go through the filters while training.
LINE_WORDS = 500_000
#: So many word types at a time are looked up.
TYPES = 1 << 15
#: Sums over shares are of whole numbers, so that they come out the same in any order.
FIXED = 1 << 20
#: Scores are first counted in bins of a 64th of log odds.
BINS = 64


@dataclass(frozen=True)
class Training:
    """How a network is trained."""

    threshold: float = 0.7
    longest: int = 7
    dim: int = 8
    filters: int = 8
    least_texts: int = 3
    rounds: int = 6
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 3


def told_languages(types: list[str], words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text the number of the language most of whose function words it has, or the next number."""
    number = {word: n for n, word in enumerate(types)}
    marks = np.zeros((len(types) + 1, len(FUNCTION_WORDS)), np.float64)
    for column, listed in enumerate(FUNCTION_WORDS.values()):
        for word in listed.split():
            if word in number:
                marks[number[word], column] = 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    votes = np.column_stack([np.bincount(owner, marks[words, c], len(lengths)) for c in range(len(FUNCTION_WORDS))])
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))


class Network:
    """The trained parameters. ``known`` are sorted hashes of the word parts with an embedding."""

    def __init__(self, longest: int, dim: int, filters: int, seed: int):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.known = np.zeros(0, np.uint64)
        self.embed = np.zeros((1, dim), np.float32)
        self.kernels = [rng.normal(0, 0.3, (width, dim, filters)).astype(np.float32) for width in WIDTHS]
        for kernel in self.kernels:  # the first dimension starts as the log odds of a word part
            kernel[:, 0, :] = np.abs(kernel[:, 0, :])
        self.bias = np.full(filters * len(WIDTHS), -0.5, np.float32)
        self.out = rng.normal(0.3, 0.1, filters * len(WIDTHS)).astype(np.float32)
        self.start = np.float32(-2.0)
        self.shifts = np.zeros(len(FUNCTION_WORDS) + 1)

    def parts(self, types: list[str]) -> np.ndarray:
        """Rows of ``embed`` of each type's parts; the last row, which is zero, for others."""
        found = np.full((len(types), self.longest), len(self.known), np.int32)
        for begin in range(0, len(types) if len(self.known) else 0, TYPES):
            hashes, exists = prefix_features(types[begin:begin + TYPES], self.longest)
            # Looked up in order, hashes find the table's pages in the cache.
            order, at = np.argsort(hashes, axis=None), np.empty(hashes.size, np.int64)
            at[order] = np.minimum(np.searchsorted(self.known, hashes.ravel()[order]), len(self.known) - 1)
            at = at.reshape(hashes.shape)
            there = exists & (self.known[at] == hashes)
            found[begin:begin + TYPES][there] = at[there]
        return found

    def pooled(self, embedded: np.ndarray, words: np.ndarray, lengths: np.ndarray, places: bool = False):
        """The largest value of each filter in each text, and where it begins."""
        gap = max(WIDTHS) - 1
        # Texts are laid out with empty words between them, so that no window spans two texts.
        blank = len(embedded)
        starts = np.cumsum(lengths + gap) - lengths
        line = np.full(int(lengths.sum()) + gap * (len(lengths) + 1), blank, np.int64)
        line[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(words))] = words
        rows = np.vstack([embedded, np.zeros((1, embedded.shape[1]), np.float32)])
        best, where = [], []
        for kernel, bias in zip(self.kernels, np.split(self.bias, len(WIDTHS)), strict=True):
            width = len(kernel)
            values = (rows @ kernel[0])[line]
            for k in range(1, width):
                values[:-k] += (rows @ kernel[k])[line[k:]]
            begins = starts - (width - 1)
            bounds = np.column_stack([begins, starts + lengths]).ravel()
            # A text without words has the windows over empty words alone.
            bounds[1::2] = np.maximum(bounds[1::2], begins + 1)
            bounds = bounds[:-1] if bounds[-1] >= len(values) else bounds
            top = np.maximum.reduceat(values, bounds, axis=0)[::2]
            if places:
                where.append(np.array([begins[n] + values[begins[n]:max(starts[n] + lengths[n], begins[n] + 1)].argmax(axis=0) for n in range(len(lengths))]))
            best.append(np.maximum(top + bias, 0))
        return np.hstack(best), (np.hstack(where) if places else None), line

    def begin(self, hashes: np.ndarray, clean: np.ndarray, toxic: np.ndarray, texts: tuple[int, int], rng: np.random.Generator) -> None:
        """Parts, by sorted hash, from how many of the clean and the toxic ``texts`` have each."""
        self.known = hashes
        odds = np.log((toxic + 0.3) / (texts[1] + 1)) - np.log((clean + 0.3) / (texts[0] + 1))
        dim = self.embed.shape[1]
        self.embed = np.zeros((len(hashes) + 1, dim), np.float32)
        for at in range(0, len(hashes), 1 << 16):
            end = min(at + (1 << 16), len(hashes))
            self.embed[at:end] = rng.normal(0, 0.02, (end - at, dim))
        self.embed[:-1, 0] += np.clip(odds, -1.0, 4.0) / 4

    def dense(self) -> np.ndarray:
        """All parameters but embeddings, in rows as long as those."""
        flat = np.concatenate([*(kernel.ravel() for kernel in self.kernels), self.bias, self.out, [self.start]])
        dim = self.embed.shape[1]
        return np.pad(flat, (0, -len(flat) % dim)).reshape(-1, dim).astype(np.float32)

    def set_dense(self, rows: np.ndarray) -> None:
        flat, at = rows.astype(np.float32).ravel(), 0
        for value in (*self.kernels, self.bias, self.out):
            value[:] = flat[at:at + value.size].reshape(value.shape)
            at += value.size
        self.start = flat[at]

    def log_odds(self, types, words, lengths) -> np.ndarray:
        embedded = _summed(self.embed, self.parts(types))
        pooled, _, _ = self.pooled(embedded, words, lengths)
        return (pooled @ self.out + self.start).astype(np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        types, words, lengths = number_words(texts)
        odds = self.log_odds(types, words, lengths) + self.shifts[told_languages(types, words, lengths)]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _summed(embed: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The sum of the embeddings in each row of ``parts``."""
    total = embed[parts[:, 0]]
    for k in range(1, parts.shape[1]):
        total += embed[parts[:, k]]
    return total


def _adam(state: dict, name, value: np.ndarray, slope: np.ndarray, rate: float, step: int) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (slope - m)
    v += 0.01 * (slope * slope - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


class Share:
    """Labelled texts that one task trains on: word types, the number of each word in reading order, words and label of each text.

    A fourth is held back for the thresholds.
    """

    def __init__(self, types: list[str], words: np.ndarray, lengths: np.ndarray, labels: np.ndarray, seed: int, number: int = 0):
        self.types, self.words, self.lengths, self.labels = types, words, lengths, labels
        self.ends = np.cumsum(lengths)
        order = np.random.default_rng([seed, number]).permutation(len(labels))
        self.held, self.fit = order[: len(labels) // 4], order[len(labels) // 4:]

    def words_of(self, some: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[self.ends[n] - self.lengths[n]:self.ends[n]] for n in some]) if len(some) else np.zeros(0, np.int32)

    def groups(self, some: np.ndarray) -> list[np.ndarray]:
        """``some`` in consecutive groups of at most ``LINE_WORDS`` words, or one text."""
        begins, held = [], 0
        for at, length in enumerate(self.lengths[some]):
            if not begins or held and held + length > LINE_WORDS:
                begins.append(at)
                held = 0
            held += length
        return np.split(some, begins[1:]) if begins else []

    def times(self) -> np.ndarray:
        """How often the fitting texts have each word type."""
        fits = np.zeros(len(self.labels), bool)
        fits[self.fit] = True
        return np.bincount(self.words[np.repeat(fits, self.lengths)], minlength=len(self.types))

    def counted(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the parts of the fitting texts; how many clean and how many toxic ones, and words, have each."""
        hashes, exists = prefix_features(self.types, longest) if self.types else (np.zeros((0, longest), np.uint64), np.zeros((0, longest), bool))
        every, place = np.unique(hashes[exists], return_inverse=True)
        part = np.full(hashes.shape, len(every), np.int32)
        part[exists] = place
        counts = np.zeros((2, len(every) + 1), np.int64)
        for n in self.fit:
            mine = np.unique(self.words[self.ends[n] - self.lengths[n]:self.ends[n]])
            counts[int(self.labels[n])][part[mine]] += 1  # a part that comes again is counted once
        words = np.bincount(part.ravel(), np.repeat(self.times(), longest), len(every) + 1).astype(np.int64)
        kept = np.flatnonzero(counts[:, :-1].sum(axis=0))
        return every[kept], counts[0, kept], counts[1, kept], words[kept]

    def held_odds(self, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds, language and label of the texts that fit nothing."""
        odds, told = [], []
        for some in self.groups(self.held):
            own = self.words_of(some)
            used = np.unique(own)
            types, words = [self.types[n] for n in used], np.searchsorted(used, own)
            odds.append(net.log_odds(types, words, self.lengths[some]))
            told.append(told_languages(types, words, self.lengths[some]))
        return np.concatenate([np.zeros(0), *odds]), np.concatenate([np.zeros(0, np.int64), *told]), self.labels[self.held]


def descend(net: Network, share: Share, rng: np.random.Generator, how: Training, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Train ``net`` for some rounds over the fitting texts of ``share``, all but its embeddings in place.

    Returns the parts whose embeddings move, where they end and how many words of those texts have each.
    """
    dim, filters, rate = how.dim, how.filters, how.rate
    parts = net.parts(share.types)
    there = np.zeros(len(net.known) + 1, bool)
    there[parts] = there[-1] = True
    mine, parts = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[parts]
    embed = net.embed[mine]
    # Embeddings no text has moved yet stay as they are.
    moved, place = np.zeros(len(mine), bool), np.zeros(len(mine), np.int32)
    first, second = np.zeros_like(embed), np.zeros_like(embed)
    state, step = {}, 0
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(share.fit), max(1, len(share.fit) // how.batch)):
            step += 1
            groups = [(g, share.words_of(g)) for g in share.groups(some)]
            there = np.zeros(len(share.types), bool)
            for _, own in groups:
                there[own] = True
            used, number = np.flatnonzero(there), np.cumsum(there) - 1
            embedded = _summed(embed, parts[used])
            # The words under each filter where it is largest, by width and place in it.
            found, at_words = [], []
            for group, own in groups:
                best, where, line = net.pooled(embedded, number[own], share.lengths[group], places=True)
                found.append(best)
                at_words.append([[line[np.minimum(where[:, at * filters:(at + 1) * filters] + k, len(line) - 1)] for k in range(width)] for at, width in enumerate(WIDTHS)])
            pooled = np.vstack(found)
            odds = pooled @ net.out + net.start
            error = (1 / (1 + np.exp(-odds)) - share.labels[some]) / len(some)
            through = error[:, None] * net.out[None, :] * (pooled > 0)
            slope_embedded = np.zeros((len(used) + 1, dim), np.float32)
            rows = np.vstack([embedded, np.zeros((1, dim), np.float32)])
            for at, kernel in enumerate(net.kernels):
                own = slice(at * filters, (at + 1) * filters)
                slope = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    at_word = np.vstack([x[at][k] for x in at_words])
                    slope[k] = np.einsum("nfd,nf->df", rows[at_word], through[:, own])
                    np.add.at(slope_embedded, at_word, through[:, own][:, :, None] * kernel[k].T[None])
                _adam(state, ("kernel", at), kernel, slope + how.decay * kernel, rate, step)
            slope_out = pooled.T @ error + how.decay * net.out
            _adam(state, "out", net.out, slope_out.astype(np.float32), rate, step)
            _adam(state, "bias", net.bias, through.sum(axis=0).astype(np.float32), rate, step)
            net.start = np.float32(net.start - rate * error.sum() * 4)
            touched = np.flatnonzero(np.abs(slope_embedded[:-1]).sum(axis=1))
            if len(touched):
                rows_of = parts[used[touched]]
                moved[rows_of] = True
                live = np.flatnonzero(moved)
                place[live] = np.arange(len(live))
                slope_parts = np.zeros((len(live), dim), np.float32)
                np.add.at(slope_parts, place[rows_of], np.broadcast_to(slope_embedded[touched][:, None, :], (*rows_of.shape, dim)))
                some_state, value = {"": (first[live], second[live])}, embed[live]
                _adam(some_state, "", value, slope_parts, rate / 2, step)
                (first[live], second[live]), embed[live] = some_state[""], value
                embed[-1] = 0
    weight = np.bincount(parts.ravel(), np.repeat(share.times(), net.longest), len(mine)).astype(np.int64)
    moved[-1] = False
    return mine[moved], embed[moved], weight[moved]


def _constant(net: Network, toxic: bool) -> Network:
    net.start = np.float32(4.0 if toxic else -4.0)
    net.out[:] = 0
    return net


def train(texts: list[str], labels: np.ndarray, **how) -> Network:
    """A network fitted on three fourths of the rows, its thresholds on the rest: one share, in this process."""
    how = Training(**how)
    net = Network(how.longest, how.dim, how.filters, how.seed)
    if not len(texts) or labels.min() == labels.max():
        return _constant(net, bool(len(texts) and labels.max() > 0))
    share = Share(*number_words(texts), labels, how.seed)
    hashes, clean, toxic, _ = share.counted(how.longest)
    often = clean + toxic >= how.least_texts
    rng = _drawn(how.seed, len(texts))
    ones = int(labels[share.fit].sum())
    net.begin(hashes[often], clean[often], toxic[often], (len(share.fit) - ones, ones), rng)
    used, reached, _ = descend(net, share, rng, how, how.rounds)
    net.embed[used] = reached
    odds, told, truth = share.held_odds(net)
    values, place = np.unique(odds, return_inverse=True)
    seen = np.zeros((len(FUNCTION_WORDS) + 1, 2, len(values)), np.int64)
    np.add.at(seen, (told, 0, place), 1)
    np.add.at(seen, (told, 1, place), truth)
    net.shifts = _shifts([(values, *seen[n]) for n in range(len(seen))], how.threshold)
    return net


def _drawn(seed: int, rows: int) -> np.random.Generator:
    """The numbers that follow those by which a share of so many rows is split."""
    rng = np.random.default_rng(seed)
    rng.permutation(rows)
    return rng


def _stream(rng: np.random.Generator, number: int) -> np.random.Generator:
    """Numbers of its own for each share and round; the first goes on with those of ``rng``."""
    own = deepcopy(rng)
    return np.random.Generator(own.bit_generator.jumped(number)) if number else own


def _best_cut(values: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> float:
    """The middle between the scores around the threshold with the largest F1; ``values`` are different scores."""
    order = np.flatnonzero(counts)[np.argsort(-values[counts > 0], kind="stable")]
    values, counts, hits = values[order], counts[order], hits[order]
    at = int(np.argmax(2 * np.cumsum(hits) / (np.cumsum(counts) + hits.sum())))
    below = values[at + 1] if at + 1 < len(values) else values[at] - 2
    return (values[at] + below) / 2


def _joined(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores with counts and toxic texts of several groups as one."""
    values, place = np.unique(np.concatenate([g[0] for g in groups]), return_inverse=True)
    return values, *(np.bincount(place, np.concatenate([g[k] for g in groups]), len(values)).astype(np.int64) for k in (1, 2))


def _shifts(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Per language the shift of log odds that moves its best threshold to ``threshold``.

    The best threshold has the largest F1 on texts that fitted nothing, in the middle between the scores
    around it. Languages with fewer than five toxic texts take that of all.
    """
    goal = np.log(threshold / (1 - threshold))
    every = _joined(groups)
    if not every[1].sum():
        return np.zeros(len(groups))
    general = _best_cut(*every) if every[2].sum() else goal
    return goal - np.array([_best_cut(*g) if g[2].sum() >= 5 else general for g in groups])


def _may_hold_best(bins: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The bins of scores that can hold the threshold with the largest F1, were all their toxic texts first."""
    order = np.argsort(-bins)
    counts, hits = counts[order], hits[order]
    upto, total = np.cumsum(hits), hits.sum()
    edge = 2 * upto / (np.cumsum(counts) + total)
    most = 2 * upto / np.maximum(np.cumsum(counts) - counts + hits + total, 1)
    return bins[order][most >= edge.max()]


def _calibrated(held: DataFrame, threshold: float) -> np.ndarray:
    """``_shifts`` from rows ``(told, odds, n, hits)``. The driver gets counts of bins, and single scores only
    of those bins that can hold the best threshold of a language or of all."""
    held = durable(held.groupBy("told", "odds").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
                   .withColumn("bin", F.floor(F.col("odds") * BINS).cast("long")))
    binned = held.groupBy("told", "bin").agg(F.max("odds").alias("odds"), F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow().to_pandas()
    languages = range(len(FUNCTION_WORDS) + 1)
    wanted: set[int] = set()
    for some in (binned, *(binned[binned["told"] == n] for n in languages)):
        if len(some):
            one = some.groupby("bin")[["n", "hits"]].sum()
            wanted |= set(_may_hold_best(one.index.to_numpy(), one["n"].to_numpy(), one["hits"].to_numpy()).tolist())
    single = held.join(F.broadcast(held.sparkSession.createDataFrame([(n,) for n in sorted(wanted)], "bin long")), "bin").select("told", "odds", "n", "hits").toArrow().to_pandas()
    rest = binned[~binned["bin"].isin(wanted)]
    return _shifts([tuple(np.concatenate([t[t["told"] == n][c].to_numpy() for t in (single, rest)]) for c in ("odds", "n", "hits")) for n in languages], threshold)


def _with_some_mark(texts: DataFrame, marked: DataFrame, seed: int) -> DataFrame:
    """All rows of ``texts`` whose id is in ``marked``, and about one in eight of the others.

    So few texts besides the labelled ones are shuffled. Ids are told by one bit each in maps of 32 MB at most;
    of more ids than those tell apart, more of the other rows stay.
    """
    wide = 1 << 15
    maps = min(1 << 13, 8 * marked.count() // wide + 1)
    place = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(maps * wide))
    bits = marked.select(F.floor(place / wide).alias("_map"), (place % wide).alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", ((place % wide) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = (F.floor(place / wide) == F.col("_map")) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return texts.join(F.broadcast(bits), found, "left_semi")


def _packed(seed: int):
    """For ``mapInArrow``: rows ``(share, text, label)`` of one share become one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table, words, lengths, labels = None, {}, [], [], []
        for whole in batches:
            for batch in cut(whole, 1):
                number = batch.column(0)[0].as_py()
                types, some, sizes = number_words(batch.column(1).to_pylist())
                words.append(join_words(table, types)[some])
                lengths.append(sizes)
                labels.append(batch.column(2).to_numpy())
        if number is not None:
            truth = np.concatenate(labels)
            fit = Share([], np.zeros(0, np.int32), np.zeros(len(truth), np.int64), truth, seed, number).fit
            row = [number, len(fit), int(truth[fit].sum()), "\0".join(table), np.concatenate(words).tobytes(), np.concatenate(lengths).tobytes(), truth.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["share", "fits", "toxic", "types", "words", "lengths", "labels"])

    return run


def _shares(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, Share]]:
    for at in range(batch.num_rows):
        number, types, words, lengths, labels = (batch.column(name)[at].as_py() for name in ("share", "types", "words", "lengths", "labels"))
        yield number, Share(types.split("\0") if types else [], np.frombuffer(words, np.int32), np.frombuffer(lengths, np.int64), np.frombuffer(labels, np.int64), seed, number)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    seed: int = 3, **how,
) -> Network:
    """A network from all labelled rows that ``learnable`` (over the id column) holds for; whole texts are read."""
    how = Training(seed=seed, **how)
    net = Network(how.longest, how.dim, how.filters, seed)
    context = docs.sparkSession.sparkContext
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("_label"))
    texts = docs.where(learnable & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # Only ids and lengths meet the labels here.
    rows, chars, low, high = texts.select("_id", F.length("_text").cast("long").alias("_chars")).join(marked, "_id").agg(
        F.count("*"), F.sum("_chars"), F.min("_label"), F.max("_label")).first()
    if not rows or low == high:
        return _constant(net, bool(rows and high > 0))
    if (low, high) != (0, 1):
        raise ValueError(f"labels are 0 and 1, not {low} to {high}")
    shares = max(1, -(-rows // SHARE_ROWS), -(-chars // SHARE_CHARS))
    dealt = _with_some_mark(texts, marked, seed).join(marked.hint("merge"), "_id").withColumn("_share", F.pmod(F.xxhash64("_id", "_text", F.lit(seed)), F.lit(shares)).cast("int"))
    packed = durable(
        dealt.repartitionById(shares, "_share").sortWithinPartitions("_id", "_text").select("_share", "_text", "_label")
        .mapInArrow(_packed(seed), "share long, fits long, toxic long, types string, words binary, lengths binary, labels binary"))
    fits, ones = packed.agg(F.sum("fits"), F.sum("toxic")).first()
    counted = ["clean", "toxic", "words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, share in _shares(batch, seed):
                hashes, *counts = share.counted(how.longest)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *map(pa.array, counts)], ["part", *counted])

    parts = packed.mapInArrow(count, "part long, clean long, toxic long, words long").groupBy("part").agg(*(F.sum(name).alias(name) for name in counted))
    parts = parts.where(F.col("clean") + F.col("toxic") >= how.least_texts).toArrow()
    hashes = parts.column("part").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    clean, toxic, words = (parts.column(name).to_numpy()[order] for name in counted)
    rng = _drawn(seed, rows)
    net.begin(hashes[order], clean, toxic, (fits - ones, ones), rng)
    del parts, hashes, order, clean, toxic

    names = [f"v{k}" for k in range(how.dim)]
    turns = 1 if shares == 1 else how.rounds
    for turn in range(turns):
        sent = context.broadcast((vars(net), rng))  # as large as the vocabulary of parts

        def work(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, share in _shares(batch, seed):
                    own = _copied(sent.value[0])
                    before = own.dense()
                    used, reached, weight = descend(own, share, _stream(sent.value[1], turn * shares + number), how, how.rounds // turns)
                    # Rows of the other parameters have numbers below zero.
                    number_of = np.r_[used, -1 - np.arange(len(before))]
                    weight = np.r_[weight, np.full(len(before), len(share.fit))]
                    way = np.vstack([reached.astype(np.float64) - own.embed[used], own.dense().astype(np.float64) - before])
                    sums = np.rint(way * weight[:, None] * FIXED).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(number_of.astype(np.int64)), *(pa.array(sums[:, k]) for k in range(how.dim))], ["part", *names])

        # What did not move in a share stands for no way there, and counts in the mean.
        moved = packed.mapInArrow(work, ", ".join(f"{name} long" for name in ("part", *names))).groupBy("part").agg(
            *((F.sum(name) / F.lit(float(FIXED))).alias(name) for name in names)).toArrow()
        number_of, way = moved.column("part").to_numpy(), np.column_stack([moved.column(name).to_numpy() for name in names])
        part = number_of >= 0
        net.embed[number_of[part]] += way[part] / words[number_of[part], None]
        net.set_dense(net.dense() + way[~part][np.argsort(-number_of[~part])] / fits)
        sent.destroy()

    sent = context.broadcast(vars(net))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, share in _shares(batch, seed):
                odds, told, truth = share.held_odds(_copied(sent.value))
                yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(odds), pa.array(np.ones(len(odds), np.int64)), pa.array(truth)], ["told", "odds", "n", "hits"])

    net.shifts = _calibrated(packed.mapInArrow(hold, "told long, odds double, n long, hits long"), how.threshold)
    sent.destroy()
    return net


def _copied(state: dict) -> Network:
    """A network from the parameters of another, whose embeddings it shares."""
    net = Network(1, 1, 1, 0)
    vars(net).update(state)
    net.kernels = [kernel.copy() for kernel in net.kernels]
    net.bias, net.out = net.bias.copy(), net.out.copy()
    return net


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per row of ``docs``: higher is likelier toxic; whole texts are read.

    Null texts and texts without letters have the score of no evidence. Repeated rows and null ids keep
    their rows. No rows: no rows. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(net))  # bounded by the training sample

    def work():
        net = Network(1, 1, 1, 0)
        vars(net).update(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(batch.column(1).to_pylist()))], ["id", "score"])

        return step

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(picked, 1, work, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
