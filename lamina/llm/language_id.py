"""The language of every word of code-switched text, by a linear-chain conditional random field.

A word's emission is the sum of learned weights of its features: the word itself (the lexicon), its
prefixes and suffixes, and its inner n-grams, all hashed into one table. Transitions between languages are
learned too. Forward-backward gives each word its probability of every language; a text's language is that
with the most expected words, its score their share.

Training words carry the language of their text, which is right for most words; the field is fitted by
AdaGrad on the log likelihood of texts. The sample is bounded: of each language an equal number of labelled
texts, those with the smallest hashes, and one at least; together about ``train_rows``. Of a text of more than
``train_chars`` code points a span of that length is learned from.

Texts of a batch are laid end to end in lanes and all lanes advance together, so the recursion costs a few
array operations per step for many texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.batches import map_texts, training_span
from lamina.llm.words import ngram_features, number_words
from lamina.session import durable

INNER, AFFIX = 3, 3
#: A chain has at most this many words; a longer text is read as several.
CHAIN = 512
UNKNOWN = "und"


def _lanes(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each text, and the number of steps; texts of no words take none."""
    order = np.argsort(-lengths, kind="stable").tolist()
    lane, begin = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled = [(0, at) for at in range(lanes)]
    for n in order:
        used, at = filled[0]
        lane[n], begin[n] = at, used
        heapq.heapreplace(filled, (used + int(lengths[n]), at))
    return lane, begin, max(filled)[0]


class Field:
    """The trained parameters: ``weights`` of hashed features, ``moves`` from language to language, ``starts``."""

    def __init__(self, languages: list[str], bits: int = 16):
        self.languages, self.bits = languages, bits
        self.weights = np.zeros((1 << bits, len(languages)), np.float32)
        self.moves = np.zeros((len(languages), len(languages)))
        self.starts = np.zeros(len(languages))

    def features(self, types: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, hashes = ngram_features(types, INNER, AFFIX)
        return owner, (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def emissions(self, types: list[str]) -> np.ndarray:
        """Scores of each word type, some 20,000 types at a time."""
        found = np.zeros((len(types), len(self.languages)))
        for at in range(0, len(types), 20_000):
            owner, rows = self.features(types[at:at + 20_000])
            for k in range(len(self.languages)):
                sums = np.bincount(owner, self.weights[rows, k])
                found[at:at + len(sums), k] = sums
        return found

    def marginals(self, emissions: np.ndarray, words: np.ndarray, lengths: np.ndarray, moves_too: bool = False):
        """Probability of each language for each word; on wish the expected moves and the log likelihood's sum."""
        n = len(self.languages)
        count = np.maximum(-(-lengths // CHAIN), 1)
        chains = np.full(int(count.sum()), CHAIN, np.int64)
        chains[np.cumsum(count) - 1] = lengths - (count - 1) * CHAIN
        lengths = chains
        lane, begin, steps = _lanes(lengths, int(min(2048, max(1, (lengths > 0).sum()))))
        lanes = int(lane.max()) + 1 if len(lane) else 1
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        step_of, lane_of = begin[owner] + inside, lane[owner]
        scores = emissions[words]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
        here = np.ones((steps, lanes, n))
        here[step_of, lane_of] = scores
        opens = np.zeros((steps, lanes), bool)
        has = lengths > 0
        opens[begin[has], lane[has]] = True
        goes_on = np.zeros((steps, lanes), bool)
        goes_on[step_of, lane_of] = True
        goes_on &= ~opens
        moves, starts = np.exp(self.moves), np.exp(self.starts)
        forward = np.empty_like(here)
        state = np.ones((lanes, n)) / n
        for t in range(steps):
            state = np.where(opens[t][:, None], starts, state @ moves) * here[t]
            state /= state.sum(axis=1, keepdims=True)
            forward[t] = state
        back = np.ones((lanes, n)) / n
        both = np.empty_like(here)
        expected = np.zeros((n, n))
        for t in range(steps - 1, -1, -1):
            joint = forward[t] * back
            both[t] = joint / joint.sum(axis=1, keepdims=True)
            incoming = back * here[t]
            if moves_too and t:
                pair = forward[t - 1][:, :, None] * moves[None] * incoming[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                expected += pair[goes_on[t]].sum(axis=0)
            back = np.where(goes_on[t][:, None], incoming @ moves.T, 1.0)
            back /= back.sum(axis=1, keepdims=True)
        return (both[step_of, lane_of], expected) if moves_too else both[step_of, lane_of]

    def _each(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text and the probability of each language of every word, and words per text."""
        types, words, lengths = number_words(texts)
        each = self.marginals(self.emissions(types), words, lengths) if len(words) and self.languages else np.zeros((len(words), len(self.languages)))
        return np.repeat(np.arange(len(texts)), lengths), each, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of expected words; ``und`` and 0 without letters."""
        owner, each, lengths = self._each(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        shares = np.column_stack([np.bincount(owner, each[:, k], len(texts)) for k in range(len(self.languages))])
        shares /= np.maximum(lengths, 1)[:, None]
        best = shares.argmax(axis=1)
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(best, lengths, strict=True)]
        return names, np.clip(np.where(lengths > 0, shares.max(axis=1), 0.0), 0, 1)

    def sureness(self, texts: list[str | None]) -> np.ndarray:
        """How far the probability of each word's likeliest language is, on average, from equal ones (0) to certainty (1).

        0 without letters; 1 if fewer than two languages were learned, when a text with letters can't be told from others.
        """
        owner, each, lengths = self._each(texts)
        n = len(self.languages)
        if n < 2:
            return (lengths > 0).astype(float)
        most = np.bincount(owner, each.max(axis=1), len(texts)) / np.maximum(lengths, 1)
        return np.clip((most - 1 / n) / (1 - 1 / n), 0, 1)


def train(texts: list[str], labels: list[str], bits: int = 16, rounds: int = 5, batch: int = 200, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """A field over the sorted different ``labels``."""
    field = Field(sorted(set(labels)), bits)
    n = len(field.languages)
    if n < 2:
        return field
    truth = np.array([field.languages.index(x) for x in labels])
    squares, moved, started = np.full((1 << bits, n), 1e-2, np.float32), np.full((n, n), 1.0), np.full(n, 1.0)
    groups = [np.arange(at, len(texts), max(1, len(texts) // batch)) for at in range(max(1, len(texts) // batch))]
    prepared = []
    for some in groups:
        types, words, lengths = number_words([texts[k] for k in some])
        if len(words):
            prepared.append((some, words, lengths, len(types), *field.features(types)))
    for _ in range(rounds):
        for some, words, lengths, size, owner, rows in prepared:
            emissions = np.column_stack([np.bincount(owner, field.weights[rows, k], size) for k in range(n)])
            each, expected = field.marginals(emissions, words, lengths, moves_too=True)
            label = np.repeat(truth[some], lengths)
            each[np.arange(len(words)), label] -= 1
            total = len(words)
            used = np.unique(rows)
            for k in range(n):
                slope = np.bincount(words, each[:, k], size)
                down = np.bincount(rows, slope[owner], 1 << bits)[used] / np.sqrt(total) + decay * field.weights[used, k]
                squares[used, k] += down * down
                field.weights[used, k] -= rate * down / np.sqrt(squares[used, k])
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[some], truth[some]), np.maximum(lengths - 1, 0))
            down = (expected - seen) / np.sqrt(total) + 0.05 * field.moves
            moved += down * down
            field.moves -= rate * down / np.sqrt(moved)
    return field


def fit_languages(
    docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    train_rows: int = 1500, train_chars: int = 10_000, seed: int = 7, **how,
) -> Field:
    """A field from the rows with a language that ``learnable`` (over the id column) holds for.

    Rows that repeat an id and a language count as one.
    """
    rows = docs.where(learnable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    counted = rows.groupBy("_lang").agg(F.count("*").alias("rows"))
    languages = counted.count()
    each = -(-train_rows // max(languages, 2))
    by = Window.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(seed)), "_id")
    rows = rows.where(F.col("_text").isNotNull())

    def draw(candidates: DataFrame) -> DataFrame:
        # Spark keeps so many rows of a language in each task before they are shuffled.
        return candidates.select("_lang", "_id").distinct().withColumn("_row", F.row_number().over(by)).where(F.col("_row") <= each).drop("_row")

    # The smallest hashes of a language lie, but for a chance of nearly none, in the share of all hashes that
    # should hold eight times as many: a language of very many rows then sends no more than others.
    place = (F.xxhash64("_id", F.lit(seed)).cast("double") + 2.0**63) / 2.0**64
    near = rows.select("_lang", "_id").join(F.broadcast(counted) if languages <= 1000 else counted, "_lang").where(place <= 8.0 * each / F.col("rows"))
    drawn = durable(draw(near))
    short = drawn.groupBy("_lang").count().join(counted, "_lang", "right").where(F.coalesce("count", F.lit(0)) < F.least(F.lit(each), "rows"))
    if short.limit(1).count():
        drawn = durable(draw(rows))  # rows that repeat an id or have no text leave fewer
    spans = rows.select("_id", "_lang", training_span(F.col("_text"), F.col("_id"), train_chars, seed).alias("_text"))
    sample = spans.join(F.broadcast(drawn), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    sample = sample.toArrow().to_pandas().sort_values(["_id", "_lang"])
    return train(sample["_text"].tolist(), sample["_lang"].tolist(), **how)


def identify_languages(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row of ``docs``; whole texts are read.

    Texts that are null or have no letter are ``und`` with score 0. Equal shares go to the first language
    by name. Repeated rows and null ids keep their rows. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(field))  # a table of fixed size

    def work():
        field = Field([])
        vars(field).update(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = field.predict(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

        return step

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(picked, 1, work, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, field: Field, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has letters and whose words are known: their sureness is at least ``least``.

    How many languages share the text, or were learned, does not matter. Where fewer than two were learned, every
    text with letters stays. Null and empty texts go; repeated rows and null ids are judged each by itself. No rows: no rows.
    The rows come out as they went in, in the task that reads them.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(vars(field)), docs.columns.index(text_col)

    def run(batches):
        from lamina.llm.batches import cut

        field = Field([])
        vars(field).update(sent.value)
        for whole in batches:
            for batch in cut(whole, at):
                sure = field.sureness(batch.column(at).to_pylist())
                yield batch.filter(pa.array((sure > 0) & (sure >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
