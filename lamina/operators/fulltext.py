"""Full-text search over a block index: positions, phrases, negation and cover-density rank.

A chunk is analysed once: its words in order become terms with positions, heading first. Up to
``BLOCK_CHUNKS`` chunks form a block, one row of the index, with the largest weight that each term has in it.
Search sends the questions to the blocks: a block whose terms cannot lift any chunk over the
k-th score met so far is passed over, and a task hands on k rows per question. There is never a row per
question and chunk, and neither texts nor postings are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.constants import BODY_WEIGHT, CANDIDATES_PER_BRANCH, FRENCH_STOP_WORDS, HEADING_WEIGHT
from lamina.functions.stemming import french_stem
from lamina.operators.relational import top_per_group
from lamina.session import bound_batches, durable

BLOCK_CHUNKS = 256
# Words whose term a worker remembers.
REMEMBERED = 200_000
# Terms of questions that are sent to the tasks at once, a few megabytes.
SENT_TERMS = 100_000
# Weights of heading and body in tenths: sums of occurrences are whole numbers.
_TENTHS = (round(HEADING_WEIGHT * 10), round(BODY_WEIGHT * 10))
_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r'(-?)"([^"]*)"|(-?)([^\s"]+)')


@dataclass(frozen=True)
class Analysis:
    """How words become terms."""

    stop_words: tuple[str, ...] = ()
    stem: bool = False


FRENCH, SIMPLE = Analysis(FRENCH_STOP_WORDS, True), Analysis()
#: Documents are stemmed; in code a stem would break the match of an identifier.
BY_SOURCE_TYPE = {"doc": FRENCH, "code": SIMPLE}


class _Terms(dict):
    """The term of a word, None for a stop word; remembered, so a word is stemmed once per worker."""

    def __init__(self, analysis: Analysis):
        self.stop, self.stem = frozenset(analysis.stop_words), analysis.stem

    def __missing__(self, word: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        term = None if word in self.stop else french_stem(word) if self.stem else word
        self[word] = term
        return term


def analyser(analysis: Analysis) -> Callable[[str | None], list[str | None]]:
    term = _Terms(analysis).__getitem__
    return lambda text: list(map(term, _WORD.findall(text.lower()))) if text else []


def chunk_entries(
    heading: str | None, content: str | None, analyse: Callable[[str | None], list[str | None]],
    only: Collection[str] | None = None,
) -> dict[str, list]:
    """Positions of every term, or of those in ``only``, after the number of them in the heading.

    Stop words have positions but no terms; the body goes on after the last term of the heading.
    """
    found: dict[str, list] = {}
    last = 0
    for at, term in enumerate(analyse(heading), 1):
        if term is not None:
            last = at
            if only is None or term in only:
                found.setdefault(term, [0]).append(at)
    for entry in found.values():
        entry[0] = len(entry) - 1
    for at, term in enumerate(analyse(content), last + 1):
        if term is not None and (only is None or term in only):
            found.setdefault(term, [0]).append(at)
    return found


def _source(chunks: DataFrame, chunk_id: str, heading: str, content: str, config: str | None) -> DataFrame:
    bound_batches(chunks.sparkSession)
    kind = F.lit("") if config is None else F.coalesce(F.col(config).cast("string"), F.lit(""))
    return chunks.select(F.col(chunk_id).alias("chunk_id"), kind.alias("config"), F.col(heading).cast("string").alias("heading"),
                         F.col(content).cast("string").alias("content"))


def _analyses(analysis: Analysis | Mapping[str, Analysis], config: str | None) -> dict[str, Analysis]:
    if isinstance(analysis, Analysis) != (config is None):
        raise ValueError("give one analysis, or one for each value of the config column")
    return {"": analysis} if isinstance(analysis, Analysis) else dict(analysis)


def _lists(flat: list, sizes: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)), pa.array(flat, kind))


def positional_index(
    chunks: DataFrame, chunk_id: str = "chunk_id", heading: str = "heading", content: str = "content",
    analysis: Analysis | Mapping[str, Analysis] = FRENCH, config: str | None = None,
) -> DataFrame:
    """Postings ``(chunk_id, config, term, headings, positions)``; the first ``headings`` positions lie in the heading.

    With ``config``, the column that names the analysis of a chunk, ``analysis`` maps its values; a chunk
    of another value fails the job. Null headings and texts hold no words.
    """
    named = _analyses(analysis, config)
    kind = chunks.schema[chunk_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analysers = {name: analyser(a) for name, a in named.items()}
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_CHUNKS):
                batch = whole.slice(begin, BLOCK_CHUNKS)
                owner, terms, headings, flat, sizes = [], [], [], [], []
                configs = batch.column(1).to_pylist()
                for at, (name, head, body) in enumerate(zip(configs, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    for term, entry in chunk_entries(head, body, analysers[name]).items():
                        owner.append(at)
                        terms.append(term)
                        headings.append(entry[0])
                        flat += entry[1:]
                        sizes.append(len(entry) - 1)
                took = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(took), batch.column(1).take(took), pa.array(terms, pa.string()), pa.array(headings, pa.int32()),
                     _lists(flat, sizes, pa.int32())],
                    ["chunk_id", "config", "term", "headings", "positions"])

    return _source(chunks, chunk_id, heading, content, config).mapInArrow(
        run, f"chunk_id {kind}, config string, term string, headings int, positions array<int>")


def block_index(
    chunks: DataFrame, chunk_id: str = "chunk_id", heading: str = "heading", content: str = "content",
    analysis: Analysis | Mapping[str, Analysis] = FRENCH, config: str | None = None, block_chunks: int = BLOCK_CHUNKS,
    only: Collection[str] | None = None,
) -> DataFrame:
    """The same postings as rows of up to ``block_chunks`` chunks of one config, to be stored or searched.

    Term number t of a block has its postings from ``starts[t]`` to ``starts[t + 1]``: the chunk's number in the
    block, occurrences in its heading and body, and from ``place_starts`` on its positions. ``most`` is the term's
    largest weight in a chunk, in tenths. With ``only``, a bounded set such as ``asked_terms`` gives, the blocks hold no other terms and
    serve the questions that ask for these.
    """
    wanted = None if only is None else chunks.sparkSession.sparkContext.broadcast(frozenset(only))
    named = _analyses(analysis, config)
    kind = chunks.schema[chunk_id].dataType.simpleString()

    def block(name: str, ids: pa.Array, entries: list[dict[str, list]]) -> list[pa.Array]:
        by_term: dict[str, list] = {}
        for member, found in enumerate(entries):
            for term, entry in found.items():
                by_term.setdefault(term, []).append((member, entry))
        terms = list(by_term)
        posted = [p for t in terms for p in by_term[t]]
        heads = np.array([e[0] for _, e in posted], np.int32)
        sizes = np.array([len(e) - 1 for _, e in posted], np.int32)
        starts = np.r_[0, np.cumsum([len(by_term[t]) for t in terms], dtype=np.int64)].astype(np.int32)
        weights = heads * _TENTHS[0] + (sizes - heads) * _TENTHS[1]
        most = np.maximum.reduceat(weights, starts[:-1]) if len(terms) else weights
        whole = [starts, np.array([m for m, _ in posted], np.int32), heads, sizes - heads, np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32),
                 np.fromiter((p for _, e in posted for p in e[1:]), np.int32, int(sizes.sum()))]
        return [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([terms], pa.list_(pa.string())),
                *[pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, pa.int32())) for a in (most, *whole)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analysers = {name: analyser(a) for name, a in named.items()}
        for whole in batches:
            configs = np.array(whole.column(1).to_pylist(), object)
            for name in dict.fromkeys(configs):
                mine = np.flatnonzero(configs == name)
                for begin in range(0, len(mine), block_chunks):
                    some = whole.take(pa.array(mine[begin:begin + block_chunks]))
                    texts = zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)
                    entries = [chunk_entries(head, body, analysers[name], wanted and wanted.value) for head, body in texts]
                    yield pa.RecordBatch.from_arrays(block(name, some.column(0), entries), _BLOCK_NAMES)

    arrays = ", ".join(f"{n} array<int>" for n in _BLOCK_NAMES[3:])
    return _source(chunks, chunk_id, heading, content, config).mapInArrow(
        run, f"config string, chunk_ids array<{kind}>, terms array<string>, {arrays}")


_BLOCK_NAMES = ["config", "chunk_ids", "terms", "most", "starts", "members", "headings", "bodies", "place_starts", "places"]


@dataclass(frozen=True)
class Clause:
    """A term (one word), a phrase (words at fixed distances), or the lack of either."""

    terms: tuple[str, ...]
    offsets: tuple[int, ...] = (0,)
    negated: bool = False


def parse_question(text: str | None, analyse: Callable[[str | None], list[str | None]], syntax: bool = True) -> list[Clause]:
    """The clauses of a question, any of which is enough to match; repeated ones once.

    With ``syntax``, quoted words are a phrase, whose stop words leave gaps, a minus sign before a word or a phrase asks for
    its lack, and a lone ``or`` between words says what holds anyway.
    """
    def clause(found: list[str | None], negated: bool) -> list[Clause]:
        held = [(at, term) for at, term in enumerate(found) if term is not None]
        if not held:
            return []
        return [Clause(tuple(t for _, t in held), tuple(at - held[0][0] for at, _ in held), negated)]

    if not syntax:
        return list(dict.fromkeys(Clause((t,)) for t in analyse(text) if t is not None))
    tokens, clauses = list(_TOKEN.finditer(text or "")), []
    for n, token in enumerate(tokens):
        minus, phrase, minus_word, word = token.groups()
        if phrase is not None:
            clauses += clause(analyse(phrase), bool(minus))
        elif minus_word:
            clauses += clause(analyse(word), True)
        elif word.lower() != "or" or n in (0, len(tokens) - 1):
            clauses += [Clause((t,)) for t in analyse(word) if t is not None]
    return list(dict.fromkeys(clauses))


def parse_questions(
    queries: DataFrame, query_id: str = "query_id", text: str = "text",
    analysis: Analysis | Mapping[str, Analysis] = FRENCH, syntax: bool = True,
) -> DataFrame:
    """Clauses ``(query_id, config, clause, negated, terms, offsets)`` of every question, for each config.

    A question without a term has no rows. Questions that share an id are asked as one.
    """
    named = {"": analysis} if isinstance(analysis, Analysis) else dict(analysis)
    kind = queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analysers = {name: analyser(a) for name, a in named.items()}
        for batch in batches:
            found = [(at, name, n, c) for at, question in enumerate(batch.column(1).to_pylist()) for name, analyse in analysers.items()
                     for n, c in enumerate(parse_question(question, analyse, syntax))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([f[0] for f in found], pa.int32())), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.int32()), pa.array([f[3].negated for f in found], pa.bool_()),
                 pa.array([list(f[3].terms) for f in found], pa.list_(pa.string())), pa.array([list(f[3].offsets) for f in found], pa.list_(pa.int32()))],
                ["query_id", "config", "clause", "negated", "terms", "offsets"])

    asked = queries.select(F.col(query_id).alias("query_id"), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(run, f"query_id {kind}, config string, clause int, negated boolean, terms array<string>, offsets array<int>")


def asked_terms(clauses: DataFrame, most: int = SENT_TERMS) -> set[str] | None:
    """All terms that questions ask for, if they are at most ``most``; else None, and a whole index is needed."""
    rows = clauses.select(F.explode("terms").alias("term")).distinct().limit(most + 1).collect()
    return {r["term"] for r in rows} if len(rows) <= most else None


@dataclass
class _Asked:
    """The questions put to chunks of one config, by numbers of questions and terms."""

    numbers: dict[str, int] = field(default_factory=dict)
    plain: list[tuple[int, int]] = field(default_factory=list)
    composed: dict[int, list[tuple[tuple[int, ...], tuple[int, ...], bool]]] = field(default_factory=dict)

    def add(self, question: int, clauses: list[Clause]) -> None:
        coded = [(tuple(self.numbers.setdefault(t, len(self.numbers)) for t in c.terms), c.offsets, c.negated) for c in dict.fromkeys(clauses)]
        if all(len(terms) == 1 and not negated for terms, _, negated in coded):
            self.plain += [(question, terms[0]) for terms, _, _ in coded]
        else:
            self.composed[question] = coded


class _Best:
    """The k best chunks of every question: higher scores first, ties to smaller ids, no id last."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.zeros(questions)
        self.held: list[list[tuple]] = [[] for _ in range(questions)]

    def offer(self, question: int, scores: np.ndarray, ids: list) -> None:
        """``scores`` of a block; a chunk that does not match has a negative one."""
        least = self.floor[question]
        if len(scores) > self.k:
            least = max(least, np.partition(scores, -self.k)[-self.k])
        for at in np.flatnonzero(scores >= least):
            self.held[question].append((-float(scores[at]), ids[at] is None, ids[at]))
        best = self.held[question] = sorted(self.held[question], key=lambda h: (h[0], h[1], h[2] if not h[1] else 0))[:self.k]
        if len(best) == self.k:
            self.floor[question] = -best[-1][0]


def cover_density(entries: dict[int, tuple[int, bool]], clauses: Sequence[tuple[tuple[int, ...], tuple[int, ...], bool]]) -> float:
    """Rank of a chunk for clauses, -1.0 if it does not match.

    ``entries`` maps a position to the term there and whether it lies in the heading; they are the
    occurrences of all terms asked for. Covers are met from left to right: the first entry up to which some clause
    holds ends one, and the last from which it still holds begins it; the next begins further on. From an entry
    that is a negated term on, that clause no longer holds, and where no other does the search ends. A cover
    counts the harmonic mean of its entries' weights, divided by one plus the positions in it that are no entries.
    """
    order = sorted(entries)
    present = {term for term, _ in entries.values()}
    matches, alone, phrases, any_entry, lacking = False, set(), [], False, []
    for terms, offsets, negated in clauses:
        if len(terms) == 1:
            matches |= (terms[0] in present) != negated
            if negated:
                lacking.append(terms[0])
            else:
                alone.add(terms[0])
            continue
        begins = [at for at in order if all(entries.get(at + o, (None,))[0] == t for t, o in zip(terms, offsets, strict=True))]
        matches |= bool(begins) != negated
        any_entry |= negated  # one entry alone is never the phrase
        phrases += [] if negated else [(at, at + offsets[-1]) for at in begins]
    if not matches:
        return -1.0

    def holds(at: int) -> bool:
        term = entries[at][0]
        return any_entry or term in alone or any(term != t for t in lacking)

    # What comes first from a place on: by its end, and of equal ends the latest begin.
    stretches = sorted({*phrases, *((at, at) for at in order if entries[at][0] in alone)})
    first: list[tuple[int, int]] = []
    for begin, end in reversed(stretches):
        first.append(min(first[-1], (end, -begin)) if first else (end, -begin))
    first.reverse()
    begins = [begin for begin, _ in stretches]
    rank, at = 0.0, 0
    while at < len(order):
        begin = end = order[at]
        if not holds(begin):
            coming = bisect_left(begins, begin)
            if coming == len(begins):
                break
            end, back = first[coming]
            begin = end if holds(end) else -back
        low, high = bisect_left(order, begin), bisect_right(order, end)
        inside = order[low:high]
        mean = len(inside) / sum(1 / (HEADING_WEIGHT if entries[p][1] else BODY_WEIGHT) for p in inside)
        rank += mean / (1 + (end - begin) - (len(inside) - 1))
        at = low + 1
    return round(rank, 6)


def _ints(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _search_block(batch: pa.RecordBatch, row: int, asked: _Asked, pairs: tuple[np.ndarray, np.ndarray], best: _Best) -> None:
    terms = batch.column("terms")[row].values.to_pylist()
    here = np.full(len(asked.numbers) + 1, -1)
    for at, number in enumerate(map(asked.numbers.get, terms)):
        if number is not None:
            here[number] = at
    if not len(asked.numbers) or (here < 0).all() and not asked.composed:
        return
    ids = batch.column("chunk_ids")[row].values.to_pylist()
    most, starts, members = (_ints(batch, n, row) for n in ("most", "starts", "members"))
    headings, bodies = (_ints(batch, n, row).astype(np.int64) for n in ("headings", "bodies"))
    # The most that a chunk of this block could score: questions that it cannot help are passed over.
    bound = np.append(most, 0)[here] / 10
    question, term = pairs
    reach = np.bincount(question, bound[term], minlength=len(best.floor)) if len(question) else np.zeros(len(best.floor))
    for q in np.flatnonzero((reach > 0) & (reach >= best.floor - 1e-9)):
        mine = here[term[slice(*np.searchsorted(question, [q, q + 1]))]]
        posts = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in mine[mine >= 0]])
        tenths = np.bincount(members[posts], headings[posts] * _TENTHS[0] + bodies[posts] * _TENTHS[1], minlength=len(ids))
        best.offer(q, np.where(tenths > 0, tenths / 10, -1.0), ids)
    if not asked.composed:
        return
    place_starts, places = _ints(batch, "place_starts", row), _ints(batch, "places", row)
    for q, clauses in asked.composed.items():
        operands = sorted({t for terms, _, _ in clauses for t in terms})
        # Every cover begins at an entry of its own and counts at most as much as a heading word.
        if sum(bound[t] for t in operands) / BODY_WEIGHT * HEADING_WEIGHT < best.floor[q]:
            continue
        lacking = any(negated for _, _, negated in clauses)
        scores = np.full(len(ids), 0.0 if lacking else -1.0)

        def posts(t: int) -> slice:
            return slice(starts[here[t]], starts[here[t] + 1]) if here[t] >= 0 else slice(0, 0)

        def spread(t: int, head: int, body: int) -> np.ndarray:
            out, mine = np.zeros(len(ids), np.int64), posts(t)
            out[members[mine]] = headings[mine] * head + bodies[mine] * body
            return out

        # Covers begin at places of their own. Without negation these are entries of a lone word, which count their weight, and
        # begins of a phrase, of which there are no more than of its rarest word; with negation any entry may be one.
        if lacking:
            reach = sum(spread(t, *_TENTHS) for t in operands)
        else:
            reach = sum(spread(terms[0], *_TENTHS) if len(terms) == 1 else np.minimum.reduce([spread(t, _TENTHS[0], _TENTHS[0]) for t in terms])
                        for terms, _, _ in dict.fromkeys(clauses))
        wanted = (reach > 0) & (reach / 10 >= best.floor[q] - 1e-6)
        scores[(reach > 0) & ~wanted] = -1.0  # below the k-th score met so far
        entries: dict[int, dict[int, tuple[int, bool]]] = {}
        for t in operands:
            mine = posts(t)
            for post in (np.flatnonzero(wanted[members[mine]]) + mine.start).tolist():
                found = entries.setdefault(int(members[post]), {})
                for n, at in enumerate(places[place_starts[post]:place_starts[post + 1]].tolist()):
                    found[at] = (t, n < headings[post])
        for member, found in entries.items():
            scores[member] = cover_density(found, clauses)
        best.offer(q, scores, ids)


def _search(blocks: DataFrame, clauses: DataFrame, k: int, kind: str) -> DataFrame:
    schema = f"query_id {clauses.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double"
    rows = clauses.toArrow()  # at most about SENT_TERMS terms
    if not rows.num_rows:
        return blocks.sparkSession.createDataFrame([], schema)
    id_type = rows.schema.field("query_id").type
    by_question: dict[str, dict] = {}
    for r in rows.to_pylist():
        by_question.setdefault(r["config"], {}).setdefault(r["query_id"], []).append(Clause(tuple(r["terms"]), tuple(r["offsets"]), r["negated"]))
    names = list(dict.fromkeys(q for asked in by_question.values() for q in asked))
    number, configs = {q: n for n, q in enumerate(names)}, {}
    for config, questions in by_question.items():
        asked = _Asked()
        for q, found in questions.items():
            asked.add(number[q], found)
        pairs = np.array(sorted(asked.plain), np.int64).reshape(-1, 2)
        configs[config] = (asked, (pairs[:, 0], pairs[:, 1]))
    sent = blocks.sparkSession.sparkContext.broadcast((names, configs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, configs = sent.value
        best, chunk_type = _Best(len(names), k), None
        for batch in batches:
            chunk_type = batch.column("chunk_ids").type.value_type
            for row, config in enumerate(batch.column("config").to_pylist()):
                if config in configs:
                    _search_block(batch, row, *configs[config], best)
        if chunk_type is not None:
            found = [(q, -score, key) for q, held in enumerate(best.held) for score, _, key in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[f[0]] for f in found], id_type), pa.array([f[2] for f in found], chunk_type), pa.array([f[1] for f in found], pa.float64())],
                ["query_id", "chunk_id", "score"])

    needed = _BLOCK_NAMES if any(asked.composed for asked, _ in configs.values()) else _BLOCK_NAMES[:-2]
    return blocks.select(*needed).mapInArrow(run, schema)


def search_blocks(blocks: DataFrame, clauses: DataFrame, k: int = CANDIDATES_PER_BRANCH, sent_terms: int = SENT_TERMS) -> DataFrame:
    """The ``k`` best chunks of every question as ``(query_id, chunk_id, score, rank)``, ties to the smaller chunk id.

    ``blocks`` come from ``block_index`` and ``clauses`` from ``parse_questions``, with the same analysis. A clause is
    enough to match. Without phrases and negation every occurrence counts its weight; positions are read only with them. A chunk
    that matches by lacking a term alone has the score 0.

    Questions of more than ``sent_terms`` terms in all are put in several parts, over blocks that are stored first.
    """
    kind = blocks.schema["chunk_ids"].dataType.elementType.simpleString()
    total = clauses.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = 1 if total <= sent_terms else -(-2 * total // sent_terms)
    if parts > 1:
        blocks, clauses = durable(blocks), durable(clauses)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    found = reduce(DataFrame.unionByName, [_search(blocks, clauses.where(part == n) if parts > 1 else clauses, k, kind) for n in range(parts)])
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc_nulls_last("chunk_id")], k)


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """A table of words with the column ``stem``."""
    @F.pandas_udf("string")
    def stemmed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else french_stem(w))

    return words.withColumn("stem", stemmed(word))


def words_of(text: Column) -> Column:
    """Lower-case words of a text, cut as the index cuts them."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
