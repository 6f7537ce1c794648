"""Semantic vectors learned from a corpus: its term counts in the directions that explain most of them.

A text is the counts of its terms in hashed cells, damped and weighted by how few texts have them. The directions are the leading
singular vectors of the matrix of all texts, found by a randomised range finder: random combinations of its columns
span nearly the same space, and every pass over the texts adds only a narrow matrix a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import PASSAGE_PREFIX, QUERY_PREFIX
from lamina.operators.fulltext import FRENCH, Analysis, analyser
from lamina.session import durable

CELLS = 1 << 14
#: Directions beyond the wanted ones that make up for what random combinations miss.
SPARE = 16
_BATCH_ROWS = 512


def _cells(text: str, analyse: Callable[[str | None], list[str | None]], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text and the damped counts of its terms there."""
    found = [zlib.crc32(t.encode()) % cells for t in analyse(text) if t is not None]
    at, counts = np.unique(np.array(found, np.int64), return_counts=True)
    return at, 1 + np.log(counts)


class SemanticModel:
    """Cell weights and directions (cells by dimensions); ``encoder`` is what ``embed_batch`` takes."""

    def __init__(self, weights: np.ndarray, directions: np.ndarray, strengths: np.ndarray, analysis: Analysis):
        self.weights, self.directions, self.strengths, self.analysis = weights, directions, strengths, analysis

    @property
    def dim(self) -> int:
        return self.directions.shape[1]

    def encoder(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        """A function that makes the encoder, once per worker. Prefixes of passages and queries carry no meaning here and go."""
        model = self

        def make() -> Callable[[list[str]], np.ndarray]:
            analyse = analyser(model.analysis)

            def encode(texts: list[str]) -> np.ndarray:
                out = np.zeros((len(texts), model.dim))
                for row, text in enumerate(texts):
                    at, counts = _cells(text.removeprefix(PASSAGE_PREFIX).removeprefix(QUERY_PREFIX), analyse, len(model.weights))
                    weighted = counts * model.weights[at]
                    norm = np.sqrt(weighted @ weighted)
                    if norm > 0:
                        out[row] = (weighted / norm) @ model.directions[at]
                return out

            return encode

        return make


def _counted(texts: DataFrame, column: str, analysis: Analysis, cells: int) -> DataFrame:
    """Rows (at, counts) of every text with a term: what all passes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyse = analyser(analysis)
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH_ROWS):
                rows = [_cells(t, analyse, cells) for t in whole.column(0).slice(begin, _BATCH_ROWS).to_pylist() if t]
                rows = [r for r in rows if len(r[0])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                    ["at", "counts"])

    return texts.select(F.col(column).cast("string")).mapInArrow(run, "at array<int>, counts array<double>")


def _gathered(rows: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the matrix A of all texts, unit rows: a task adds up one narrow matrix, in slices of cells."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, basis))  # cells times directions
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = sent.value
        total = np.zeros_like(basis)
        for batch in batches:
            for at, counts in zip(batch.column(0), batch.column(1), strict=True):
                cells, counted = at.values.to_numpy(), counts.values.to_numpy()
                row = counted * weights[cells]
                norm = np.sqrt(row @ row)
                if norm > 0:
                    row /= norm
                    total[cells] += np.outer(row, row @ basis[cells])
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * width, pa.int32()), pa.array(total[held].ravel()))],
            ["cell", "part"])

    parts = rows.mapInArrow(run, "cell int, part array<double>")
    columns = [f"x{n}" for n in range(width)]
    wide = parts.select("cell", *[F.get("part", F.lit(n)).alias(c) for n, c in enumerate(columns)])
    found = wide.groupBy("cell").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # at most one row a cell
    out = np.zeros_like(basis)
    if found.num_rows:
        out[found["cell"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in columns])
    return out


def fit_semantic(
    texts: DataFrame, column: str, dim: int = 64, cells: int = CELLS, analysis: Analysis = FRENCH, rounds: int = 3, seed: int = 42,
) -> SemanticModel:
    """A model from all texts of a column. Null and empty texts have no say; no texts at all give directions of zeros.

    ``rounds`` passes sharpen the range before the last one reads off the directions. The driver holds a few
    matrices of ``cells`` by ``dim`` and ``SPARE`` numbers, whatever the number of texts.
    """
    rows = durable(_counted(texts, column, analysis, cells))
    total = rows.count()
    holding = np.zeros(cells)
    for r in rows.select(F.explode("at").alias("cell")).groupBy("cell").count().collect():  # at most ``cells`` rows
        holding[r["cell"]] = r["count"]
    weights = np.where(holding > 0, np.log((1 + total) / (1 + holding)) + 1, 0.0)
    width = min(dim + SPARE, cells)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(cells, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_gathered(rows, weights, basis))[0]
    # The matrix A'A inside the range: its eigenvectors are the right singular vectors of A, up to signs.
    values, vectors = np.linalg.eigh(basis.T @ _gathered(rows, weights, basis))
    order = np.argsort(-values)[:dim]
    directions = basis @ vectors[:, order]
    signs = np.sign(directions[np.argmax(np.abs(directions), axis=0), np.arange(directions.shape[1])])
    strengths = np.sqrt(np.maximum(values[order], 0))
    return SemanticModel(weights, directions * np.where(signs == 0, 1, signs) * (strengths > 1e-9), strengths, analysis)
