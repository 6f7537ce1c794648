"""Vectors for a text column, with a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import PASSAGE_PREFIX
from lamina.operators.slices import text_slices

HASH_DIM = 256
# Terms a worker remembers the cell of.
_REMEMBERED = 200_000


def hashing_encoder(dim: int = HASH_DIM) -> Callable[[list[str]], np.ndarray]:
    """Term counts hashed into ``dim`` cells: the encoder used when no model is at hand."""
    word = re.compile(r"\w+")
    known: dict[str, int] = {}

    def cell(term: str) -> int:
        found = known.get(term)
        if found is None:
            if len(known) >= _REMEMBERED:
                known.clear()
            digest = hashlib.md5(term.encode()).hexdigest()
            found = known[term] = int(digest[:8], 16) % dim
        return found

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for row, text in enumerate(texts):
            cells = [cell(term) for term in word.findall(text.lower())]
            if cells:
                out[row] = np.bincount(cells, minlength=dim)
        return out

    return encode


def embed_batch(
    df: DataFrame, text: str, output: str = "embedding", *, prefix: str = PASSAGE_PREFIX,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder,
    expected_dim: int = HASH_DIM,
) -> DataFrame:
    """Add an L2-normalised vector of ``prefix + text``.

    ``encoder`` is called once per Python worker and returns the function that turns a list of
    texts into a matrix; a vector of another width than ``expected_dim`` fails the job. A text
    without a single term has no direction and keeps a NULL vector.
    """

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder()
        for batch in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for begin, end in text_slices(batch):
                texts = batch.slice(begin, end - begin).to_pylist()
                matrix = np.asarray(encode([prefix + (t or "") for t in texts]), dtype=np.float64)
                if matrix.shape[1] != expected_dim:
                    raise ValueError(f"encoder gave {matrix.shape[1]} dimensions, not {expected_dim}")
                norm = np.linalg.norm(matrix, axis=1)
                unit = (matrix / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)
                held = norm > 0
                edges = np.r_[0, np.cumsum(held * expected_dim)].astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(unit[held].ravel()), mask=pa.array(~held)))
            yield pa.concat_arrays(parts)

    # As a nondeterministic function it is evaluated once: a later test of the vector is not
    # pushed below it, where it would need the encoder a second time.
    return df.withColumn(output, vectors.asNondeterministic()(F.col(text)))
