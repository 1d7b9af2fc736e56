"""Models behind a batch interface, and stand-ins for models, which are not available offline: deterministic, and of
no quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import strip


def _made(make: Callable, fallback: Callable | None) -> Callable:
    """make(), or where that fails fallback(); without a fallback the failure is raised."""
    if fallback is None:
        return make()
    try:
        return make()
    except Exception:  # whatever keeps a model from being made
        return fallback()


def _checked(vectors: object, n: int, dim: int, unit: bool) -> np.ndarray:
    out = np.asarray(vectors, np.float32)
    if out.shape != (n, dim):
        raise ValueError(f"a model gave vectors of the shape {out.shape}, not {(n, dim)}")
    if not np.isfinite(out).all():
        raise ValueError("a model gave vectors that aren't finite")
    if unit and n and np.abs(np.sqrt((out.astype(np.float64) ** 2).sum(1)) - 1).max() > 1e-3:
        raise ValueError("a model gave vectors that aren't of length one")
    return out


def batch_embedder(make: Callable[[], Callable[[list[str]], object]], dim: int, batch_size: int = 16, fallback: Callable | None = None, unit: bool = True):
    """A column function from texts to vectors (array of floats) by a model that make() loads, once in each Python worker.

    The model is given lists of up to batch_size texts, a null text as an empty one, and has to give so many vectors of dim
    finite numbers (unit: of length one); else the job fails. fallback makes the model where make fails.
    """

    def predict_fn() -> Callable[[np.ndarray], np.ndarray]:
        model = _made(make, fallback)

        def predict(texts: np.ndarray) -> np.ndarray:
            given = ["" if t is None else str(t) for t in texts.ravel()]
            return _checked(model(given), len(given), dim, unit)

        return predict

    return predict_batch_udf(predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def batch_scorer(make: Callable[[], Callable[[list[str], list[str]], object]], batch_size: int = 16, fallback: Callable | None = None):
    """A column function from pairs of texts (question, passage) to scores by a model that is loaded once in each
    Python worker, such as a cross-encoder. A null text is an empty one; NaN is kept as a failed score."""

    def predict_fn() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = _made(make, fallback)

        def predict(questions: np.ndarray, passages: np.ndarray) -> np.ndarray:
            a, b = (["" if t is None else str(t) for t in x.ravel()] for x in (questions, passages))
            out = np.asarray(model(a, b), np.float64)
            if out.shape != (len(a),):
                raise ValueError(f"a model gave scores of the shape {out.shape} for {len(a)} pairs")
            return out

        return predict

    return predict_batch_udf(predict_fn, return_type=T.DoubleType(), batch_size=batch_size)


def hash_embedder(dim: int = 64):
    """STAND-IN for an embedding model: unit vectors from hashed words."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                vector = np.zeros(dim)
                for word in (text or "").lower().split():
                    h = int.from_bytes(word.encode("utf-8", "surrogatepass")[-8:], "little") * 0x9E3779B97F4A7C15 % (1 << 64)
                    vector[h % dim] += 1 if h >> 63 else -1
                norm = np.sqrt((vector * vector).sum()) or 1.0
                out.append((vector / norm).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return embed


def hypothetical_text(snippet: Column, question: Column) -> Column:
    """A rewritten query for the dense leg; a missing or blank rewrite falls back on the question."""
    return F.coalesce(F.nullif(strip(snippet), F.lit("")), question)


def extractive_answer(question: Column, context: Column) -> Column:
    """STAND-IN for a language model: the first block's first line, cited."""
    first = F.split_part(F.split_part(context, F.lit("\n\n---\n\n"), F.lit(1)), F.lit("\n"), F.lit(2))
    return F.when(context == "", F.lit("")).otherwise(F.concat(first, F.lit(" [1]")))
