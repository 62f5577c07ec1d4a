"""Sequence decoding: the best label path through emission and transition scores."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def best_path(scores: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[list[int], float]:
    """scores: a row per token, a column per label; moves[i, j]: score of label j after i. Ties go to the lesser label."""
    if not len(scores):
        return [], 0.0
    best = scores[0] + (0 if start is None else start)
    came = []
    for row in scores[1:]:
        through = best[:, None] + moves
        came.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    if end is not None:
        best = best + end
    path = [int(best.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1], float(best.max())


def decode(df: DataFrame, scores: str, labels: list[str], moves: list[list[float]]) -> DataFrame:
    """df with path (labels of the best path) and path_score. scores: array<array<double>>, null or empty for no tokens.

    Forbidden moves score -inf. Works on Arrow batches.
    """
    table = np.array(moves, dtype=float)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(np.array(x or [], dtype=float).reshape(-1, len(labels)), table) for x in batch.column(scores).to_pylist()]
            paths = pa.array([[labels[i] for i in p] for p, _ in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, paths, pa.array([s for _, s in found], pa.float64())], names=[*batch.schema.names, "path", "path_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "path array<string>, path_score double"])
    return df.mapInArrow(each, schema)
