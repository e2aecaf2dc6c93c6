"""Quality classifier: how much better zstandard compresses a text with a dictionary of good text than of bad.

Two dictionaries are trained on bounded samples of labelled pieces.  A text is cut into pieces of ``PIECE`` characters
so that its own repetitions cannot outweigh the dictionaries; all pieces of the whole text count.  The difference of
the compressed sizes, divided by their sum, goes through a logistic curve fitted on other labelled pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import sample_labelled

#: Characters of a piece.
PIECE = 2048


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    level: int = 3

    def coders(self):
        return [zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(d)) for d in (self.good, self.bad)]


def _pieces(text: str) -> list[bytes]:
    return [text[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(text), PIECE)]


def _spread(pieces: list[bytes], most: int) -> list[bytes]:
    return pieces if len(pieces) <= most else [pieces[i * (len(pieces) - 1) // max(1, most - 1)] for i in range(most)]


def _features(text: str | None, coders) -> tuple[float, float, float]:
    """Difference over sum for all pieces, and of the best and the worst piece; zeros for an empty text."""
    if not text:
        return 0.0, 0.0, 0.0
    good, bad = coders
    sizes = np.array([(len(good.compress(p)), len(bad.compress(p))) for p in _pieces(text)], float)
    each = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 0] + sizes[:, 1])
    whole = (sizes[:, 1].sum() - sizes[:, 0].sum()) / sizes.sum()
    return whole, each.max(), each.min()


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a regularised logistic regression; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label",
        per_class: int = 2500, max_chars: int = 60_000, total_chars: int = 12_000_000, dict_pieces: int = 3,
        dict_bytes: int = 112_640) -> QualityModel:
    """Learn from ``docs`` whose key is in ``labels`` (label 1 good, 0 bad); rows with nulls or empty texts are left out.

    Bounds of the sample: ``per_class`` labelled texts and ``total_chars`` characters of each class, none over ``max_chars``
    characters.  Half of them train the dictionaries, a text with at most ``dict_pieces`` pieces spread evenly over it; the
    other half fit the curve, which is then shifted to the classes' own frequencies.  Repeated rows count again; without
    texts of both classes the curve is not fitted.
    """
    got = sample_labelled(docs, labels, key, text, label, per_class, max_chars, total_chars)
    dicts = []
    for y in (1, 0):
        parts = [p for r in got[::2] if r.y == y for p in _spread(_pieces(r.t), dict_pieces)] or [b" "]
        dicts.append(_dictionary(parts, dict_bytes))
    model = QualityModel(dicts[0], dicts[1], np.array([0.0, 1.0, 0.0, 0.0]))
    coders = model.coders()
    y = np.array([r.y for r in got[1::2]], float)
    if len(set(y)) == 2:
        model.weights = _logistic(np.array([_features(r.t, coders) for r in got[1::2]]) * 10, y)
        share = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
        drawn = y.sum() / (len(y) - y.sum())
        model.weights[0] += np.log(share[1] / share[0] / drawn)
    return model


def _dictionary(parts: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, parts).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their plain bytes serve as a raw dictionary
        return b"".join(parts)[-size:]


def score(docs: DataFrame, model: QualityModel, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, score), or with ``carry`` (key, text, carried columns, score): a double between 0 and 1 per row.

    Each row is scored on its own and whole.  A null text counts as an empty one; repeated rows get the same score; an empty
    table gives no rows.  Carried columns named ``score`` are replaced, other names do not matter.
    """
    rows = docs.select(key, text, *[c for c in carry or [] if c != "score"])
    schema = (rows if carry is not None else rows.select(key)).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        coders = model.coders()
        w = model.weights
        for batch in batches:
            x = np.array([_features(t.as_py(), coders) for t in batch.column(1)]).reshape(-1, 3) * 10
            z = np.clip(w[0] + x @ w[1:], -30, 30)
            kept = batch.columns if carry is not None else batch.columns[:1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-z)))], schema.names)

    return rows.mapInArrow(run, schema)
