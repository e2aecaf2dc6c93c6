"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, learnt from document labels.

A sentence's logit is a constant, less a learnt multiple of the logarithm of the document's number of sentences, plus the
learnt weights of its distinct words.  The logarithm keeps many harmless sentences from adding up to a toxic document.  A
word's weight is the sum over its hashed features, itself and the first four to seven letters of a longer word, so that inflected forms share what is
learnt.  A document is toxic with
probability ``1 - prod(1 - p_sentence)``; the gradient of the document likelihood reaches the sentences through it, so
only document labels are needed, and afterwards the sentences with the highest probability are the offending ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.shared import sample_labelled

BITS = 18
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    spread: float = 0.0


def _features(word: str) -> list[int]:
    low = word.lower()
    forms = [low] + [f"{low[:k]}~" for k in (4, 5, 6, 7) if len(low) > k]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in forms]


class _Memo(dict):
    """What a function gives for each word, remembered up to a bound."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        value = self[word] = self.function(word)
        return value


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has words."""
    return [(*m.span(), found) for m in _SENTENCE.finditer(text or "") if (found := set(_WORD.findall(m[0])))]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label",
        per_class: int = 2500, max_chars: int = 500_000, total_chars: int = 6_000_000, **options) -> ToxicityModel:
    """Train on at most ``per_class`` labelled texts and ``total_chars`` characters of each class, none over ``max_chars``
    (bounds of the sample alone), chosen by a hash of the key.  Null labels and empty texts are left out; repeated rows
    count again; without texts of both classes the model knows no words.  ``options`` go to ``train``."""
    got = sample_labelled(docs, labels, key, text, label, per_class, max_chars, total_chars)
    return train([r.t for r in got], [r.y for r in got], **options)


def train(texts: list[str], labels: list[int], *, min_docs: int = 5, epochs: int = 80, rate: float = 0.1, ridge: float = 1e-4) -> ToxicityModel:
    """Fit by gradient steps on all texts at once.  Features of fewer than ``min_docs`` texts get no weight, as they would
    only learn single documents by heart."""
    memo = _Memo(_features)
    sent_doc, sent_of, word_of, sents = [], [], [], 0
    for d, t in enumerate(texts):
        for _, _, found in sentences(t):
            ids = [i for w in found for i in memo[w]]
            sent_doc.append(d)
            sent_of.append(np.full(len(ids), sents, np.int32))
            word_of.append(np.array(ids, np.int32))
            sents += 1
    w, b = np.zeros(1 << BITS), -4.0
    if not sents or len(set(labels)) < 2:
        return ToxicityModel(w, b)
    sent_doc, sent_of, word_of = np.array(sent_doc, np.int32), np.concatenate(sent_of), np.concatenate(word_of)
    y = np.array(labels, float)
    pairs = np.unique(word_of.astype(np.int64) * len(y) + sent_doc[sent_of]) // len(y)
    known, in_docs = np.unique(pairs, return_counts=True)
    often = np.zeros(1 << BITS, bool)
    often[known[in_docs >= min_docs]] = True
    sent_of, word_of = sent_of[often[word_of]], word_of[often[word_of]]
    used, word_at = np.unique(word_of, return_inverse=True)
    many = np.log(np.maximum(1, np.bincount(sent_doc, minlength=len(y))))[sent_doc]
    v, m1, m2 = np.zeros(len(used) + 2), np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    v[-2:] = b, 0.5
    for step in range(1, epochs + 1):
        z = np.bincount(sent_of, v[word_at], sents) + v[-2] - v[-1] * many
        p = _sigmoid(z)
        clean = np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        doc = np.clip(1 - np.exp(clean), 1e-6, 1 - 1e-9)
        gz = p * (1 - y / doc)[sent_doc] / len(y)
        g = np.concatenate([np.bincount(word_at, gz[sent_of], len(used)) + ridge * v[:-2], [gz.sum(), -(gz * many).sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        v[-1] = max(v[-1], 0.0)
    w[used] = v[:-2]
    return ToxicityModel(w, float(v[-2]), float(v[-1]))


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", at_least: float = 0.5) -> DataFrame:
    """(key, score, n_sentences, worst_start, worst_end, offending): the document's probability, the most likely
    sentence (code points, end exclusive, null without one; the first of equal ones) and the spans of all sentences scored
    ``at_least`` so.

    Each row is scored on its own and whole: null, empty and wordless texts get 0, repeated rows the same score; an empty
    table gives none; other columns play no part, whatever their names."""
    schema = T.StructType([
        docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()),
        T.StructField("worst_start", T.LongType()), T.StructField("worst_end", T.LongType()), T.StructField("offending", T.StringType()),
    ])

    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float64), model.bias, model.spread))  # 2 MB, fixed

    def run(batches):
        w, b, spread = shared.value
        memo = _Memo(lambda word: float(w[_features(word)].sum()))
        for pdf in batches:
            out = []
            for t in pdf[text]:
                parts = sentences(t)
                if not parts:
                    out.append((0.0, 0, None, None, ""))
                    continue
                p = _sigmoid(np.array([sum([memo[x] for x in found]) for _, _, found in parts]) + b - spread * np.log(len(parts)))
                k = int(p.argmax())
                bad = ",".join(f"{parts[i][0]}:{parts[i][1]}" for i in np.flatnonzero(p >= at_least))
                out.append((float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), len(parts), parts[k][0], parts[k][1], bad))
            got = pd.DataFrame(out, columns=["score", "n_sentences", "worst_start", "worst_end", "offending"])
            got.insert(0, key, pdf[key].to_numpy())
            yield got.astype({"worst_start": "Int64", "worst_end": "Int64"})

    return docs.select(key, text).mapInPandas(run, schema)
