"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its potential is linear in the features of the line and of its two
neighbours; a 2 x 2 transition links successive lines. Forward-backward gives each line's marginal
chance of being good, and their mean weighted by line length is the document's score. Weights are
fitted by gradient ascent on labelled documents, whose label holds for all of their lines.

Only the fit uses a bounded sample (``Training.documents`` labelled documents, whole); scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import ship_package

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".?;:", b",", bytes([9, 10, 11, 12, 13, 32])]
_CLASS = np.zeros(256, np.int64)  # 0: letters and all else
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS[list(_chars)] = _k
FEATURES = ("bias", "words", "capitals", "digits", "symbols", "exclamations", "stops", "commas", "word length", "variety",
            "repeated", "ended", "repeats")
N = len(FEATURES)
WIDTH = 3 * N  # the line, the one before, the one after


@dataclass(frozen=True)
class Training:
    documents: int = 5000   # most labelled documents used, those of the smallest id hashes
    rounds: int = 300
    rate: float = 0.1
    l2: float = 0.0002


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray   # WIDTH: log-odds of good
    stay: np.ndarray      # log-odds of staying in a bad and in a good line


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with neighbours, line lengths in bytes, lines per text) of all lines with a word.

    A text without a word counts as one line of length 1 without features but the bias.
    """
    lines, words, unique, seen_before, counts = [], [], [], [], []
    for text in texts:
        seen, n = set(), 0
        for line in (text or "").encode("utf-8", "replace").split(b"\n"):
            ws = line.split()
            if not ws:
                continue
            lines.append(line)
            words.append(len(ws))
            unique.append(len(set(ws)))
            seen_before.append(line in seen)
            seen.add(line)
            n += 1
        if not n:
            lines.append(b" ")
            words.append(0)
            unique.append(0)
            seen_before.append(False)
        counts.append(max(n, 1))
    length = np.array([len(x) for x in lines], np.int64)
    kind = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    k = len(_CLASSES) + 1
    per = np.bincount(np.repeat(np.arange(len(lines)) * k, length) + kind, minlength=len(lines) * k).reshape(-1, k)
    w = np.array(words, float)
    some = np.maximum(w, 1)
    printed = np.maximum(length - per[:, 7], 1)
    own = np.empty((len(lines), N))
    own[:, 0] = 1
    own[:, 1] = np.log1p(w) / 5
    own[:, 2] = per[:, 1] / printed
    own[:, 3] = per[:, 2] / printed
    own[:, 4] = np.minimum(per[:, 3] / printed * 5, 2)
    own[:, 5] = np.minimum(per[:, 4] / some * 2, 2)
    own[:, 6] = np.minimum(per[:, 5] / some, 2)
    own[:, 7] = np.minimum(per[:, 6] / some, 2)
    own[:, 8] = np.minimum(printed / some / 10, 2)
    own[:, 9] = np.array(unique) / some
    own[:, 10] = seen_before
    own[:, 11] = [x.rstrip()[-1:] in b".!?" and x.rstrip() != b"" for x in lines]
    own[:, 12] = np.log1p(w - np.array(unique)) / 5
    own[w == 0, 1:] = 0
    counts = np.array(counts, np.int64)
    ends = np.cumsum(counts)
    before, after = np.vstack([np.zeros((1, N)), own[:-1]]), np.vstack([own[1:], np.zeros((1, N))])
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return np.hstack([own, before, after]), length, counts


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences ordered by length, longest first: their first rows, and how many are still running at each step."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    running = [int(n) for n in np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), "right")]
    return order, first, running


def _logistic_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(odds: np.ndarray, counts: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the chance of good; per line the chances that it and the line before are both bad, or both good
    (0 for first lines); per sequence the log of the partition sum. ``odds`` are the lines' potentials for good."""
    order, first, running = _steps(counts)
    a = np.zeros((len(odds), 2))  # forward logs: bad, good
    b = np.zeros((len(odds), 2))  # backward logs
    for t, n in enumerate(running):
        r = first[:n] + t
        if t == 0:
            a[r, 1] = odds[r]
        else:
            p = a[r - 1]
            a[r, 0] = _logistic_sum(p[:, 0] + stay[0], p[:, 1])
            a[r, 1] = _logistic_sum(p[:, 0], p[:, 1] + stay[1]) + odds[r]
    for t in range(len(running) - 2, -1, -1):
        r = first[:running[t + 1]] + t
        q0, q1 = b[r + 1, 0], b[r + 1, 1] + odds[r + 1]
        b[r, 0] = _logistic_sum(q0 + stay[0], q1)
        b[r, 1] = _logistic_sum(q0, q1 + stay[1])
    total = _logistic_sum(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    good = np.exp(a[:, 1] + b[:, 1] - total)
    pairs = np.zeros((len(odds), 2))
    inner = np.ones(len(odds), bool)
    inner[np.cumsum(counts) - counts] = False
    r = np.flatnonzero(inner)
    pairs[r, 0] = np.exp(a[r - 1, 0] + stay[0] + b[r, 0] - total[r])
    pairs[r, 1] = np.exp(a[r - 1, 1] + stay[1] + odds[r] + b[r, 1] - total[r])
    return good, pairs, total[np.cumsum(counts) - 1]


def fit(texts: list[str], labels: np.ndarray, how: Training) -> LineModel:
    """Maximum likelihood with an L2 penalty, by Adam over all sequences at once."""
    x, _, counts = line_features(texts)
    y = np.repeat(labels.astype(float), counts)
    later = np.ones(len(y), bool)
    later[np.cumsum(counts) - counts] = False
    theta = np.zeros(WIDTH + 2)
    theta[WIDTH:] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = np.repeat(1 / counts, counts)  # every document weighs the same
    observed = np.concatenate([x.T @ (y * scale), [(scale * later * (1 - y)).sum(), (scale * later * y).sum()]])
    for k in range(1, how.rounds + 1):
        good, pairs, _ = marginals(x @ theta[:WIDTH], counts, theta[WIDTH:])
        expected = np.concatenate([x.T @ (good * scale), (pairs * scale[:, None]).sum(axis=0)])
        step = (observed - expected) / len(counts) - how.l2 * theta
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        theta = theta + how.rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return LineModel(theta[:WIDTH], theta[WIDTH:])


def scores(texts: list[str | None], model: LineModel) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x, length, counts = line_features(texts)
    good, _, _ = marginals(x @ model.weights, counts, model.stay)
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts), 0, 1)


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> LineModel:
    """Fit on labelled documents; the sample's ids are chosen first, so only its texts travel.

    Labels must be 0 or 1; others and nulls are left out, as are ids that are null or without a document. Without any usable
    label the model scores every text 0.5.
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
              .orderBy(F.xxhash64("__id"), "__id", "__label").limit(how.documents))
    sample = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
              .orderBy(F.xxhash64("__id"), "__label", "__text").limit(how.documents).collect())
    if not sample:
        return LineModel(np.zeros(WIDTH), np.zeros(2))
    return fit([r["__text"] for r in sample], np.array([r["__label"] for r in sample]), how)


def score_column(model: LineModel, text: Column) -> Column:
    """A document's score between 0 and 1, higher for better."""
    def score(texts: pd.Series) -> pd.Series:
        out = [scores(texts.iloc[at:at + 256].tolist(), model) for at in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return F.pandas_udf(score, "double")(text)


def keep_above(docs: DataFrame, labels: DataFrame, threshold: float, how: Training = Training(), id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns as they are."""
    ship_package(docs.sparkSession)
    model = train(docs, labels, how, id_col, text_col, label_col)
    return docs.where(score_column(model, F.col(text_col)) >= threshold)


def score_documents(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents with a score column added (replaced, if there is one).

    Defined cases: null, empty and blank texts are scored as one empty line; null ids, repeated rows and
    ties are scored row by row and alike; an empty table gives an empty result; other columns stay.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels, how, id_col, text_col, label_col)
    return docs.withColumn("score", score_column(model, F.col(text_col)))
