"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the character n-grams inside
them, all hashed into one table; a softmax over that average gives the classes. Vectors and output
are trained together by stochastic gradient descent in numpy on a bounded, repeatable sample of
labelled rows. As the output is linear in the average, scoring first multiplies table and output,
so that each code costs one number instead of one vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import (
    code_points,
    collected_rows,
    gram_codes,
    map_rows,
    runs,
    smallest_hashes,
    space_table,
    tally,
    with_scores,
    word_hashes,
)

BITS = 16
ORDERS = (2, 3, 4)
DIMENSIONS = 16


@dataclass
class QualityModel:
    #: Log-odds of class 1 that each code adds to the average, and of a document without codes.
    odds: np.ndarray
    prior: float


def subwords(text: str | None) -> np.ndarray:
    """Codes of the words of a whole text and of the n-grams inside them, word ends included.

    Case and punctuation stay, as they tell junk from prose. Null, empty and blank texts have none.
    """
    if not text:
        return np.empty(0, np.uint32)
    points = code_points(text)
    blank = space_table()[points]
    starts, ends = runs(~blank)
    words = (word_hashes(points, starts, ends) >> np.uint64(64 - BITS)).astype(np.uint32)
    # One space between words and at both ends marks where words begin and end.
    keep = ~blank | np.concatenate(([True], ~blank[:-1]))
    points = np.where(blank, np.uint32(32), points)[keep]
    points = np.concatenate((np.uint32([32]), points, np.uint32([32])))
    inner = np.concatenate(([0], np.cumsum(points == 32)))
    found = [words]
    for n, codes in zip(ORDERS, gram_codes(points, ORDERS, BITS)):
        # No space strictly inside the n-gram.
        whole = inner[n - 1 : n - 1 + len(codes)] == inner[1 : 1 + len(codes)]
        found.append(codes[whole])
    return np.concatenate(found)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, shares, class) of at most ``rows`` labelled documents, in a repeatable order."""
    picked = smallest_hashes(labels.filter(F.col(label).isNotNull()), id_column, label, rows)
    if not picked:
        return []
    spark = docs.sparkSession
    # At most ``rows`` ids: the only table that is broadcast, and bounded by that parameter.
    chosen = spark.createDataFrame([(r[0], int(r[1])) for r in picked], "id long, target int")
    joined = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body")).join(
        F.broadcast(chosen), "id"
    )

    def features(batches):
        for batch in batches:
            found = [tally(subwords(v)) for v in batch.column(1).to_pylist()]
            yield [
                batch.column(0),
                batch.column(2),
                [c.astype(np.int32) for c, _ in found],
                [(n / max(1, n.sum())).astype(np.float32) for _, n in found],
            ]

    table = map_rows(
        joined.select("id", "body", "target"),
        features,
        "id long, target int, codes array<int>, shares array<float>",
    ).toArrow()
    out = collected_rows(table, "id", "target", "codes", "shares")
    out.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    order = np.random.default_rng(1).permutation(len(out))
    return [out[i][1:] for i in order if len(out[i][2])]


def train_sgd(
    rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 0.5, decay: float = 1e-5
) -> QualityModel:
    """Vectors and output from (class, codes, shares) rows; the step falls linearly to zero."""
    rng = np.random.default_rng(0)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    positive = (sum(t for t, *_ in rows) + 1.0) / (len(rows) + 2.0)
    bias = np.array([np.log(1 - positive), np.log(positive)], np.float32)
    total, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for target, codes, shares in rows:
            step = np.float32(rate * (1 - done / total))
            done += 1
            vectors = table[codes]
            mean = shares @ vectors
            scores = output @ mean + bias
            error = np.exp(scores - scores.max())
            error /= error.sum()
            error[target] -= 1.0
            back = error @ output
            output -= step * (np.outer(error, mean) + np.float32(decay) * output)
            bias -= step * np.float32(0.05) * error
            # Scaled up, as each code holds a small share of its document.
            table[codes] = vectors - (step * np.float32(20.0)) * shares[:, None] * back[None, :]
    odds = table @ (output[1] - output[0])
    return QualityModel(odds.astype(np.float32), float(bias[1] - bias[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_fit_rows: int = 6000,
) -> QualityModel:
    """Fit on at most ``max_fit_rows`` labelled rows, those of smallest id hash.

    Null labels and texts without a word are left out. Without any label every score is one half.
    """
    rows = labelled_sample(docs, labels, id_column, text, label, max_fit_rows)
    if not rows:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0)
    return train_sgd(rows)


def probability(text: str | None, model: QualityModel) -> float:
    """Probability of class 1; the training share of class 1 for a text without a word."""
    codes = subwords(text)
    score = model.prior + (float(model.odds[codes].mean()) if len(codes) else 0.0)
    return float(1 / (1 + np.exp(-score)))


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None
) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to every row.

    Null, empty and blank texts get the training share of class 1. ``keep`` names the columns
    returned beside them (all by default); columns with those two names are replaced.
    """

    def one(value):
        p = probability(value, model)
        return p, int(p >= threshold)

    return with_scores(docs, one, "score double, predicted int", text, keep)
