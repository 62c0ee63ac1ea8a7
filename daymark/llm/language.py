"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with an elastic-net penalty, which leaves
most of them zero, and a temperature fitted on rows kept out of that training turns the largest
class score into a probability.

Document frequencies count every training document. The regression itself is fitted on a bounded,
repeatable sample (``rows_per_language``), as its weights stop changing long before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import (
    code_points,
    collected_rows,
    count_rows,
    gram_codes,
    letter_table,
    map_rows,
    slices,
    sum_counts,
    tally,
    with_scores,
)

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Hashes that order the rows of a sample.
HASHES = 1 << 62


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    #: One row per code, one column per language.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def grams(text: str | None) -> np.ndarray | None:
    """Codes of all character n-grams; None without a letter.

    Letters are lower-cased and every stretch of other characters becomes one space, so that
    digits, symbols and layout say nothing about the language.
    """
    if not text:
        return None
    points = code_points(text.lower())
    letters = letter_table()[points]
    if not letters.any():
        return None
    before = np.concatenate(([True], letters[:-1]))
    points = np.where(letters, points, np.uint32(32))[letters | before]
    points = np.concatenate((np.uint32([32]), points, np.uint32([32])))
    return np.concatenate(gram_codes(points, ORDERS, BITS))


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct codes and dampened counts."""
    codes = grams(text)
    if codes is None:
        return None
    codes, counts = tally(codes)
    return codes, 1.0 + np.log(counts)


def weigh(codes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf[codes]
    return x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Number of documents that hold each code; every text is read whole."""

    def count(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                codes = grams(value)
                if codes is not None:
                    counts[tally(codes)[0]] += 1
        yield count_rows(counts)

    return sum_counts(docs.select(text).mapInArrow(count, "code long, n long"), 1 << BITS)


def fit_sample(docs: DataFrame, id_column: str, text: str, lang: str, rows: int) -> list:
    """Vectors of at most ``rows`` documents of each language, those of smallest id hash."""
    # One row a language reaches the driver.
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    if not sizes:
        return []
    # A share of the hashes that holds about twice the wanted rows, in steps far finer than any table
    # has rows; then the smallest hashes of each language, of which a task keeps only as many.
    order = F.pmod(F.xxhash64(F.col(id_column), F.lit("language")), F.lit(HASHES))
    wanted = 2 * rows + 200
    shares = {k: min(HASHES, HASHES * wanted // n + 1) for k, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col(lang)]
    near = docs.select(order.alias("h"), F.col(lang).alias("lang"), F.col(text).alias("body")).filter(F.col("h") < share)
    place = Window.partitionBy("lang").orderBy("h", F.length("body"))
    near = near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= 2 * wanted)

    def vectors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [vector(v) for v in batch.column(2).to_pylist()]
            keep = [i for i, v in enumerate(found) if v is not None]
            part = batch.take(pa.array(keep, pa.int64()))
            yield (
                part.column(0),
                part.column(1),
                [found[i][0] for i in keep],
                [found[i][1].astype(np.float32) for i in keep],
            )

    picked = map_rows(near.select("h", "lang", "body"), vectors, "h long, lang string, codes array<int>, counts array<float>")
    found = collected_rows(picked.toArrow(), "lang", "h", "codes", "counts")
    kept, seen = [], dict.fromkeys(shares, 0)
    for language, _, codes, counts in sorted(found, key=lambda r: (r[1], r[0], len(r[2]), r[2].tobytes())):
        if seen[language] < rows:
            seen[language] += 1
            kept.append((language, codes, counts))
    return kept


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (codes, values, class) rows, taken in the given order.

    Each coordinate keeps the sum z of its adjusted gradients and the sum n of their squares; its
    weight is zero while |z| is below ``l1``.
    """
    z = np.zeros(((1 << BITS) + 1, classes))
    n = np.zeros_like(z)

    def solve(zs, ns):
        return np.where(
            np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        )

    for _ in range(epochs):
        for codes, values, target in rows:
            at, x = np.append(codes, 1 << BITS), np.append(values, 1.0)
            za, na = z[at], n[at]
            w = solve(za, na)
            p = softmax(x @ w)
            p[target] -= 1.0
            g = x[:, None] * p[None, :]
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / alpha * w
            n[at] = grown
    w = solve(z, n)
    return w[:-1], w[-1]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def fit_temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the class scores that gives held-back rows the highest likelihood."""
    if not len(scores):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), targets])

    grid = np.linspace(-3.0, 3.0, 121)
    return float(np.exp(min(grid, key=loss)))


def train(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 800
) -> LanguageModel | None:
    """Fit on rows with a language; None if no row has both a language and a letter.

    ``rows_per_language`` bounds the labelled rows the regression sees: three quarters train it,
    the rest fit the temperature. Document frequencies count all rows of ``docs``.
    """
    known = docs.filter(F.col(lang).isNotNull())
    sample = fit_sample(known, id_column, text, lang, rows_per_language)
    if not sample:
        return None
    frequencies = document_frequencies(known, text)
    idf = np.log((1.0 + frequencies.max()) / (1.0 + frequencies)) + 1.0
    idf[frequencies == 0] = 0.0
    languages = sorted({r[0] for r in sample})
    index = {k: i for i, k in enumerate(languages)}
    rows = [(codes, weigh(codes, counts, idf), index[k]) for k, codes, counts in sample]
    held = [i % 4 == 3 and len(rows) > 20 for i in range(len(rows))]
    weights, bias = train_ftrl([r for r, h in zip(rows, held) if not h], len(languages))
    back = [r for r, h in zip(rows, held) if h]
    scores = np.array([x @ weights[c] + bias for c, x, _ in back]).reshape(-1, len(languages))
    temperature = fit_temperature(scores, np.array([t for *_, t in back], np.int64))
    return LanguageModel(
        languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), temperature
    )


def predict(text: str | None, model: LanguageModel | None) -> tuple[str, float]:
    found = vector(text) if model else None
    if found is None:
        return UNKNOWN, 0.0
    codes, counts = found
    p = softmax((weigh(codes, counts, model.idf) @ model.weights[codes] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(min(1.0, p[best]))


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    text: str = "text",
    keep: list[str] | None = None,
    added: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Add ``lang_pred`` and ``score``, or other names, to every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is every row without a
    model. Of equally likely languages the first by name is predicted. ``keep`` names the columns
    returned beside them (all by default); columns called like an added one are replaced.
    """
    return with_scores(
        docs, lambda value: predict(value, model), f"{added[0]} string, {added[1]} double", text, keep
    )
