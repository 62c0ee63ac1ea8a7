"""Toxicity: noisy-channel restoration of disguised words, then a sparse linear score.

A character trigram model counted over all texts is the source; the channel writes letters as
look-alike symbols, stretches them, and puts separators between them. Every span that shows one of
these marks becomes a lattice of readings, and the Viterbi path through it replaces the span. A span
without any mark has one reading only, itself, so it is not decoded. The restored text is scored by
logistic regression on the words it holds (follow-the-regularised-leader with an L1 penalty).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import (
    code_points,
    collected_rows,
    count_rows,
    letter_table,
    map_rows,
    runs,
    slices,
    smallest_hashes,
    space_table,
    sum_counts,
    with_scores,
    word_hashes,
)

#: Letters that a symbol may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Costs of the channel in nats: a symbol read as a letter, a symbol kept, a stretch shortened, a
#: separator dropped, a separator kept. Between spelled-out letters a gap wider than the others takes the
#: costs of a separator the other way round, and a closing sign of ``PUNCTUATION`` is kept at SEPARATE.
READ, KEPT, SHORTENED, DROPPED, SEPARATE = 0.7, 15.0, 1.0, 0.1, 3.0
PUNCTUATION = "!|("
#: A closing sign repeated more often than this is decoration.
CLOSING = 2

ALPHABET = 64
WORD_BITS = 20
#: Lengths of the word beginnings that are features beside the whole word.
STEMS = (3, 4, 5, 6, 7)
_EMAIL = re.compile(r"[^@]+@[^@]+\.[^@]+")


@lru_cache
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.bool_)
    table[[ord(c) for c in LOOKALIKES]] = True
    return table


@lru_cache
def alphabet_table() -> np.ndarray:
    """Code points as letters of the character model: 0 ends a word, a to z are 1 to 26."""
    points = np.arange(0x110000)
    other = 27 + points % (ALPHABET - 27)
    latin = (points >= 97) & (points <= 122)
    return np.where(latin, points - 96, np.where(letter_table(), other, 0)).astype(np.int64)


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of letter trigrams over every whole text; ``ALPHABET`` ** 3 numbers."""

    def count(batches):
        counts = np.zeros(ALPHABET**3, np.int64)
        for batch in slices(batches):
            joined = " ".join(v for v in batch.column(0).to_pylist() if v).lower()
            a = alphabet_table()[code_points(f"  {joined}  ")]
            # Stretches of breaks say nothing about words.
            a = a[np.concatenate(([True], (a[1:] > 0) | (a[:-1] > 0)))]
            a = np.concatenate(([0], a))
            codes = (a[:-2] * ALPHABET + a[1:-1]) * ALPHABET + a[2:]
            counts += np.bincount(codes, minlength=ALPHABET**3)
        yield count_rows(counts)

    return sum_counts(docs.select(text).mapInArrow(count, "code long, n long"), ALPHABET**3)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of each letter after two others, mixed over three orders."""
    tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1.0) / (uni.sum() + ALPHABET)
    p2 = (bi + 5.0 * p1) / (bi.sum(axis=1, keepdims=True) + 5.0)
    p3 = (tri + 5.0 * p2) / (tri.sum(axis=2, keepdims=True) + 5.0)
    return -np.log(p3).astype(np.float32).ravel()


@dataclass
class ToxicityModel:
    costs: np.ndarray
    weights: np.ndarray
    bias: float
    _decoder: Decoder | None = field(default=None, repr=False)

    def decoder(self) -> Decoder:
        if self._decoder is None:
            self._decoder = Decoder(self.costs)
        return self._decoder

    def __getstate__(self):
        return {**self.__dict__, "_decoder": None}


class Decoder:
    """Restores disguised words under one character model."""

    def __init__(self, costs: np.ndarray, remembered: int = 50_000):
        self.costs = costs.tolist()
        # Spans repeat; those of usual length are decoded once.
        self.short = lru_cache(remembered)(self.viterbi)

    def restore(self, text: str | None) -> str:
        """The lower-cased text with every marked span replaced by its likeliest reading."""
        if not text:
            return ""
        lower = text.lower()
        spans = marked_spans(code_points(lower))
        if not spans:
            return lower
        out, at = [], 0
        for start, end in spans:
            span = lower[start:end]
            out += [lower[at:start], (self.short if end - start <= 64 else self.viterbi)(span)]
            at = end
        return "".join([*out, lower[at:]])

    def viterbi(self, span: str) -> str:
        """Cheapest path through the span's lattice; the state is the last two letters."""
        if _EMAIL.fullmatch(span):
            return span
        edges = lattice(span)
        best: list[dict] = [{} for _ in range(len(span) + 1)]
        best[0][(0, 0)] = (0.0, None, "")
        for i, here in enumerate(best[:-1]):
            for (a, b), node in here.items():
                for j, output, cost in edges[i]:
                    total, x, y = node[0] + cost, a, b
                    for c in output:
                        k = letter(c)
                        if k or y:
                            total += self.costs[(x * ALPHABET + y) * ALPHABET + k]
                            x, y = y, k
                    old = best[j].get((x, y))
                    if old is None or total < old[0]:
                        best[j][(x, y)] = (total, node, output)
        closing = min(
            best[-1].items(),
            key=lambda kv: (kv[1][0] + (self.costs[(kv[0][0] * ALPHABET + kv[0][1]) * ALPHABET] if kv[0][1] else 0.0), kv[0]),
        )
        node, pieces = closing[1], []
        while node is not None:
            pieces.append(node[2])
            node = node[1]
        return "".join(reversed(pieces))


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else (27 + ord(c) % (ALPHABET - 27) if c.isalpha() else 0)


def lattice(span: str) -> list[list[tuple[int, str, float]]]:
    """For each position the readings that start there: (next position, text, channel cost)."""
    edges: list[list[tuple[int, str, float]]] = []
    n = len(span)
    stretch = 0
    single = [i % 2 == 0 for i in range(n)]
    spelled = n >= 5 and all(
        (c.isalpha() or c in LOOKALIKES) if s else not c.isalnum() for c, s in zip(span, single)
    )
    units = span.split()
    blanks = len(units) >= 3 and all(len(u) == 1 and (u.isalpha() or u in LOOKALIKES) for u in units)
    if blanks:
        widths = [len(g) for g in re.findall(r"\s+", span)]
        narrow = min(widths)
    tail = n
    while tail and not span[tail - 1].isalnum():
        tail -= 1
    gap = 0
    for i, c in enumerate(span):
        if c.isalpha():
            here = [(i + 1, c, 0.0)]
            if i == 0 or span[i - 1] != c or i >= stretch:
                stretch = i + 1
                while stretch < n and span[stretch] == c:
                    stretch += 1
                if stretch - i >= 3:
                    here += [(stretch, c, SHORTENED), (stretch, c * 2, SHORTENED)]
        elif blanks and c.isspace():
            # The whole gap at its first blank; nothing arrives at the others.
            here = []
            if not span[i - 1].isspace():
                width = widths[gap]
                gap += 1
                drop, keep = (DROPPED, SEPARATE) if width == narrow else (SEPARATE, DROPPED)
                here = [(i + width, "", drop), (i + width, span[i : i + width], keep)]
        elif not blanks and spelled and not single[i]:
            here = [(i + 1, "", DROPPED), (i + 1, c, SEPARATE)]
        elif c in LOOKALIKES:
            kept = SEPARATE if i >= tail and c in PUNCTUATION else KEPT
            here = [(i + 1, c, kept), *((i + 1, x, READ) for x in LOOKALIKES[c])]
        else:
            here = [(i + 1, c, 0.0)]
        edges.append(here)
    return edges


def marked_spans(points: np.ndarray) -> list[tuple[int, int]]:
    """Spans of a lower-cased text that show a look-alike, a stretch or spelled-out letters.

    A span is the core of a word, from its first to its last letter or look-alike, with the closing
    look-alikes but not with other closing punctuation; single letters with blanks between them, three
    or more, are one span, whatever the width of the gaps. The first of them may follow punctuation and
    the last may carry it.
    """
    letters, symbols = letter_table()[points], symbol_table()[points]
    blank = space_table()[points]
    digits = (points >= 48) & (points <= 57)
    n = len(points)
    if n < 2:
        return []
    named = letters | digits
    after = np.append(named[1:], False)
    before = np.concatenate(([False], letters[:-1]))
    marks = symbols & (after | (digits & before))
    same = (points[1:] == points[:-1]) & letters[1:]
    marks[: n - 2] |= same[:-1] & same[1:] if n > 2 else False
    if n > 4:
        unit = letters | symbols
        gap = ~named & ~blank
        marks[: n - 4] |= unit[:-4] & gap[1:-3] & unit[2:-2] & gap[3:-1] & unit[4:] & (points[1:-3] == points[3:-1])
    starts, ends = runs(~blank)
    core = named | symbols
    unit = letters | symbols
    total, lettered, names, signs = (np.concatenate(([0], np.cumsum(m))) for m in (marks, letters, named, symbols))
    long = ends - starts > 1
    second = np.minimum(starts + 1, n - 1)
    lone = ~long & unit[starts]
    carries = long & unit[starts] & (named[starts] | ~symbols[second]) & (names[ends] == names[second])
    opened = long & letters[ends - 1] & (names[ends - 1] == names[starts])
    chains, used = [], np.zeros(len(starts), np.bool_)
    for f, e in zip(*(x.tolist() for x in runs(lone))):
        before, behind = bool(f and opened[f - 1]), bool(e < len(starts) and carries[e])
        s, t = (int(ends[f - 1]) - 1 if before else int(starts[f])), (int(starts[e]) + 1 if behind else int(ends[e - 1]))
        if e - f + before + behind >= 3 and lettered[t] > lettered[s]:
            chains.append((s, t))
            used[f - before : e + behind] = True
    hit = ~used & (lettered[ends] > lettered[starts]) & ((total[ends] > total[starts]) | (signs[ends] > signs[starts]))
    spans = []
    for s, e in zip(starts[hit].tolist(), ends[hit].tolist()):
        first = s + int(core[s:e].argmax())
        tail = e
        while tail > s and not named[tail - 1]:
            tail -= 1
        # Few closing signs of one form may be letters; more of them are decoration.
        while tail < e and symbols[tail]:
            same = tail + 1
            while same < e and points[same] == points[tail]:
                same += 1
            if same - tail > CLOSING:
                break
            tail = same
        if total[e] > total[s] or signs[tail] > signs[first + 1]:
            spans.append((first, max(tail, first + 1)))
    return sorted(spans + chains)


def words(restored: str) -> np.ndarray:
    """Codes of the words (stretches of letters) of a restored text and of their beginnings.

    Beginnings of a few lengths stand for the stem of an inflected word.
    """
    if not restored:
        return np.empty(0, np.int64)
    points = code_points(restored)
    starts, ends = runs(letter_table()[points])
    heads = [(starts, ends)]
    for k in STEMS:
        long = ends - starts >= k
        heads.append((starts[long], starts[long] + k))
    hashed = word_hashes(points, *(np.concatenate(x) for x in zip(*heads)))
    kind = np.repeat(np.arange(len(heads), dtype=np.uint64), [len(a) for a, _ in heads])
    hashed += kind << np.uint64(64 - 3)
    return (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, decoder_costs: np.ndarray, id_column: str, text: str, label: str, rows: int
) -> list[tuple[int, np.ndarray]]:
    """(class, distinct word codes) of at most ``rows`` labelled documents, in a repeatable order."""
    picked = smallest_hashes(labels.filter(F.col(label).isNotNull()), id_column, label, rows)
    if not picked:
        return []
    # At most ``rows`` ids: the only table that is broadcast, and bounded by that parameter.
    chosen = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in picked], "id long, target int")
    joined = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def features(batches):
        decoder = Decoder(decoder_costs)
        for batch in batches:
            codes = [np.unique(words(decoder.restore(v))).astype(np.int32) for v in batch.column(1).to_pylist()]
            yield [batch.column(0), batch.column(2), codes]

    table = map_rows(joined.select("id", "body", "target"), features, "id long, target int, codes array<int>").toArrow()
    out = collected_rows(table, "id", "target", "codes")
    out.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
    order = np.random.default_rng(1).permutation(len(out))
    return [out[i][1:] for i in order]


def telling(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Codes whose share among the toxic rows differs from chance, by the likelihood ratio.

    The limit grows with the number of codes, so that about none passes by chance.
    """
    hits = np.zeros((2, 1 << WORD_BITS))
    size = np.zeros((2, 1))
    for target, codes in rows:
        hits[target, codes] += 1
        size[target] += 1
    share = hits.sum(axis=0) / size.sum()
    ratio = np.zeros(1 << WORD_BITS)
    for seen, expected in ((hits, size * share), (size - hits, size * (1 - share))):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio += 2 * np.where(seen > 0, seen * np.log(seen / expected), 0.0).sum(axis=0)
    return ratio > 2 * np.log(max(2, np.count_nonzero(share)))


def train_sparse(
    rows: list[tuple[int, np.ndarray]], epochs: int = 12, alpha: float = 1.0, l1: float = 0.3, l2: float = 0.02
) -> tuple[np.ndarray, float]:
    """Weights of the telling word codes and the bias, by follow-the-regularised-leader."""
    size = 1 << WORD_BITS
    chosen = telling(rows)
    z, n, limit = np.zeros(size + 1), np.zeros(size + 1), np.full(size + 1, l1)
    limit[-1] = 0.0

    def solve(at):
        za = z[at]
        return np.where(
            np.abs(za) <= limit[at], 0.0, -(za - np.sign(za) * limit[at]) / ((1.0 + np.sqrt(n[at])) / alpha + l2)
        )

    rows = [(target, np.append(codes[chosen[codes]], size)) for target, codes in rows]
    for _ in range(epochs):
        for target, at in rows:
            w = solve(at)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - target
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solve(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_fit_rows: int = 12_000,
) -> ToxicityModel:
    """Count the character model over all of ``docs``; fit the score on labelled rows.

    ``max_fit_rows`` bounds the labelled rows, those of smallest id hash. Null labels are left out;
    without any label every score is one half.
    """
    costs = character_costs(trigram_counts(docs, text))
    rows = labelled_sample(docs, labels, costs, id_column, text, label, max_fit_rows)
    weights, bias = train_sparse(rows) if rows else (np.zeros(1 << WORD_BITS, np.float32), 0.0)
    return ToxicityModel(costs, weights, bias)


def probability(restored: str, model: ToxicityModel) -> float:
    codes = words(restored)
    told = np.unique(codes[model.weights[codes] != 0])
    score = model.bias + float(model.weights[told].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-min(max(score, -35.0), 35.0))))


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    text: str = "text",
    threshold: float = 0.7,
    keep: list[str] | None = None,
    restored: bool = False,
) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to every row.

    A null or empty text scores as one without words: the bias alone. ``restored`` also returns the
    restored text. ``keep`` names the columns returned beside them (all by default); columns named
    like an added one are replaced.
    """

    def one(value):
        clean = model.decoder().restore(value)
        p = probability(clean, model)
        return (p, int(p >= threshold), clean) if restored else (p, int(p >= threshold))

    return with_scores(docs, one, "score double, predicted int" + ", restored string" * restored, text, keep)
