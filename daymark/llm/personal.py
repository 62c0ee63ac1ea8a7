"""Personal data: fixed patterns, plus candidates selected by gradient-boosted trees.

Four fixed patterns give the base spans, which always stay. Generators of high recall propose further,
overlapping spans of the same kinds (other separators, missing signs, spelled-out addresses). Boosted
trees over format and context features score them; scores are calibrated on rows kept out of the
training, and the threshold of each kind is the lowest that keeps the wanted precision there.

No table marks personal data, so the trees learn from the patterns: matches that pass their check are
examples, matches of the same shape that fail it, and digits inside longer tokens, are
counter-examples. No pattern matches what the generators add, so each match that passes is also written
as they look for it (sign removed, @ spelled out, other separators), and as what only looks like it (no
dotted domain, a wrong check digit, a date). Whole forms of that writing are kept out of the trees; the
thresholds are calibrated on those, so that they hold for forms nobody wrote down. The matches
themselves need no threshold. The number of training candidates is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import collected_rows, map_rows, with_scores

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"[0-9]+")

#: Spelled-out signs of an address.
_AT, _DOT = r" ?[(\[{] ?at ?[)\]}] ?", r" ?[(\[{] ?dot ?[)\]}] ?"
_SPELLED_AT, _SPELLED_DOT = re.compile(_AT, re.I), re.compile(_DOT, re.I)
#: A character of an address before its @, when more than the base pattern's are allowed.
_WORD = r"[^\s@<>\"',;:()\[\]{}|/\\=?]"
#: Generators of high recall, and what a text must hold for them: an @, a spelled-out one, or a digit.
_WIDE = (
    ("email", "@", re.compile(rf"(?<!{_WORD})(?:{_WORD})++@\w[\w-]*+(?:\.\w[\w-]*+)*")),
    ("email", "at", re.compile(rf"(?<![\w.+-])[\w.+-]++{_AT}[\w-]++(?:(?:{_DOT}|\.)[\w-]++)+", re.I)),
    ("ip", "0", re.compile(r"(?<![0-9])[0-9]{1,4}(?:[.][0-9]{1,4}){3,7}")),
    ("ip", "0", re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}| ?[(\[]\.[)\]] ?)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)),
    ("card", "0", re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){11,20}")),
    ("phone", "0", re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,15}")),
)
_CUES = (
    ("email", re.compile(r"mail|contact|write", re.I)),
    ("ip", re.compile(r"\bip\b|host|addr|server", re.I)),
    ("card", re.compile(r"card|visa|pay|account|iban|credit", re.I)),
    ("phone", re.compile(r"phone|tel|call|fax|mobile|\bfon", re.I)),
)
#: Characters of context on either side.
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def octet(part: str) -> bool:
    """Whether digits are at most 255: by length first, as any number of zeros may be in front."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def passes(kind: str, text: str) -> bool:
    """The check that a match of a base pattern must pass."""
    if kind == "ip":
        return all(map(octet, text.split(".")))
    digits = only_digits(text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", found.end() if found else at + 1)


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the base patterns, and whether each passes its check."""
    found = [("email", a, b, True) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(kind, *m.span(), passes(kind, m.group())) for m in pattern.finditer(text)]
    return found


def fails(kind: str, text: str) -> bool:
    """Whether a generated span of this shape cannot be what its kind asks for."""
    if kind == "ip":
        groups = _GROUPS.findall(text)
        return len(groups) != 4 or not all(map(octet, groups))
    if kind == "email":
        return "." not in plain_address(text).rpartition("@")[2]
    return not passes(kind, text)


def plain_address(text: str) -> str:
    return _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", text))


class Covered:
    """Code points of a text that lie in a span, so that overlaps are found without comparing spans."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.marks = bytearray(len(text))
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.marks[a:b] = b"\1" * (b - a)

    def touches(self, a: int, b: int) -> bool:
        return self.marks.find(1, a, b) >= 0


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """Spans (kind, start, end, label): 1 an example, 0 a counter-example, -1 unknown."""
    held = {"0": _DIGIT.search(text) is not None, "@": "@" in text, "at": _SPELLED_AT.search(text) is not None}
    if not any(held.values()):
        return []
    spans = {(k, a, b): int(ok) for k, a, b, ok in matches(text) if ok or k != "card" or b - a >= 12}
    taken = Covered(text, [(a, b) for (_, a, b), ok in spans.items() if ok])
    for kind, gate, pattern in _WIDE:
        if not held[gate]:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if (kind, a, b) in spans or taken.touches(a, b):
                continue
            inside = kind != "email" and (a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum())
            spans[(kind, a, b)] = 0 if inside or fails(kind, m.group()) else -1
    return [(*k, v) for k, v in spans.items()]


#: Forms that no tree sees: thresholds are set, and recall is measured, on these alone.
HELD_FORMS = {
    "email": {"[at]", "(at) and (dot)", "wide domain", "[at] number", "wide number"},
    "ip": {"(.)", " [dot] ", "(.) short", "[dot] short 100", " [dot] wrong", "(.) wrong short"},
    "card": {"/", "/ wrong"},
    "phone": {"double zero", "/", "national /", "national -", "date .", "thirds .", "decimal 3"},
}


def rewritten(kind: str, text: str, cued: bool) -> list[tuple[str, str, int]]:
    """A passing match as the generators look for it (1), and as what only looks like it (0), by form.

    ``cued``: a word before the match names its kind. A bare run of digits is a phone only then.
    """
    good, bad = [], []
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        number = f"{len(local)}.{10 + len(text) % 90}"
        good += [("(at)", f"{local} (at) {domain}"), ("[at]", f"{local}[at]{domain}")]
        good += [("(at) and (dot)", f"{local} (at) {' (dot) '.join(labels)}"), ("[at] and [dot]", f"{local}[at]{'[dot]'.join(labels)}")]
        good += [("capitals", f"{local} [AT] {' [DOT] '.join(labels)}".upper())]
        good += [("wide local", f"{local[:-1]}\xe9@{domain}"), ("wide domain", f"{local}@\xfc{domain[1:]}")]
        bad += [("no dot", f"{local}@{labels[0]}"), ("wide, no dot", f"{local[:-1]}\xe9@{labels[0]}")]
        bad += [("wide number", f"{local}\xe9@{number}"), ("(at) number", f"{local} (at) {number}"), ("[at] number", f"{local}[at]{number}")]
    elif kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        wrong = [str(256 + int(parts[0])), *parts[1:]]
        # Short numbers are rare in random addresses, not in those of hosts.
        short, longer = ([str(int(p) % n) for p in parts] for n in (10, 100))
        for sign in ("[.]", "(.)", " [dot] ", " (dot) ", "[dot]"):
            good += [(sign, sign.join(parts)), (f"{sign} short", sign.join(short)), (f"{sign} short 100", sign.join(longer))]
            bad += [(f"{sign} wrong", sign.join(wrong)), (f"{sign} wrong short", sign.join([*short[:3], wrong[0]]))]
    elif kind == "card":
        digits = only_digits(text)
        for made, told, d in ((good, "", digits), (bad, " wrong", digits[:-1] + str((int(digits[-1]) + 5) % 10))):
            groups = [d[i : i + 4] for i in range(0, len(d), 4)]
            made += [(sign.strip() + told or "spaces", sign.join(groups)) for sign in (".", "/", "  ", " - ")]
    else:
        digits, groups = only_digits(text), _GROUPS.findall(text)
        good += [("unsigned", text[1:]), ("double zero", "00" + text[1:]), *((s, s.join(groups)) for s in (".", "-", "/", " "))]
        if len(groups) > 2 and len(digits) - len(groups[0]) >= 10:
            good += [("national", text[1 + len(groups[0]) :].lstrip(" .-"))]
            good += [(f"national {s}", s.join(groups[1:])) for s in (".", "-", "/", " ")]
        month, day, hour = (1 + int(digits[1:3]) % 12, 1 + int(digits[3:5]) % 28, int(digits[5:7]) % 24)
        year = 1950 + int(digits[7:10]) % 100
        bad += [("date -", f"{year}-{month:02}-{day:02} {hour:02}"), ("date .", f"{day:02}.{month:02}.{year} {hour:02}")]
        bad += [("date /", f"{day:02}/{month:02}/{year} {hour:02}"), ("digit by digit", " ".join(digits))]
        bad += [("decimal 1", f"{digits[0]}.{digits[1:]}"), ("decimal 3", f"{digits[:3]}.{digits[3:]}")]
        first = len(digits) % 3 or 3
        thirds = [digits[:first], *(digits[i : i + 3] for i in range(first, len(digits), 3))]
        bad += [(f"thirds {s}", s.join(thirds)) for s in (" ", ".")]
        good = [(f, g) for f, g in good if not g.isdigit()]
        (good if cued else bad).extend([("bare", digits), ("bare national", digits[-10:])])
    return [(f, t, 1) for f, t in good] + [(f, t, 0) for f, t in bad]


def examples(text: str) -> Iterator[tuple[str, int, int, int, bool, str, list[float]]]:
    """Training rows (kind, start, end, label, whether a base span, form, features) of one text."""
    cues = dict(_CUES)
    for kind, a, b, label in candidates(text):
        if label >= 0:
            yield kind, a, b, label, label == 1, "", features(text, kind, a, b)
        if label != 1:
            continue
        left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        for form, made, wanted in rewritten(kind, text[a:b], cues[kind].search(left) is not None):
            body, start, stop = left + made + right, len(left), len(left) + len(made)
            # Only what a generator finds there, and no base pattern, is a row; of other kinds what fails.
            for k, *at, told in candidates(body):
                if at == [start, stop] and told != 1 and (k == kind or told == 0):
                    yield k, a, b, wanted if k == kind else 0, False, f"{kind} {form}", features(body, k, start, stop)


HELD = {f"{kind} {form}" for kind, forms in HELD_FORMS.items() for form in forms}


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span and its surroundings, as numbers."""
    span = text[start:end]
    digits = only_digits(span)
    marks = [c for c in span if not c.isalnum()]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    domain = plain_address(span).rpartition("@")[2] if kind == "email" else ""
    labels = domain.split(".") if domain else []

    def beside(c: str) -> float:
        return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0

    return [
        float(KINDS.index(kind)),
        float(fails(kind, span)),
        float(end - start),
        float(len(digits)),
        float(len(marks)),
        float(len(set(marks))),
        float(sum(c.isalpha() for c in span)),
        float(luhn(digits)) if digits else -1.0,
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(min(9999, max((int(g[:5]) for g in groups), default=-1))),
        float(span.count(".")),
        float(span[:1] == "+"),
        float("(" in span),
        float(len(labels)),
        float(len(labels[-1]) if labels else 0),
        float(bool(labels) and all(x and not x.startswith("-") for x in labels)),
        float(bool(labels) and labels[-1].isalpha()),
        beside(left[-1:]),
        beside(right[:1]),
        float(sum(c.isdigit() for c in left + right)),
        float(sum(c.isalpha() for c in left + right)),
        *(float(bool(p.search(left))) for _, p in _CUES),
    ]


@dataclass
class Tree:
    """A complete binary tree in heap order; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            f = self.feature[node]
            right = x[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return self.value[node]


DEPTH = 3


@dataclass
class PersonalModel:
    trees: list[Tree] = field(default_factory=list)
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            out += tree.margins(x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(x) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rate: float) -> Tree:
    """One tree by second-order gains over binned features."""
    size = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    node = np.zeros(len(x), np.int64)
    for k in range(size):
        here = np.flatnonzero(node == k)
        if not len(here):
            continue
        gs, hs = g[here].sum(), h[here].sum()
        value[k] = -rate * gs / (hs + 1.0)
        if k >= 2**DEPTH - 1 or len(here) < 20:
            continue
        best = (1e-6, -1, 0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            b = bins[here, f]
            gl = np.cumsum(np.bincount(b, g[here], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[here], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        if best[1] >= 0:
            feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
            node[here] = 2 * k + 1 + (x[here, best[1]] > cut[k])
    return Tree(feature, cut, value)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> tuple[list[Tree], float]:
    """Trees and starting margin for the logistic loss."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > 32:
            values = np.unique(np.quantile(column, np.linspace(0, 1, 32)))
        cuts.append((values[1:] + values[:-1]) / 2)
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    prior = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(x), prior), []
    for _ in range(rounds):
        p = sigmoid(margin)
        trees.append(grow(x, bins, cuts, p - y, np.maximum(p * (1 - p), 1e-6), rate))
        margin += trees[-1].margins(x)
    return trees, prior


def calibrate(model: PersonalModel, x: np.ndarray, y: np.ndarray, base: np.ndarray, precision: float) -> None:
    """Fit slope and shift on held-back rows; then the threshold of each kind on those not ``base``.

    A kind without both examples and counter-examples there takes no candidates.
    """
    m = model.margins(x)
    for _ in range(50):
        p = sigmoid(model.slope * m + model.shift)
        w = np.maximum(p * (1 - p), 1e-4)
        a = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(a, np.array([((p - y) * m).sum(), (p - y).sum()]))
        model.slope, model.shift = model.slope - 0.5 * step[0], model.shift - 0.5 * step[1]
    p = model.probabilities(x)
    for i, kind in enumerate(KINDS):
        own = (x[:, 0] == i) & ~base
        if not (own & (y == 1)).any() or not (own & (y == 0)).any():
            continue
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        if len(good):
            # Halfway to the next lower score, as no row told where between the two to stop.
            sorted_p = np.append(p[own][order], 0.0)
            model.thresholds[kind] = max(0.9, float(sorted_p[good[-1] : good[-1] + 2].mean()))


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    max_fit_docs: int = 20_000,
    max_fit_rows: int = 20_000,
    precision: float = 0.99,
) -> PersonalModel:
    """Fit on at most ``max_fit_rows`` candidates of about ``max_fit_docs`` documents.

    Documents are those of smallest id hash, candidates likewise. Without examples and
    counter-examples the model takes no candidate, and only base spans are found.
    """
    order = F.pmod(F.xxhash64(F.col(id_column), F.lit("personal")), F.lit(1 << 30))
    share = min(1.0, max_fit_docs / max(1, docs.count()))
    sample = docs.filter(order < int(share * (1 << 30))).select(order.alias("h"), F.col(text).alias("body"))

    def rows(batches):
        for batch in batches:
            out = []
            for h, body in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(h, *row[1:]) for row in examples(body or "")]
            yield [list(c) for c in zip(*out)] if out else [[], [], [], [], [], [], []]

    schema = "h long, start int, stop int, label int, base boolean, form string, x array<double>"
    found = map_rows(sample, rows, schema).orderBy("h", "start", "stop", "x", "label").limit(max_fit_rows)
    return fit(collected_rows(found.toArrow(), "h", "label", "x", "base", "form"), precision)


def fit(table: list[tuple], precision: float = 0.99) -> PersonalModel:
    """Trees from rows (hash, label, features, base, form); thresholds from forms the trees never see.

    Rows that were not rewritten are kept back by hash.
    """
    if len({t[1] for t in table}) < 2:
        return PersonalModel()
    back = np.array([t[4] in HELD or not t[4] and t[0] % 4 == 0 for t in table])
    y, x = np.array([t[1] for t in table], float), np.array([t[2] for t in table])
    if len(set(y[~back])) < 2:
        return PersonalModel()
    model = PersonalModel(*boost(x[~back], y[~back]))
    calibrate(model, x[back], y[back], np.array([t[3] for t in table])[back], precision)
    return model


def held_recall(table: list[tuple], model: PersonalModel) -> dict[str, tuple[int, float, float]]:
    """By kind, on the forms kept back: examples, share of them found, share of the found that are right."""
    out = {}
    for i, kind in enumerate(KINDS):
        rows = [t for t in table if t[4] in HELD and t[2][0] == i]
        wanted = np.array([t[1] == 1 for t in rows], bool)
        if not wanted.any() or kind not in model.thresholds:
            out[kind] = (int(wanted.sum()), 0.0, 1.0)
            continue
        found = model.probabilities(np.array([t[2] for t in rows])) >= model.thresholds[kind]
        out[kind] = (int(wanted.sum()), float(found[wanted].mean()), float(wanted[found].mean()) if found.any() else 1.0)
    return out


def spans(text: str | None, model: PersonalModel) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) by start, then kind; null is the empty text."""
    if not text:
        return []
    found = candidates(text)
    out = [(k, a, b, True, 1.0) for k, a, b, label in found if label == 1]
    more = [c for c in found if c[3] != 1 and c[0] in model.thresholds and not fails(c[0], text[c[1] : c[2]])]
    if more:
        p = model.probabilities(np.array([features(text, *c[:3]) for c in more]))
        taken = Covered(text, [(a, b) for _, a, b, _, _ in out])
        for i in np.argsort(-p, kind="stable"):
            kind, a, b, _ = more[i]
            if p[i] >= model.thresholds[kind] and not taken.touches(a, b):
                taken.add(a, b)
                out.append((kind, a, b, False, float(p[i])))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "spans array<struct<kind: string, start: int, stop: int, base: boolean, score: double>>"


def find_personal(
    docs: DataFrame, model: PersonalModel, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``spans`` to every row: code-point offsets, end exclusive, base or selected, with score.

    Null and empty texts have none. Base spans of different kinds may overlap; selected ones overlap
    nothing. ``keep`` names the columns returned beside them; one called ``spans`` is replaced.
    """
    names = ("kind", "start", "stop", "base", "score")
    return with_scores(
        docs, lambda v: ([dict(zip(names, s)) for s in spans(v, model)],), SPANS, text, keep
    )


def redact(docs: DataFrame, text: str = "text", found: str = "spans") -> DataFrame:
    """Replace every span of ``found`` in ``text`` by its kind in angle brackets; the rest stays.

    A span that begins inside an earlier one is covered with it.
    """

    def one(body, marked):
        if body is None:
            return (None,)
        out, at = [], 0
        for s in marked or []:
            if s["start"] >= at:
                out += [body[at : s["start"]], f"<{s['kind']}>"]
            at = max(at, s["stop"])
        return ("".join([*out, body[at:]]),)

    def rows(batches):
        for batch in batches:
            done = [one(b, m)[0] for b, m in zip(batch.column(at).to_pylist(), batch.column(marks).to_pylist())]
            columns = list(batch.columns)
            columns[at] = done
            yield columns

    at, marks = docs.columns.index(text), docs.columns.index(found)
    return map_rows(docs, rows, docs.schema)
