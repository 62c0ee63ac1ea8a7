"""Byte-pair encoding and decoding with the vocabulary of a published tokenizer file.

A word is merged in a contiguous array of the parts between its boundaries and, for each inner
boundary, the rank of joining the parts beside it. The smallest rank is found by scanning, that
boundary is deleted, and only the ranks of the neighbouring ones are looked up again. Words are short, so the
scan is cheaper than a queue; very long words use a queue that gives the same merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain
from pathlib import Path
from weakref import ref

from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from daymark.llm.common import with_scores

#: Words above this many symbols are merged with a queue.
SCANNED = 96
#: Words a task remembers; an entry takes some 250 bytes, and every Python worker of an executor has its own.
REMEMBERED = 1 << 16
#: Code points below this one take the plain expressions; their letters and numbers are settled.
PLAIN = 0x250
_NEVER, _ID = 1 << 60, (1 << 20) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            symbols[b] = chr(b)
        else:
            symbols[b], spare = chr(spare), spare + 1
    return symbols


def category(kind: str) -> str:
    """Plain characters and their lower cases of a general category, escaped for a class."""
    plain = {c for i in range(PLAIN) for c in chr(i) + chr(i).lower()}
    return "".join(re.escape(c) for c in sorted(plain) if unicodedata.category(c)[0] == kind)


class WordBpe:
    """A word-end byte-pair vocabulary; ``load`` reads it on the driver, tasks get its tables."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int], normalizer, splitter):
        # Rank and id of each join, packed, by the packed ids of its parts.
        joins = {
            vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(merges)
        }
        self.__setstate__((vocab, joins, suffix, special, normalizer, splitter))

    def __getstate__(self):
        return self.vocab, self.joins, self.suffix, self.special, self.normalizer, self.splitter

    def __setstate__(self, state):
        self.vocab, self.joins, self.suffix, self.special, self.normalizer, self.splitter = state
        self.tokens = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        # One object an id, which all remembered words share.
        self.numbers = list(range(1 + max(self.vocab.values(), default=-1)))
        self._prepare()

    def _prepare(self) -> None:
        self.symbols = byte_symbols()
        letters, numbers = category("L"), category("N")
        # Fixed value: the vocabulary's own way to cut text into words.
        self.plain = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+"
        )
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Words repeat; the usual ones are merged once a task. The memory must not hold the model strongly: a
        # model that holds itself stays in a worker after its task, beside those of the next tasks.
        this = ref(self)
        self.short = lru_cache(REMEMBERED)(lambda text: this().word(text))

    @classmethod
    def load(cls, path: str) -> WordBpe:
        """From a tokenizer file; only the parts that word-end vocabularies use are read."""
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokenizer = Tokenizer.from_file(path)
        return cls(
            model["vocab"], merges, model["end_of_word_suffix"], special, tokenizer.normalizer, tokenizer.pre_tokenizer
        )

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens, spelled in byte symbols.

        Plain text takes one expression; for other text the file's own normaliser and splitter know
        the character classes.
        """
        if not self.beyond.search(text):
            return [self.spelled(w) for w in self.plain.findall(text.lower())]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def spelled(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one word spelled in byte symbols."""
        vocab = self.vocab
        # The mark of the word's end belongs to the last symbol.
        parts = [vocab[c] for c in text[:-1]]
        parts.append(vocab[text[-1] + self.suffix])
        found = self._scan(parts) if len(parts) <= SCANNED else self._queue(parts)
        return tuple(map(self.numbers.__getitem__, found))

    def _scan(self, parts: list[int]) -> list[int]:
        """``parts`` lie between consecutive boundaries; ``joins`` has the rank at each inner one."""
        join = self.joins.get
        joins = [join(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while joins and (least := min(joins)) < _NEVER:
            i = joins.index(least)
            parts[i] = least & _ID
            del parts[i + 1], joins[i]
            if i < len(joins):
                joins[i] = join(parts[i] << 20 | parts[i + 1], _NEVER)
            if i:
                joins[i - 1] = join(parts[i - 1] << 20 | parts[i], _NEVER)
        return parts

    def _queue(self, parts: list[int]) -> list[int]:
        """The same merges by a queue over a linked list; ties again go to the left."""
        n, join = len(parts), self.joins.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(join(a << 20 | b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        heap = [x for x in heap if x[0] < _NEVER]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            k = after[i]
            # Outdated: one of the two parts has changed or gone.
            if parts[i] < 0 or k < 0 or join(parts[i] << 20 | parts[k], _NEVER) != least:
                continue
            parts[i], parts[k] = least & _ID, -1
            after[i] = after[k]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    rank = join(parts[a] << 20 | parts[after[a]], _NEVER)
                    if rank < _NEVER:
                        heapq.heappush(heap, (rank, a))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is the empty text. Special tokens in the text are kept as such."""
        if not text:
            return []
        ids: list[int] = []
        at = 0
        for found in self.cut.finditer(text):
            ids += self._plain_ids(text[at : found.start()])
            ids.append(self.special[found.group()])
            at = found.end()
        ids += self._plain_ids(text[at:] if at else text)
        return ids

    def _plain_ids(self, text: str) -> list[int]:
        short = self.short
        return list(
            chain.from_iterable([short(w) if len(w) <= SCANNED else self.word(w) for w in self.words(text)])
        )

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, word ends and special tokens shown, as the file asks."""
        return " ".join([self.tokens[i] for i in ids])


def encode(docs: DataFrame, model: WordBpe, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids array<int>`` to every row; empty for a null or empty text."""
    return with_scores(docs, lambda v: (model.encode(v),), "ids array<int>", text, keep)


def decode(encoded: DataFrame, model: WordBpe, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` to every row; null ids decode to the empty text."""
    return with_scores(encoded, lambda v: (model.decode(v or []),), "decoded string", ids, keep)


def round_trip(docs: DataFrame, model: WordBpe, digest, added: str, text: str = "text", keep: list[str] | None = None):
    """Encode and decode in one pass; ``digest(ids, decoded)`` gives the columns ``added``."""

    def one(value):
        ids = model.encode(value)
        return digest(ids, model.decode(ids))

    return with_scores(docs, one, added, text, keep)
