"""Scoring texts by a hierarchical Pitman-Yor model of words.

*Model.* Each word seen in training is a context with a restaurant of its own; all restaurants share
one parent, whose base is uniform over the training words and one unknown. A dish (context u, word w)
has as many customers as training holds the pair; each of its tables is one customer of w at the
parent. The predictive probability of w after u is
``(c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u)``, with P the parent's predictive probability.

*Seating by Gibbs.* All that a dish's seating means to the rest is its number of tables t. Given the
strength ``a`` of a new table, t has weight S(c, t) a^t, with S the generalised Stirling numbers of
discount d, and it is drawn from that at once. An auxiliary Gamma(s/d + t_u) variable per restaurant makes its
dishes independent, so whole restaurants are drawn side by side. Beyond ``EXACT`` customers the
recursion of S has a closed form: tables are those of a dish with ``EXACT`` customers and a weaker
``a``, plus a Poisson number. Rounds alternate: restaurants given the parent, then the parent given
their tables. The score averages predictive probabilities over the last samples; in each of them the
text's own dish counts with its expected tables.

*On Spark.* Texts are encoded once, in chunks of whole texts with a dictionary each. Everything else
is messages between chunks, shards (restaurants by hash of the context) and ranges (words by hash): a
chunk sends each distinct pair once to its shard and gets its count back, shards send tables by word
to ranges and get the parent's state, ranges tell chunks about their words. A message is one row of
packed arrays, so a word or pair has one entry a chunk, however often it occurs. Restaurants of very
frequent words are split by the following word. The driver sees totals only.

Words are told by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import mix64, runs, slices, word_hashes
from daymark.llm.messages import pack, unpack
from daymark.session import scratch_path

#: Tokens of a chunk of texts, tokens that a shard stands for, words of a range.
CHUNK_TOKENS, SHARD_TOKENS, RANGE_WORDS = 1 << 21, 2_000_000, 1_000_000
#: Most restaurants that are split; a word of a smaller share than 1 in so many is never split.
HOT_WORDS, FEWEST_HOT = 1 << 16, 16
#: Customers of a dish up to which Stirling numbers are tabled.
EXACT = 256
END = np.uint64(0x7C15F39CC0605CED)
MESSAGE = "kind string, to long, src long, parts array<binary>"
_MESSAGE = pa.schema([("kind", pa.string()), ("to", pa.int64()), ("src", pa.int64()), ("parts", pa.list_(pa.binary()))])
ENCODED = "tokens long, words long, heavy array<struct<word:long,n:long>>, " + MESSAGE


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MESSAGE)] if rows else
                                      [pa.array([], f.type) for f in _MESSAGE], schema=_MESSAGE)


def word_stream(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, A-Z lowered, and one end."""
    body = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    return np.append(word_hashes(body, *runs(~((body == 32) | ((body >= 9) & (body <= 13))))), END)


def encoded(rows: DataFrame, limit: int) -> DataFrame:
    """Chunks of rows ``id``, ``learned``, ``body``: one message each, with its size and frequent words."""

    def chunk(number, ids, learned, texts):
        lengths = np.array([len(t) for t in texts])
        words, tokens, counts = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        # Numbers by frequency compress better.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        heavy = order[counts[order] >= max(FEWEST_HOT, len(tokens) // (2 * HOT_WORDS))]
        told = [{"word": int(w), "n": int(n)} for w, n in zip(words[heavy].view(np.int64), counts[heavy])]
        parts = [np.array([i or 0 for i in ids]), np.array([i is None for i in ids]), np.array(learned, bool), lengths]
        parts = [pack(p) for p in (*parts, words[order], rank[tokens])]
        return len(tokens), len(words), told, "text", number, -1, parts

    def run(batches):
        first, serial = TaskContext.get().partitionId() << 32, 0
        ids, learned, texts, size = [], [], [], 0

        def emit():
            row = chunk(first + serial, ids, learned, texts)
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        schema = pa.schema(
            [("tokens", pa.int64()), ("words", pa.int64()),
             ("heavy", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))), *_MESSAGE]
        )
        names = schema.names
        for batch in slices(batches):
            for i, flag, body in zip(*(c.to_pylist() for c in batch.columns)):
                texts.append(word_stream(body))
                ids.append(i)
                learned.append(bool(flag))
                size += len(texts[-1])
                if size >= limit:
                    yield emit()
                    serial += 1
                    ids, learned, texts, size = [], [], [], 0
        if ids:
            yield emit()

    return rows.mapInArrow(run, ENCODED)


class Layout:
    """Where pairs and words go: shards of restaurants, ranges of words."""

    def __init__(self, tokens: int, words: int, heavy: list[tuple[int, int]]):
        self.shards, self.ranges = 1 + tokens // SHARD_TOKENS, 1 + words // RANGE_WORDS
        hot = sorted((w % (1 << 64), -(-2 * n // SHARD_TOKENS)) for w, n in heavy)
        self.hot = np.array([w for w, _ in hot], np.uint64)
        self.pieces = np.minimum(np.array([p for _, p in hot], np.int64), self.shards)

    def shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = (mix64(u + np.uint64(1)) % np.uint64(self.shards)).astype(np.int64)
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            split = self.hot[k] == u
            at[split] += (mix64(w[split]) % self.pieces[k[split]].astype(np.uint64)).astype(np.int64)
        return at % self.shards

    def cuts(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Range, start and end of each stretch of sorted words."""
        at = ((words >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)
        return stretches(at)


def stretches(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else []
    return [(int(sorted_values[a]), int(a), int(b)) for a, b in zip(first, [*first[1:], len(sorted_values)])]


class Chunk:
    """One chunk's texts again: its words, and its distinct pairs in the order their shards know them."""

    def __init__(self, parts: list[bytes]):
        ids, missing, self.learned, self.lengths, self.words, tokens = map(unpack, parts)
        self.ids = pa.array(ids.astype(np.int64), mask=missing)
        self.lengths = self.lengths.astype(np.int64)
        self.tokens = tokens.astype(np.int64)
        # A text starts where another ends: its first context is an end.
        end = int(np.flatnonzero(self.words == END)[0])
        context = np.concatenate(([end], self.tokens[:-1]))
        pairs, self.pair = np.unique(context * len(self.words) + self.tokens, return_inverse=True)
        self.u, self.w = np.divmod(pairs, len(self.words))

    def by_shard(self, layout: Layout) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        shard = layout.shard(self.words[self.u], self.words[self.w])
        order = np.argsort(shard, kind="stable")
        return order, stretches(shard[order])


def send_pairs(layout: Layout):
    """Chunks to messages: each distinct pair with its count in learned texts, to its shard."""

    def run(batches):
        for batch in batches:
            for number, parts in zip(batch.column("to").to_pylist(), batch.column("parts").to_pylist()):
                chunk = Chunk(parts)
                counted = np.repeat(chunk.learned, chunk.lengths)
                n = np.bincount(chunk.pair[counted], minlength=len(chunk.u))
                order, cuts = chunk.by_shard(layout)
                out = []
                for shard, a, b in cuts:
                    at = order[a:b]
                    # Pairs are sorted by context.
                    starts = stretches(chunk.u[at])
                    words, place = np.unique(chunk.w[at], return_inverse=True)
                    sent = (chunk.words[[s[0] for s in starts]], np.array([s[2] - s[1] for s in starts]), chunk.words[words], place, n[at])
                    out.append(("pairs", shard, number, [pack(p) for p in sent]))
                yield batch_of(out)

    return run


def send_words(layout: Layout):
    """Chunks to messages: their words, to the ranges."""

    def run(batches):
        for batch in batches:
            for number, parts in zip(batch.column("to").to_pylist(), batch.column("parts").to_pylist()):
                words = np.sort(unpack(parts[4]))
                yield batch_of([("ask", q, number, [pack(words[a:b])]) for q, a, b in layout.cuts(words)])

    return run


def by_kind(table: pa.Table) -> tuple[int, dict[str, list[tuple[int, list[bytes]]]]]:
    """The messages of one group by kind, in the order of their senders."""
    out: dict[str, list] = {}
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "src", "parts")))
    for kind, src, parts in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(kind, []).append((src, parts))
    return table.column("to")[0].as_py(), out


def grouped(messages: DataFrame, function) -> DataFrame:
    """``function`` of each receiver's messages, to further messages."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch_of(function(*by_kind(table)))])

    return messages.groupBy("to").applyInArrow(run, MESSAGE)


class Post:
    """Messages written to the shared folder, read back by kind."""

    def __init__(self, messages: DataFrame, name: str):
        self.spark, self.path = messages.sparkSession, scratch_path(messages.sparkSession, name)
        messages.write.partitionBy("kind").parquet(self.path)

    def __call__(self, *kinds: str) -> DataFrame:
        return self.spark.read.schema(MESSAGE).parquet(self.path).filter(F.col("kind").isin(*kinds)).select("kind", "to", "src", "parts")

    def totals(self) -> np.ndarray:
        """Sums over one short row of each shard or range."""
        rows = self("sum").select("parts").collect()
        return np.sum([unpack(r["parts"][0], "f8") for r in rows], axis=0) if rows else np.zeros(4)


def tables_up(layout: Layout, shard: int, w, tables, u, customers, seated) -> list[tuple]:
    """What a shard tells the ranges: tables by word, customers and tables by context, one row a sample."""
    out = []
    said = {q: [w[a:b], tables[:, a:b]] for q, a, b in layout.cuts(w)}
    for q, a, b in layout.cuts(u):
        out.append((q, said.pop(q, [w[:0], tables[:, :0]]), (u[a:b], customers[a:b], seated[:, a:b])))
    out += [(q, s, (u[:0], customers[:0], seated[:, :0])) for q, s in said.items()]
    return [
        ("up", q, shard, [pack(ws), pack(ts.ravel()), pack(us), pack(cs), pack(ss.ravel())])
        for q, (ws, ts), (us, cs, ss) in out
    ]


def merge_pairs(layout: Layout):
    """One shard: dishes of all chunks. Counts go back; every dish starts with one table."""

    def run(shard, messages):
        us, ws, ns, sizes = [], [], [], []
        for _, parts in messages["pairs"]:
            u, length, words, place, n = map(unpack, parts)
            us.append(np.repeat(u, length))
            ws.append(words[place])
            ns.append(n.astype(np.int64))
            sizes.append(len(place))
        u, w, n = map(np.concatenate, (us, ws, ns))
        key = mix64(u + mix64(w + np.uint64(7)))
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        total = np.add.reduceat(n[order], first)
        back = np.empty(len(n), np.int64)
        back[order] = np.repeat(total, np.diff(first, append=len(n)))
        out, start = [], 0
        for (chunk, _), size in zip(messages["pairs"], sizes):
            out.append(("seen", chunk, shard, [pack(back[start : start + size])]))
            start += size
        kept = order[first][total > 0]
        c = total[total > 0]
        contexts, at_u = np.unique(u[kept], return_inverse=True)
        words, at_w = np.unique(w[kept], return_inverse=True)
        several = c > 1
        customers = np.bincount(at_u, c, minlength=len(contexts)).astype(np.int64)
        lone_u = np.bincount(at_u[~several], minlength=len(contexts))
        lone_w = np.bincount(at_w[~several], minlength=len(words))
        # Dishes in the order of their customers, so that equal counts are drawn together.
        by_count = np.flatnonzero(several)[np.argsort(c[several], kind="stable")]
        parts = (contexts, customers, lone_u, words, lone_w, at_u[by_count], at_w[by_count], c[by_count])
        out.append(("dishes", shard, shard, [pack(p) for p in parts]))
        out.append(("sum", 0, shard, [pack(np.array([(c == 1).sum(), (c == 2).sum(), c.sum(), 0], float))]))
        dishes_u = np.bincount(at_u, minlength=len(contexts))[None]
        dishes_w = np.bincount(at_w, minlength=len(words))[None]
        return out + tables_up(layout, shard, words, dishes_w, contexts, customers, dishes_u)

    return run


@lru_cache(4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) for c, t up to ``EXACT``."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        stay = np.where(t <= c, table[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def beyond(customers: np.ndarray, strength: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers up to ``EXACT``, their strength, and the mean number of tables that come on top."""
    over = np.minimum(1.0, EXACT / np.maximum(customers, 1)) ** discount
    return np.minimum(customers, EXACT), strength * over, strength * (1.0 - over) / discount


def draw_tables(customers: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes sorted by customers."""
    tabled, weak, extra = beyond(customers, strength, discount)
    log_weight, dice = np.log(np.maximum(weak, 1e-300)), rng.random(len(customers))
    out = np.ones(len(customers), np.int64)
    numbers = stirling(discount)
    for c, a, b in stretches(tabled):
        if c < 2:
            continue
        t = np.arange(1, c + 1)
        step = max(1, (1 << 20) // c)
        for start in range(a, b, step):
            at = slice(start, min(b, start + step))
            logits = numbers[c, 1 : c + 1] + log_weight[at, None] * t
            mass = np.exp(logits - logits.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (mass < dice[at, None] * mass[:, -1:]).sum(axis=1)
    return np.minimum(out + rng.poisson(extra), customers)


class Expected:
    """Expected numbers of tables, between grid points of the strength's logarithm."""

    def __init__(self, discount: float, low: float = -40.0, high: float = 24.0, step: float = 0.125):
        self.discount, self.low, self.step = discount, low, step
        grid = np.arange(low, high + step, step)
        self.table = np.zeros((EXACT + 1, len(grid)), np.float32)
        numbers = stirling(discount)
        for c in range(1, EXACT + 1):
            t = np.arange(1, c + 1)
            logits = numbers[c, 1 : c + 1] + grid[:, None] * t
            mass = np.exp(logits - logits.max(axis=1, keepdims=True))
            self.table[c] = (mass @ t) / mass.sum(axis=1)

    def __call__(self, customers: np.ndarray, strength: np.ndarray) -> np.ndarray:
        tabled, weak, extra = beyond(customers, strength, self.discount)
        at = np.clip((np.log(np.maximum(weak, 1e-300)) - self.low) / self.step, 0, self.table.shape[1] - 1.001)
        left = at.astype(np.int64)
        part = at - left
        found = self.table[tabled, left] * (1 - part) + self.table[tabled, left + 1] * part
        return np.minimum(found + extra, customers)


@lru_cache(4)
def expected(discount: float) -> Expected:
    return Expected(discount)


class Parent:
    """The parent's totals: customers, tables, words known, discounts."""

    def __init__(self, customers: float, tables: float, known: float, discount: float, strength: float):
        self.customers, self.tables, self.known = customers, tables, known
        self.discount, self.strength = discount, strength

    def predictive(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        base = (self.strength + self.discount * self.tables) / (self.known + 1)
        return (customers - self.discount * tables + base) / (self.strength + self.customers)


def seat_parent(layout: Layout, strengths: list[float] | None, discount: float, seed: int):
    """One range: the parent's customers by word, their tables drawn (one each without ``strengths``)."""

    def run(q, messages):
        up = [(src, [unpack(p) for p in parts]) for src, parts in messages.get("up", [])]
        samples = len(strengths) if strengths else 1
        words = np.unique(np.concatenate([np.empty(0, np.uint64), *(p[2].astype(np.uint64) for _, p in up)]))
        guests, seated = (np.zeros((samples, len(words)), np.int64) for _ in range(2))
        customers = np.zeros(len(words), np.int64)
        for _, (w, tables, u, c, s) in up:
            at = np.searchsorted(words, w.astype(np.uint64))
            guests[:, at] += tables.reshape(samples, -1)
            at = np.searchsorted(words, u.astype(np.uint64))
            customers[at] += c
            seated[:, at] += s.reshape(samples, -1)
        tables = np.minimum(guests, 1)
        if strengths:
            rng = np.random.default_rng([seed, q])
            for row, strength in enumerate(strengths):
                order = np.argsort(guests[row], kind="stable")
                some = order[np.searchsorted(guests[row][order], 1) :]
                tables[row, some] = draw_tables(guests[row][some], np.full(len(some), strength), discount, rng)
        facts = [len(words), customers.sum(), *guests.sum(axis=1), *tables.sum(axis=1), (guests[0] == 1).sum(), (guests[0] == 2).sum()]
        out = [("sum", 0, q, [pack(np.array(facts, float))])]
        if samples == 1:
            for src, (w, *_) in up:
                at = np.searchsorted(words, w.astype(np.uint64))
                out.append(("down", src, q, [pack(guests[0, at]), pack(tables[0, at])]))
            hot = np.isin(layout.hot, words)
            at = np.searchsorted(words, layout.hot[hot])
            out.append(("hot", 0, q, [pack(np.flatnonzero(hot)), pack(seated[0, at])]))
        for src, parts in messages.get("ask", []):
            asked = unpack(parts[0]).astype(np.uint64)
            at = np.searchsorted(words, asked)
            known = at < len(words)
            known[known] = words[at[known]] == asked[known]
            told = np.zeros((1 + 3 * samples, len(asked)), np.int64)
            told[:, known] = np.concatenate((customers[None], seated, guests, tables))[:, at[known]]
            out.append(("stat", src, q, [pack(row) for row in told]))
        return out

    return run


def seat_shard(layout, parent: Parent, hot_tables, discount, strength, burn: int, samples: int, seed: int):
    """One shard: tables of all its dishes drawn given the parent, ``samples`` times after ``burn``."""

    def run(shard, messages):
        contexts, customers, lone_u, words, lone_w, at_u, at_w, c = map(unpack, messages["dishes"][0][1])
        contexts, words, c = contexts.astype(np.uint64), words.astype(np.uint64), c.astype(np.int64)
        at_u, at_w = at_u.astype(np.int64), at_w.astype(np.int64)
        down = [[unpack(p, "i8") for p in parts] for _, parts in messages.get("down", [])]
        guests, seated = (np.concatenate([np.empty(0, np.int64), *(d[k] for d in down)]) for k in (0, 1))
        p = parent.predictive(guests, seated)[at_w]
        rng = np.random.default_rng([seed, shard])
        tables = np.ones(len(c), np.int64)

        def totals():
            return lone_u + np.bincount(at_u, tables, len(contexts)).astype(np.int64)

        # Tables of a split restaurant in other shards stay as they were.
        elsewhere = np.zeros(len(contexts), np.int64)
        if len(layout.hot):
            k = np.minimum(np.searchsorted(layout.hot, contexts), len(layout.hot) - 1)
            split = layout.hot[k] == contexts
            elsewhere[split] = np.maximum(hot_tables[k[split]] - totals()[split], 0)
        by_w, by_u = [], []
        for sweep in range(burn + samples):
            drawn = rng.gamma(strength / discount + totals() + elsewhere)
            tables = draw_tables(c, discount * drawn[at_u] * p, discount, rng)
            if sweep >= burn:
                by_w.append(lone_w + np.bincount(at_w, tables, len(words)).astype(np.int64))
                by_u.append(totals())
        return tables_up(layout, shard, words, np.array(by_w), contexts, customers.astype(np.int64), np.array(by_u))

    return run


SCORED = "learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(layout, parents: list[Parent], learned_tokens: int, discount: float, strength: float, names):
    """One chunk: its counts and words' facts to a row for each text."""

    def run(table: pa.Table) -> pa.Table:
        _, messages = by_kind(table)
        chunk = Chunk(messages["text"][0][1])
        order, _ = chunk.by_shard(layout)
        c = np.empty(len(order), np.int64)
        c[order] = np.concatenate([unpack(parts[0], "i8") for _, parts in messages["seen"]])
        sorted_words = np.argsort(chunk.words)
        told = np.empty((1 + 3 * len(parents), len(chunk.words)), np.int64)
        told[:, sorted_words] = np.concatenate(
            [np.stack([unpack(p, "i8") for p in parts]) for _, parts in messages["stat"]], axis=1
        )
        customers, rest = told[0], told[1:].reshape(3, len(parents), -1)
        dish = expected(discount)
        mean = np.zeros(len(c))
        for parent, tables, guests, seated in zip(parents, *rest):
            p = parent.predictive(guests, seated)[chunk.w]
            new = (strength + discount * tables[chunk.u]) * p
            mean += (c - discount * dish(c, new) + new) / (strength + customers[chunk.u]) / len(parents)
        known, vocabulary = customers[chunk.tokens] > 0, parents[0].known
        base = np.log10((customers + 0.5) / (learned_tokens + 0.5 * (vocabulary + 1)))[chunk.tokens]
        starts = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1]))
        columns = (
            chunk.ids, chunk.learned, chunk.lengths, np.add.reduceat(known.astype(np.int64), starts),
            np.full(len(starts), learned_tokens), np.add.reduceat(base, starts),
            np.add.reduceat(np.log10(mean)[chunk.pair], starts),
        )
        return pa.table(dict(zip(names, map(pa.array, columns))))

    return run


def discount_of(once: float, twice: float) -> float:
    """The usual estimate from how many counts are one and two."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def score_texts(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text: str = "text",
    rounds: int = 2,
    burn: int = 2,
    samples: int = 3,
    strength: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """One row a text: id, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from rows where ``learn`` holds (null does not) and scores all rows. Words lie
    between blanks and line breaks, A-Z lowered; each text, a null or empty one too, has one end token
    more. ``score`` is the log10 probability of its tokens; ``base_score`` that of a smoothed word
    count, log10((c + 0.5) / (N + 0.5 (V + 1))) summed. Without learned rows every token has probability
    1. Repeated rows, and rows without an id, are texts of their own; other columns are not looked at.
    ``rounds`` times restaurants and parent are drawn in turn, each after ``burn`` sweeps; the last
    round gives ``samples``. Same rows in the same partitions give the same result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text).alias("body"))
    spark = docs.sparkSession
    path = scratch_path(spark, "chunks")
    encoded(rows, CHUNK_TOKENS).write.parquet(path)
    chunks = spark.read.schema(ENCODED).parquet(path)
    tokens, words = chunks.agg(F.sum("tokens"), F.sum("words")).first()
    schema = f"`{id_column}` long, {SCORED}"
    if not tokens:
        return spark.createDataFrame([], schema)
    # A chunk names words of half that share, so at least half of a word's tokens are seen here. The
    # rows are at most 4 * HOT_WORDS, as each stands for so large a share of the tokens.
    least = max(SHARD_TOKENS // 2, tokens // HOT_WORDS) // 2
    heavy = chunks.select(F.inline("heavy")).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    layout = Layout(tokens, words, [tuple(r) for r in heavy.collect()])
    text_messages = chunks.select("kind", "to", "src", "parts")
    merged = Post(grouped(text_messages.mapInArrow(send_pairs(layout), MESSAGE), merge_pairs(layout)), "pairs")
    once, twice, learned_tokens, _ = merged.totals()
    discount = discount_of(once, twice)
    up, strengths, parent_discount = merged("up"), None, 0.5
    rng = np.random.default_rng(seed)
    for turn in range(rounds):
        ranges = Post(grouped(up, seat_parent(layout, strengths, parent_discount, seed + 100 * turn)), "parent")
        known, _, guests, seated, ones, twos = totals if len(totals := ranges.totals()) == 6 else np.zeros(6)
        if turn == 0:
            parent_discount = discount_of(ones, twos)
        parent = Parent(guests, seated, known, parent_discount, strength)
        hot_tables = np.zeros(len(layout.hot), np.int64)
        for row in ranges("hot").select("parts").collect():
            hot_tables[unpack(row["parts"][0], "i8")] = unpack(row["parts"][1], "i8")
        count = samples if turn == rounds - 1 else 1
        seats = seat_shard(layout, parent, hot_tables, discount, strength, burn, count, seed + 100 * turn + 50)
        up = Post(grouped(merged("dishes").unionByName(ranges("down")), seats), "seats")("up")
        # New tables at the parent: its base gives every word the same share.
        drawn = rng.gamma(strength / parent_discount + seated, size=count)
        strengths = (parent_discount * drawn / (known + 1)).tolist()
    asks = text_messages.mapInArrow(send_words(layout), MESSAGE)
    final = Post(grouped(up.unionByName(asks), seat_parent(layout, strengths, parent_discount, seed + 1)), "words")
    totals = final.totals()
    guests, seated = totals[2 : 2 + samples], totals[2 + samples : 2 + 2 * samples]
    parents = [Parent(g, s, totals[0], parent_discount, strength) for g, s in zip(guests, seated)]
    answers = merged("seen").unionByName(final("stat")).unionByName(text_messages)
    names = [id_column, *(c.split()[0] for c in SCORED.split(", "))]
    score = score_chunk(layout, parents, int(learned_tokens), discount, strength, names)
    return answers.groupBy("to").applyInArrow(score, schema)


def perplexity(scored: DataFrame, score: str = "score") -> DataFrame:
    """Perplexity of learned and other texts: one row for each ``learned``."""
    bits = -F.sum(score) / F.sum("n_tokens")
    return scored.groupBy("learned").agg(F.pow(F.lit(10.0), bits).alias("perplexity"))
