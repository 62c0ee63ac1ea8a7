"""N-gram Jaccard join by parity sketches, and the classes of documents that its links make.

The join is exact: no link is lost to a sketch, a band or a bucket.

*Sketch.* A document's distinct shingles are hashed to 64 bits. Each flips one bit of a long sketch:
the hash picks a part of the sketch and a bit inside it, so two sketches differ in at most as many
bits as there are shingles in one set only. For similarity at least t and set sizes a and b, that
difference is at most D = (a + b)(1 - t)/(1 + t).

*Pigeonhole.* Sizes fall into bands; a band has P > D parts, so two linked documents agree in at
least P - D whole parts. A part's key is the XOR of fixed random numbers, one for each set bit.
Documents meet where a key is equal. A document near the upper end of its band also shows keys of the
next band.

*Shown parts.* A document's own size bounds its D in a band more closely. Take its parts in an order
that both of a pair know, as it only looks at equal parts: the first one that agrees has at most D
before it, as each of those differs. So D + 1 parts that are not empty are enough, and those of most
shingles are taken: an empty part, or one that holds a common line alone, is the same in very many
documents that are not alike. A document with fewer shows all it has, and again under another deal of
shingles to parts, where it meets the others of its kind; only after the last deal it shows empty ones.

*Groups.* Keys travel packed: a task sorts the keys of a chunk of documents and sends each distinct one
to a range of keys once, however many of its documents show it. Most keys have no partner and end
there; of the others, every document of the key becomes a row of its group.

*Verify.* A key shared by many documents is not expanded into pairs. Each document first meets the
smallest member of the group it shares most keys with: that of its chunk, and that of all; links are
joined into classes. Only groups that still hold several classes are looked at again: inside blocks of bounded
size the short sketches of members of different classes are compared. What sketches do not refute is
compared by whole sets; only texts of such pairs are read and dealt, each to its partners. A document
with very many partners is dealt in parts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_rows, mix64, runs, word_hashes
from daymark.llm.messages import pack, unpack
from daymark.llm.parts import joined_by_parts
from daymark.llm.sift import Sift, bits_at
from daymark.session import materialise

#: Ratio of a band's ends; spare parts in a band, as a share of D; deals of shingles to parts.
BAND, SPARE, DEALS = Fraction(3, 2), Fraction(1, 10), 4
#: Bits of a short sketch: twice the set size as a power of two, between these two.
FEWEST_BITS, MOST_BITS = 512, 4096
#: Members of one block of a group; partners of one part of a document.
BLOCK, PARTNERS = 1024, 500
#: Rows of whole blocks that are compared side by side.
HELD = 10_000
#: Groups above this size first give each member's closest partner, by one key in so many.
SMALL, FIRST_KEYS = 32, 16
#: Keys of one chunk of documents, keys that a range stands for.
CHUNK_KEYS, RANGE_KEYS = 1 << 19, 400_000
#: Bits of a key that travel; keys that agree in them by chance cost a comparison.
KEY_BITS = 56


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    Words lie between blanks and line breaks; A-Z are lowered. A text with fewer words has one
    shingle, its whole word sequence; without a word it has none.
    """
    if not text:
        return np.empty(0, np.uint64)
    # Lowering bytes changes A-Z alone.
    body = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    hashed = word_hashes(body, *runs(~((body == 32) | ((body >= 9) & (body <= 13)))))
    if not len(hashed):
        return hashed
    take = min(width, len(hashed))
    mixed = np.full(len(hashed) - take + 1, take, np.uint64)
    for k in range(take):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashed[k : len(hashed) - take + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    mixed = mix64(mixed)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def band_starts(limit: int = 1 << 40) -> np.ndarray:
    """First size of each band."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return np.array(starts)


_STARTS = band_starts()


class Bands:
    """Parts of each band for one similarity, ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def differing(self, total: int) -> int:
        """Most shingles that linked sets of ``total`` shingles together have in one set only."""
        return total * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def parts(self, band: int) -> tuple[int, int]:
        """D and P of a band: pairs meet in the band of the larger set."""
        most = int(_STARTS[band + 1]) - 1
        d = self.differing(2 * most)
        return d, d + 1 + int(np.ceil((d + 1) * SPARE))

    def own(self, size: int, band: int) -> int:
        """D of a set of ``size`` shingles and the partners that it meets in one band."""
        return self.differing(size + min(int(_STARTS[band + 1]) - 1, self.largest_partner(size)))

    def of(self, size: int) -> list[int]:
        """The set's own band and those of the larger sets it may be linked with."""
        own = int(np.searchsorted(_STARTS, size, "right")) - 1
        last = int(np.searchsorted(_STARTS, self.largest_partner(size), "right")) - 1
        return list(range(own, last + 1))


def part_keys(hashes: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Keys of the parts a set shows in one band."""
    parts, most = bands.parts(band)[1], bands.own(len(hashes), band)
    out = []
    for deal in range(DEALS):
        mixed = mix64(hashes ^ mix64(np.array([deal], np.uint64)))
        part = (mixed >> np.uint64(40)) % np.uint64(parts)
        # The bit's random number; a part has 2**40 bits, too many to store but not to XOR.
        number = mix64((mixed & np.uint64((1 << 40) - 1)) + (part << np.uint64(40)) + np.uint64(1))
        # Numbers of 16 bits sort by radix.
        part = part.astype(np.uint16) if parts < 65536 else part
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_part[1:] != sorted_part[:-1])))
        keys = np.bitwise_xor.reduceat(number[order], first)
        shown = sorted_part[first].astype(np.uint64)
        enough = len(shown) > most
        if enough:
            held = np.minimum(np.diff(first, append=len(part)), 127).astype(np.int8)
            taken = np.argsort(-held, kind="stable")[: most + 1]
            shown, keys = shown[taken], keys[taken]
        elif deal == DEALS - 1:
            missing = np.setdiff1d(np.arange(parts, dtype=np.uint64), shown)
            shown, keys = np.concatenate((shown, missing)), np.concatenate((keys, np.zeros(len(missing), np.uint64)))
        # Part, band and deal belong to the key.
        place = shown + np.uint64((band << 32) + (deal << 40)) + np.uint64(0x5851F42D4C957F2D)
        out.append(mix64(keys ^ mix64(place)))
        if enough:
            break
    return np.concatenate(out)


def short_sketch(hashes: np.ndarray, bits_a_shingle: float = 2.0) -> bytes:
    """Parity of the set in a power of two of bits."""
    bits = FEWEST_BITS
    while bits < min(bits_a_shingle * len(hashes), MOST_BITS):
        bits *= 2
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to ``size`` bytes."""
    rows = [np.frombuffer(s, np.uint64).reshape(-1, size // 8) for s in sketches]
    return np.array([np.bitwise_xor.reduce(r, axis=0) if len(r) > 1 else r[0] for r in rows]).reshape(-1, size // 8)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``size``, ``digest`` (of the whole set), ``sketch`` and its ``fold`` of rows ``id``, ``body``."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(v, width) for v in batch.column(1).to_pylist()]
            sketches = [short_sketch(h) for h in found]
            # Enough bits to refute most pairs, few enough to travel with every row of a group.
            folds = [short_sketch(h, 0.75) for h in found]
            yield [batch.column(0), [len(h) for h in found], [_digest(h) for h in found], sketches, folds]

    return map_rows(docs, run, "id long, size long, digest binary, sketch binary, fold binary")


def roots(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For rows sorted by key, then id: the smallest id of each row's key."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return np.repeat(ids[first], np.diff(first, append=len(keys)))


SENT = "to long, kind int, parts array<binary>"


def sent_keys(docs: DataFrame, width: int, percent: int, ranges: int, words: np.ndarray | None = None) -> DataFrame:
    """Rows ``id``, ``body`` to messages: the keys of each chunk, to their ranges.

    Rows of a third column ``spot`` whose bit is set in ``words`` show none.

    Of a key's documents in a chunk only the first goes to the range; the others point to it and go to
    a receiver of the chunk. Of equal sets in one task only the first shows keys.
    """
    bands, limit = Bands(percent), CHUNK_KEYS

    def chunk(number: int, ids: list, keys: list):
        order = np.argsort(ids, kind="stable")
        ids = np.array(ids, np.int64)[order]
        keys = [keys[i] for i in order]
        doc = np.repeat(ids, [len(k) for k in keys])
        key = np.concatenate(keys) >> np.uint64(64 - KEY_BITS)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        several = np.diff(np.flatnonzero(first), append=len(key)) > 1
        out = []
        if not first.all():
            rest = [key[~first], doc[~first], roots(key, doc)[~first]]
            out.append((ranges + number % ranges, 1, [pack(p) for p in rest]))
        key, doc = key[first], doc[first]
        at = (key >> np.uint64(KEY_BITS - 24)).astype(np.int64) * ranges >> 24
        edge = np.searchsorted(at, np.arange(ranges + 1))
        for q in np.flatnonzero(np.diff(edge)):
            part = slice(edge[q], edge[q + 1])
            out.append((int(q), 0, [pack(key[part]), pack(doc[part]), pack(several[part])]))
        return [list(c) for c in zip(*out)]

    def run(batches):
        from pyspark import TaskContext

        seen: set[bytes] = set()
        number, ids, keys, size = TaskContext.get().partitionId() * 7919, [], [], 0
        for batch in batches:
            if words is not None:
                batch = batch.filter(pa.array(~bits_at(words, batch.column(2).to_numpy())))
            for doc, value in zip(*(c.to_pylist() for c in batch.columns[:2])):
                hashes = shingle_set(value, width)
                digest = _digest(hashes)
                if len(hashes) and digest not in seen:
                    seen.add(digest)
                    ids.append(doc)
                    keys.append(np.concatenate([part_keys(hashes, b, bands) for b in bands.of(len(hashes))]))
                    size += len(keys[-1])
                    if size >= limit:
                        yield chunk(number, ids, keys)
                        number, ids, keys, size = number + 1, [], [], 0
        if ids:
            yield chunk(number, ids, keys)

    return map_rows(docs, run, SENT)


def gathered(table: pa.Table) -> pa.Table:
    """One receiver's messages to rows (key, id, pivot) of the keys that several documents show."""
    out = []
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "parts"))))
    for kind, parts in rows:
        if kind == 1:
            out.append([unpack(parts[0], "u8"), unpack(parts[1], "i8"), unpack(parts[2], "i8")])
    asked = [[unpack(p) for p in parts] for kind, parts in rows if kind == 0]
    if asked:
        key, doc = (np.concatenate([a[i].astype(t) for a in asked]) for i, t in ((0, "u8"), (1, "i8")))
        several = np.concatenate([a[2] for a in asked])
        order = np.lexsort((doc, key))
        key, doc, several = key[order], doc[order], several[order]
        same = key[1:] == key[:-1]
        kept = several | np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, doc = key[kept], doc[kept]
        out.append([key, doc, roots(key, doc)])
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("key", "id", "pivot"), columns)})


def groups_of(texts: DataFrame, copies: DataFrame, width: int, percent: int, shingles: int) -> DataFrame:
    """Rows (key, id, pivot) of the keys that several documents show; ``copies`` (id) show none.

    ``shingles`` of all rows together decide how many ranges there are: about 0.4 keys a shingle at a
    similarity of 0.8, more at a lower one.
    """
    ranges = 1 + int(shingles * 2 * (100 - percent) / 100) // RANGE_KEYS
    sift = Sift(copies, F.col("id"))
    sent = sent_keys(texts.select("id", "body", sift.spot(F.col("id")).alias("spot")), width, percent, ranges, sift.words)
    # Few rows, written out: a stage that looks ids up and makes keys holds two Python workers a core, and
    # an executor keeps them for all later stages.
    unsure = materialise(sift.kept(texts, F.col("id")).join(copies, "id", "left_anti").select("id", "body"), "unsure")
    sent = sent.unionByName(sent_keys(unsure, width, percent, ranges))
    return sent.groupBy("to").applyInArrow(gathered, "key long, id long, pivot long")


def _digest(hashes: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(hashes.tobytes(), digest_size=16).digest()


def close_pairs(rows: dict[str, np.ndarray], sketches: list[bytes] | None, percent: int, best: bool) -> list[tuple]:
    """Pairs of one block and different classes whose sizes and sketches allow a link.

    Rows are sorted by block; each is compared with the ones after it, all blocks side by side. A
    block holds one or two parts of a group; with two, pairs lie across them. ``best`` returns only
    each member's closest partner. Without ``sketches`` the sizes decide alone.
    """
    block, ids, classes, sizes, parts, across = (rows[c] for c in ("block", "id", "class", "size", "part", "across"))
    n, found = len(ids), []
    words = folded(sketches, FEWEST_BITS // 8) if sketches is not None else None
    lengths = np.array([len(x) for x in sketches]) if sketches is not None else None
    # Rows whose sketch is that long, folded to each length that two of them may share.
    longer = {}
    if sketches is not None:
        for size in np.unique(lengths[lengths > FEWEST_BITS // 8]):
            have = np.flatnonzero(lengths >= size)
            place = np.full(n, -1)
            place[have] = np.arange(len(have))
            longer[int(size)] = (place, folded([sketches[i] for i in have], int(size)))
    closest = np.full(n, 1 << 30)
    partner = np.full(n, -1)
    i = np.arange(n)
    for step in range(1, n):
        i = i[i + step < n]
        i = i[block[i] == block[i + step]]
        if not len(i):
            break
        a = i[(classes[i] != classes[i + step]) & (~across[i] | (parts[i] != parts[i + step]))]
        b = a + step
        x, y = sizes[a], sizes[b]
        fits = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        a, b = a[fits], b[fits]
        if words is None:
            found += zip(ids[a].tolist(), ids[b].tolist())
            continue
        most = (100 - percent) * (sizes[a] + sizes[b]) // (100 + percent)
        differing = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        fits = differing <= most
        a, b, most, differing = a[fits], b[fits], most[fits], differing[fits]
        # Long sketches say more than their folded form.
        shared = np.minimum(lengths[a], lengths[b])
        for size in np.unique(shared[shared > FEWEST_BITS // 8]):
            at = np.flatnonzero(shared == size)
            place, rows_of = longer[int(size)]
            gap = rows_of[place[a[at]]] ^ rows_of[place[b[at]]]
            differing[at] = np.bitwise_count(gap).sum(axis=1, dtype=np.int64)
        fits = differing <= most
        a, b, differing = a[fits], b[fits], differing[fits]
        if not best:
            found += zip(ids[a].tolist(), ids[b].tolist())
            continue
        for one, two in ((a, b), (b, a)):
            nearer = differing < closest[one]
            closest[one[nearer]], partner[one[nearer]] = differing[nearer], two[nearer]
    if best:
        have = np.flatnonzero(partner >= 0)
        found = list(zip(ids[have].tolist(), ids[partner[have]].tolist()))
    return found


def compare_blocks(percent: int, best: bool):
    """Stream of rows sorted by block to candidate pairs; a block is never cut."""
    names = ("key", "x", "y", "id", "class", "size", "part")

    def pairs(table: pa.Table):
        rows = {c: table.column(c).to_numpy() for c in names}
        new = np.zeros(table.num_rows, np.int64)
        for c in ("key", "x", "y"):
            new[1:] |= rows[c][1:] != rows[c][:-1]
        rows["block"], rows["across"] = np.cumsum(new), rows["x"] != rows["y"]
        sketches = table.column("sketch").to_pylist() if "sketch" in table.column_names else None
        out = close_pairs(rows, sketches, percent, best and sketches is not None)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < HELD:
                continue
            last = held.num_rows - 1
            ends = [held.column(c)[last].as_py() for c in ("key", "x", "y")]
            keys = [held.column(c).to_numpy() for c in ("key", "x", "y")]
            other = np.flatnonzero((keys[0] != ends[0]) | (keys[1] != ends[1]) | (keys[2] != ends[2]))
            start = int(other[-1]) + 1 if len(other) else 0
            if start:
                yield pairs(held.slice(0, start))
                held = held.slice(start)
        if held is not None and held.num_rows > 1:
            yield pairs(held)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Join:
    """State of one run: sets and groups that still matter, and classes found so far."""

    def __init__(self, docs: DataFrame, id_column: str, text: str, width: int, percent: int):
        self.width, self.percent = width, percent
        self.links: DataFrame | None = None
        self.classes: DataFrame | None = None
        self.texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("body"))
        self.sets = materialise(sketched(self.texts, width), "sketched")
        # Equal sets are one class at once; only the smallest id of each goes on. The copies of one
        # set, which may be a large part of all rows, meet their first in parts.
        slim = self.sets.select("id", "size", "digest")
        # One row an id, dealt once: every look-up of sketches reads it.
        firsts = self.sets.select("id", "size", "sketch", "fold").dropDuplicates(["id"])
        self.firsts = materialise(firsts, "firsts")
        first = slim.filter("size > 0").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        told = joined_by_parts(slim, first.filter("n > 1"), "digest", "n", "left")
        self.members = materialise(told.select("id", "size", F.coalesce("first", "id").alias("rep")), "members")
        copies = self.members.filter("rep <> id").select("id").distinct()
        shingles = self.members.agg(F.sum("size")).first()[0] or 0
        self.groups = materialise(groups_of(self.texts, copies, width, percent, shingles), "groups")

    def class_of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """Add the class of ``column``: the smallest id reached so far, itself without a link."""
        if self.classes is None:
            return rows.withColumn(name, F.col(column))
        known = self.classes.select(F.col("node").alias(column), F.col("component").alias(name))
        return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs by their whole sets and join the links into classes.

        Only texts of these pairs are read. A text goes to each of its partners' groups; the tree of
        a group and the blocks keep the number of partners small.
        """
        width, percent = self.width, self.percent
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        ordered = materialise(ordered, "pairs")
        if ordered.isEmpty():
            return
        # A centre with many partners has parts, and its text is there once for each.
        centres = ordered.groupBy("b").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PARTNERS).cast("int"))
        parted = joined_by_parts(ordered, centres, "b", "n").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
        wanted = parted.select(F.col("a").alias("id"), "b", "part").unionByName(
            centres.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        )
        wanted = materialise(wanted, "wanted")
        texts = Sift(wanted.select("id").distinct(), F.col("id")).kept(self.texts, F.col("id"))
        # The text of a centre with many parts is sent that often, from one place: parts are PARTNERS large.
        dealt = wanted.join(texts, "id").select("b", "part", (F.col("id") != F.col("b")).alias("other"), "id", "body")
        order = ["b", "part", "other", "id"]
        dealt = dealt.repartition("b", "part").sortWithinPartitions(*order)

        def run(batches):
            centre, held = None, []
            for batch in batches:
                out = []
                for b, part, other, doc, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if (b, part) != centre:
                        centre, held = (b, part), []
                    hashes = shingle_set(body, width)
                    if not other:
                        held.append(hashes)
                    elif any(linked(hashes, h, percent) for h in held):
                        out.append((doc, b))
                yield [list(c) for c in zip(*out)] if out else [[], []]

        links = materialise(map_rows(dealt, run, "a long, b long"), "links")
        if not links.isEmpty():
            self.links = links if self.links is None else self.links.union(links)
            self.classes = components(self.links)

    def nearest(self) -> DataFrame:
        """Each document with the member it shares most keys with, and with that one's own."""
        met = self.groups.filter("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"))
        best = met.groupBy("id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best"))
        best = materialise(best.select(F.col("id").alias("a"), (-F.col("best.p")).alias("b")), "nearest")
        degrees = best.groupBy("b").agg(F.count("*").alias("n"))
        further = degrees.join(best.select(F.col("a").alias("b"), F.col("b").alias("beyond")), "b")
        return best.unionByName(joined_by_parts(best, further, "b", "n").select("a", F.col("beyond").alias("b")))

    def mixed(self) -> DataFrame:
        """Members of groups that still hold several classes, with the size of the group.

        Classes only grow, so a group that is left out here is not looked at again.
        """
        classed = self.class_of(self.groups.select("key", "id"), "id", "class")
        several = classed.groupBy("key").agg(
            F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")
        ).filter("lo <> hi").select("key", "n")
        self.groups = materialise(classed.join(several, "key"), "mixed")
        return self.groups

    def compare(self, mixed: DataFrame, best: bool) -> None:
        """Verify pairs of different classes inside the mixed groups, block by block.

        Rows carry short sketches, as most pairs fall by them. ``best`` joins large families cheaply, by each
        member's closest partner in some of the large groups; every pair of classes that this leaves is
        met without it.
        """
        percent = self.percent
        order = ["key", "x", "y"]
        if best:
            mixed = mixed.filter((F.col("n") > SMALL) & (F.pmod(F.xxhash64("key"), F.lit(FIRST_KEYS)) == 0))
        rest = mixed.join(self.firsts.select("id", "size", F.col("fold").alias("sketch")), "id")
        middle = rest.filter(F.col("n") <= BLOCK).select("key", "id", "class", "size", "sketch", F.lit(0).alias("part"))
        middle = middle.withColumns({"x": F.lit(0), "y": F.lit(0)})
        # Groups above one block: every pair of parts is one block.
        parts = F.ceil(F.col("n") * 2 / BLOCK).cast("int")
        part = F.pmod(F.xxhash64("id"), parts).cast("int")
        large = rest.filter(F.col("n") > BLOCK).select(
            "key", "id", "class", "size", "sketch", part.alias("part"),
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
        )
        large = large.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("other")
        blocks = middle.unionByName(large).repartition(*order).sortWithinPartitions(*order)
        pairs = blocks.mapInArrow(compare_blocks(percent, best), "a long, b long")
        # The short sketches have been compared.
        self.verify(self.unrefuted(pairs, ("sketch",)))

    def unrefuted(self, pairs: DataFrame, sketches: tuple[str, ...] = ("fold", "sketch")) -> DataFrame:
        """Distinct pairs whose sketches differ in few enough bits: the short ones first."""
        bands = Bands(self.percent)
        sided = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

        def run(batches):
            for batch in batches:
                a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
                keep = []
                for i in range(len(a)):
                    words = folded([sa[i], sb[i]], min(len(sa[i]), len(sb[i])))
                    if int(np.bitwise_count(words[0] ^ words[1]).sum()) <= bands.differing(na[i] + nb[i]):
                        keep.append(i)
                yield [[a[i] for i in keep], [b[i] for i in keep]]

        for sketch in sketches:
            if sketch != sketches[0]:
                # Small tables are joined without a shuffle; written out, no stage compares twice.
                sided = materialise(sided, "unrefuted")
            for side in "ab":
                told = self.firsts.select(
                    F.col("id").alias(side), F.col("size").alias(f"n{side}"), F.col(sketch).alias(f"s{side}")
                )
                if (sketch, side) == ("fold", "b"):
                    # The smaller id of a pair may be that of very many; it is looked up in parts.
                    sided = materialise(sided, "sided")
                    often = sided.groupBy("b").agg(F.count("*").alias("often"))
                    sided = joined_by_parts(sided, often.join(told, "b"), "b", "often").drop("often")
                else:
                    sided = sided.join(told, side)
            sided = map_rows(sided.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long")
        return sided


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest id of its class) of every node of ``links`` (a, b).

    Rounds of large-star and small-star edges, each written out: every node's neighbours move to its
    smallest neighbour until all edges are stars. A star's centre is counted by key on both sides,
    so its many edges are aggregated before they are dealt.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each larger neighbour of u is joined to u's smallest.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large-star")
        # Small star: u and its smaller neighbours are joined to the smallest of them.
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(
            small.union(centre.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star"
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select("v").distinct()
    return materialise(
        edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
            roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
        ),
        "classes",
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row a document: id, ``n_shingles``, ``component_id`` (smallest id of its class).

    Two documents are linked when the Jaccard similarity of their shingle sets is at least
    ``percent`` / 100. Null texts and texts without a word have no shingles and stand alone. Ids are
    taken as keys: repeated rows are returned as often, rows without an id are classes of their own
    with a null ``component_id``. Other columns are not looked at.
    """
    known = docs.filter(F.col(id_column).isNotNull())
    join = Join(known, id_column, text, width, percent)
    # One partner each: most classes close here.
    join.verify(join.unrefuted(join.nearest()))
    # Then the closest member of another class, and at last all that are left.
    for best in (True, False):
        join.compare(join.mixed(), best)
    out = join.class_of(join.members, "rep", "component").select("id", "size", "component")
    unknown = docs.filter(F.col(id_column).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.col(text).alias("body")
    )
    alone = sketched(unknown, width).select("id", "size", F.lit(None).cast("long").alias("component"))
    return out.union(alone).select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"), F.col("component").alias("component_id")
    )
