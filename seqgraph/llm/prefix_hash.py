"""Document fingerprints from prefix polynomial hashes.

The prefix sums of code points times powers of a base, modulo a prime, answer for any two spans whether they are equal,
and by binary search how far two positions agree. A fingerprint is the hash of the whole text and, for each of 128 bins
of span hashes, eight bits of the least hash: of two fingerprints, the share of equal bins tells how many spans the texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, texts

PRIME = (1 << 31) - 1
BASES = (1_091_817_373, 1_702_348_019)
#: Code points of a span.
SPAN = 8
#: Bins of a fingerprint; each is a byte, zero where no span fell.
BINS = 128
#: Code points that are hashed at a time: longer texts go in overlapping pieces.
PIECE = 1 << 16
#: Code points of the documents that are worked on together, unless one is longer.
GROUP = 1 << 18
_NONE = np.iinfo(np.uint64).max
_P, _BITS = np.uint64(PRIME), np.uint64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x (below 2 ** 62) modulo PRIME, in place; zero may come out as PRIME."""
    for _ in range(2):
        high = x >> _BITS
        x &= _P
        x += high
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n modulo PRIME, by doubling."""
    out = np.ones(n + 1, np.uint64)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % _P
        done += more
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixHashes:
    """The prefix arrays of a string of code points, one for each base."""

    def __init__(self, points: np.ndarray):
        self.n, self.sums, self.back = len(points), [], []
        size = max(PIECE + SPAN, 1 << self.n.bit_length())  # few sizes, so that tables of powers are shared
        for base in BASES:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_reduced((points + np.uint64(1)) * _powers(base, size)[: self.n]), out=sums[1:])  # fewer than 2 ** 31 terms: no overflow
            self.sums.append(_reduced(sums))
            self.back.append(_powers(pow(base, -1, PRIME), size))

    def spans(self, start: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """62 bits for each span: equal strings have equal hashes wherever they stand. A slice of starts is quicker than an array."""
        stop = slice(start.start + length, start.stop + length) if isinstance(start, slice) else start + length
        out = None
        for sums, back in zip(self.sums, self.back, strict=True):
            h = sums[stop] + _P
            h -= sums[start]
            h = _reduced(h)
            h *= back[start]
            h = _reduced(h)
            h[h == _P] = 0
            out = h if out is None else (out << _BITS) | h
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.spans(i, length) == self.spans(j, length)

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many code points from i and from j on are the same, at most most: binary search, all pairs at a time."""
        low, high = np.zeros(len(i), np.int64), np.array(most, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def common_prefixes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each pair: windows that grow while they agree, the last one by extension()."""
    found, at, window = np.zeros(len(a), np.int64), list(range(len(a))), 64
    while at:
        still = []
        for lo in range(0, len(at), max(1, PIECE // (2 * window))):
            some = at[lo : lo + max(1, PIECE // (2 * window))]
            left = [a[k][found[k] : found[k] + window] for k in some]
            right = [b[k][found[k] : found[k] + window] for k in some]
            sizes = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64).ravel()
            starts = np.cumsum(sizes) - sizes
            hashes = PrefixHashes(np.concatenate([p for pair in zip(left, right, strict=True) for p in pair]))
            got = hashes.extension(starts[::2], starts[1::2], np.minimum(sizes[::2], sizes[1::2]))
            found[some] += got
            still += [k for k, n in zip(some, got.tolist(), strict=True) if n == window]
        at, window = still, min(window * 8, PIECE // 2)
    return found


class _Sketches:
    """Least span hash by bin, and hashes of the wholes, for many strings given in parts."""

    def __init__(self, owners: int):
        self.least = np.full(owners * BINS, _NONE, np.uint64)
        self.wholes: list[list[tuple[int, int]]] = [[] for _ in range(owners)]
        self.queue: list[tuple[int, np.ndarray, int]] = []
        self.waiting = 0

    def add(self, owner: int, points: np.ndarray, known: int = 0) -> None:
        """All spans of points, or points as one span where they are shorter than one. The first known points are in the whole already."""
        for lo in range(0, max(1, len(points) - SPAN + 1), PIECE):
            some = points[lo : lo + PIECE + SPAN - 1]
            if self.waiting + len(some) > PIECE + SPAN:
                self.flush()
            self.queue.append((owner, some, SPAN - 1 if lo else known))
            self.waiting += len(some)

    def flush(self) -> None:
        sizes = np.array([len(p) for _, p, _ in self.queue], np.int64)
        if sizes.sum():
            owner, ends = np.array([o for o, _, _ in self.queue], np.int64), np.cumsum(sizes)
            hashes = PrefixHashes(np.concatenate([p for _, p, _ in self.queue]))
            known = np.array([k for _, _, k in self.queue], np.int64)
            for o, h, n in zip(owner.tolist(), hashes.spans(ends - sizes + known, sizes - known).tolist(), (sizes - known).tolist(), strict=True):
                self.wholes[o].append((h, n))
            short = np.flatnonzero((sizes > 0) & (sizes < SPAN) & (known == 0))
            values, keys = [hashes.spans((ends - sizes)[short], sizes[short])], [owner[short] * BINS]
            if hashes.n >= SPAN:
                inside = np.repeat(ends, sizes)[: hashes.n - SPAN + 1] - np.arange(hashes.n - SPAN + 1) >= SPAN
                values.append(hashes.spans(slice(0, hashes.n - SPAN + 1), SPAN)[inside])
                keys.append((np.repeat(owner, sizes)[: hashes.n - SPAN + 1] * BINS)[inside])
            value = np.concatenate(values)
            value *= np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
            np.minimum.at(self.least, np.concatenate(keys) + (value >> np.uint64(57)).astype(np.int64), value)
        self.queue, self.waiting = [], 0

    def done(self) -> np.ndarray:
        self.flush()
        return self.least.reshape(-1, BINS)

    def whole(self, *owners: int) -> bytes:
        """The hash of what was added to the owners, one after the other."""
        out, at = [0, 0], 0
        for o in owners:
            for h, n in self.wholes[o]:
                out = [(x + pow(b, at, PRIME) * y) % PRIME for x, b, y in zip(out, BASES, (h >> 31, h & PRIME), strict=True)]
                at += n
        return b"".join(x.to_bytes(4, "big") for x in out)


def _registers(least: np.ndarray) -> np.ndarray:
    return np.where(least == _NONE, 0, 1 + least % np.uint64(255)).astype(np.uint8)


def fingerprints_of(lists: list[np.ndarray]) -> list[bytes]:
    """The fingerprint of each string of code points: 8 bytes for the whole, then the bins."""
    sketches = _Sketches(len(lists))
    for k, points in enumerate(lists):
        sketches.add(k, points)
    bins = _registers(sketches.done())
    return [sketches.whole(k) + r.tobytes() for k, r in enumerate(bins)]


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal texts; else the share of spans that two fingerprints have in common, as their bins estimate it, without chance hits."""
    if a[:8] == b[:8]:
        return 1.0
    x, y = (np.frombuffer(f[8:], np.uint8) for f in (a, b))
    used = np.count_nonzero((x > 0) | (y > 0))
    if not used:
        return 0.0
    return max(0.0, (np.count_nonzero((x == y) & (x > 0)) / used - 1 / 255) / (1 - 1 / 255))


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, same_edited long, same_next long, part int, edge string, text string"


class _Rows:
    """Documents in order; each is told of once the next one is there."""

    def __init__(self, part: int):
        self.part, self.before, self.out = part, None, []

    def _told(self, rows: list[tuple]) -> None:
        """rows: doc_id and text first; all but the last get a result."""
        texts_ = [r[1] for r in rows]
        points = [codes(t) for t in texts_]
        cut = [len(p) - len(p) // 4 for p in points]  # the text stays up to here
        edits = [after[: len(p) - c] for p, c, after in zip(points, cut, points[1:], strict=False)]
        sketches = _Sketches(3 * len(rows))  # of each: the text, what text and edited text share, the edited text
        for k, (p, c) in enumerate(zip(points, cut, strict=True)):
            if k == len(edits):
                sketches.add(3 * k, p)
                continue
            shared = c if c >= SPAN else 0
            if shared:
                sketches.add(3 * k + 1, p[:shared])
            after = max(0, shared - SPAN + 1)
            sketches.add(3 * k, p[after:], shared - after)
            sketches.add(3 * k + 2, np.concatenate((p[after:c], edits[k])), shared - after)
        least = sketches.done().reshape(-1, 3, BINS)
        bins = _registers(np.minimum(least, least[:, 1:2]))
        prints = [sketches.whole(3 * k + 1, 3 * k) + bins[k, 0].tobytes() for k in range(len(rows))]
        same_next = common_prefixes(points[:-1], points[1:])
        same_edited = common_prefixes([p[c:] for p, c in zip(points[:-1], cut, strict=False)], edits)
        for k, after in enumerate(texts_[1:]):
            e = sketches.whole(3 * k + 1, 3 * k + 2) + bins[k, 2].tobytes()
            text = texts_[k][: cut[k]] + after[: len(points[k]) - cut[k]]
            self.out.append((rows[k][0], len(points[k]), hashlib.sha256(text.encode()).hexdigest(), prints[k], e, likeness(prints[k], e), likeness(prints[k], prints[k + 1]), cut[k] + int(same_edited[k]), int(same_next[k]), self.part, None, None))

    def feed(self, rows: list[tuple]) -> None:
        if not rows:
            return
        if self.before is None:
            self._edge("first", rows[0])
        else:
            rows = [self.before, *rows]
        if len(rows) > 1:
            self._told(rows)
        self.before = rows[-1]

    def _edge(self, which: str, row: tuple) -> None:
        self.out.append((row[0], *[None] * 8, self.part, which, row[1]))

    def close(self) -> None:
        if self.before is not None:
            self._edge("last", self.before)

    def take(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        got, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(kinds)], names=names)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows in lists of at most GROUP code points, or of one row."""
    held, size = [], 0
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in names], strict=True):
            n = sum(len(x) for x in row if isinstance(x, str))
            if held and size + n > GROUP:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _Rows(TaskContext.get().partitionId())
    for some in _groups(batches, ("doc_id", "text")):
        rows.feed(some)
        yield rows.take()
    rows.close()
    yield rows.take()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _groups(batches, ("doc_id", "text", "next_text")):
        rows = _Rows(-1)
        for doc_id, text, after in some:
            rows._told([(doc_id, text), (None, after)])
        yield rows.take()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next, same_edited, same_next for each row.

    The edited text is the text with its last quarter (rounded down) replaced by as many code points from the start of the
    next document in ascending doc_id order (null ids first; equal ids by a hash of their texts); after the last comes the first.
    near_* is the likeness() of fingerprints, same_* the length of the longest common prefix with the edited and the next text.
    Null texts are empty; two empty texts are alike (1), an empty and another aren't (0). A lone row is its own next one. Repeated rows come out each;
    an empty table gives no rows; other columns are dropped. Texts are hashed in pieces of PIECE code points.

    One range shuffle; a task tells of all its rows but the last, which waits for the first row of the next task that has any.
    """
    rows = texts(docs).withColumn("body", F.xxhash64("text"))
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("doc_id", "body", "salt").sortWithinPartitions("doc_id", "body")
    told = stored(ranged.select("doc_id", "text").mapInArrow(_printed, _FIELDS), "fingerprints")
    firsts = told.filter("edge = 'first'").select("part", F.col("text").alias("next_text"))
    order = firsts.select("part")  # a row for each task
    order = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    lasts = told.filter("edge = 'last'").select("part", "doc_id", "text").join(order, "part")
    edges = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text").mapInArrow(_pairs, _FIELDS)
    return told.filter("edge IS NULL").unionByName(edges).drop("part", "edge", "text")


def as_text(fingerprint: str) -> Column:
    return F.lower(F.hex(fingerprint))
