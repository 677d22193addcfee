"""Duplicate spans by suffix arrays: induced sorting within shards, permuted common prefixes, spans back to documents.

Every window of `length` bytes belongs to the k-gram in it with the smallest hash (leftmost on ties), so equal windows
belong to equal k-grams. Runs of windows with one k-gram form a segment; segments are sharded by the k-gram's hash,
equal ones of one slice of documents being sent once. A shard drops k-grams that one document alone has, settles equal
segments at once, and puts the rest into a suffix array, in which equal windows are neighbours.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

LENGTH = 50
GRAM = 20
#: Bytes of text in a slice, and bytes of packed text for each shard, about.
SLICE, SHARD = 2 << 20, 4 << 20
#: Stands for a null id, below all others.
NO_ID = -(2**63)
#: Stands between texts in a shard's array; UTF-8 has no such byte.
BREAK = 0xFF
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64)


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _induce(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Induced sorting of all suffixes from leftmost-smaller ones in the order given; a bucket at a time, each in bulk.

    Linear: every suffix is placed once, by stable sorts of 16-bit symbols, which numpy does by radix.
    """
    firsts = s[seeds]
    order = np.argsort(firsts, kind="stable")
    ends = np.searchsorted(firsts[order], np.arange(sigma + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def place(at: np.ndarray, c: int, s_type: bool, into: list[list[np.ndarray]]) -> np.ndarray:
        """The predecessors of the suffixes at, to their buckets; returns those that stay in bucket c."""
        before = at[at > 0] - 1
        before = before[is_s[before] == s_type]
        to = s[before]
        stay = before[to == c]
        before, to = before[to != c], to[to != c]
        if len(to):
            order = np.argsort(to, kind="stable")
            to, before = to[order], before[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for x, part in zip(to[np.concatenate(([0], cuts))].tolist(), np.split(before, cuts), strict=True):
                into[x].append(part)
        return stay

    for c in range(sigma):
        done, turn = [np.concatenate(larger[c])] if larger[c] else [], 0
        while turn < len(done):
            # parts are scanned in the order in which they were placed
            stay = place(done[turn], c, False, larger)
            if len(stay):
                done.append(stay)
            turn += 1
        larger[c] = done
        place(seeds[order[ends[c] : ends[c + 1]]], c, False, larger)
    for c in range(sigma - 1, -1, -1):
        done, turn = [np.concatenate(smaller[c])] if smaller[c] else [], 0
        while turn < len(done):
            stay = place(done[turn], c, True, smaller)
            if len(stay):
                done.append(stay)
            turn += 1
        smaller[c] = done
        if larger[c]:
            place(np.concatenate(larger[c])[::-1], c, True, smaller)
    out = [np.array([len(s) - 1])]  # the end of the text, which nothing precedes
    for c in range(sigma):
        out += larger[c]
        out += [part[::-1] for part in reversed(smaller[c])]
    return np.concatenate(out)


def _names(s: np.ndarray, at: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """1 where a leftmost-smaller substring (sorted; from at, up to and with stops) differs from the one before."""
    new = np.ones(len(at), np.int64)
    a, b = at[1:], at[:-1]
    size = stops[1:] - a
    same = np.flatnonzero(size == stops[:-1] - b)
    k = 0
    while len(same):
        same = same[s[a[same] + k] == s[b[same] + k]]
        over = size[same] == k
        new[same[over] + 1] = 0
        same = same[~over]
        k += 1
    return np.cumsum(new) - 1


def _induce_each(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The same, a suffix at a time: for alphabets so large that buckets hold a few suffixes each."""
    sizes = np.bincount(s, minlength=sigma)
    stops = np.cumsum(sizes)
    text, smaller, out = s.tolist(), is_s.tolist(), [-1] * len(s)
    ends = stops.tolist()
    for i in seeds[::-1].tolist():
        ends[text[i]] -= 1
        out[ends[text[i]]] = i
    heads = (stops - sizes).tolist()
    for i in range(len(out)):
        j = out[i] - 1
        if j >= 0 and not smaller[j]:
            out[heads[text[j]]] = j
            heads[text[j]] += 1
    ends = stops.tolist()
    for i in range(len(out) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and smaller[j]:
            ends[text[j]] -= 1
            out[ends[text[j]]] = j
    return np.array(out)


#: Largest alphabet that is induced a bucket at a time.
BUCKETS = 512


def _leftmost_smaller(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of t (its last symbol is the smallest) are smaller than the next one, and where such runs begin."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    rise[-1] = 1
    where = np.where(rise != 0, np.arange(n), n)  # the next place where it changes decides
    is_s = rise[np.minimum.accumulate(where[::-1])[::-1]] > 0
    is_s[-1], is_s[-2] = True, False
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _sort_substrings(t: np.ndarray, is_s: np.ndarray, at: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Names, by rank, of the substrings from at up to and with stops, for large alphabets: by two symbols at a time (each with its type), ties on."""
    value = 2 * t.astype(np.int64) + is_s + 1
    base, names = int(value.max()) + 1, np.zeros(len(at), np.int64)
    step = lambda i, k: np.where(at[i] + k <= stops[i], value[np.minimum(at[i] + k, stops[i])], 0)
    open_, k = np.arange(len(at)), 0
    while len(open_):
        key = (names[open_] * base + step(open_, k)) * base + step(open_, k + 1)
        order = np.argsort(key)
        ranked, first = key[order], np.concatenate(([True], np.diff(key[order]) != 0))
        group = np.flatnonzero(first)
        # a group's rank is how many substrings come before it: its old rank, and those of the same old rank with smaller keys
        old = names[open_][order]
        start = np.concatenate(([True], np.diff(old) != 0))
        within = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        names[open_[order]] = old + within[group][np.cumsum(first) - 1]
        k += 2
        sizes = np.diff(np.append(group, len(ranked)))
        open_ = open_[order[np.repeat(sizes > 1, sizes)]]
        open_ = open_[at[open_] + k <= stops[open_]]
    return np.unique(names, return_inverse=True)[1]


def suffix_array(s: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of s (integers from 0) in order.

    Suffixes are classified, leftmost-smaller substrings are sorted (by induction; in large alphabets by their symbols) and named, the
    string of names is sorted recursively unless all differ, and the order of all suffixes is induced from it. A string of
    names is at most half as long as its text, so all levels together are linear.
    """
    sigma = (int(s.max()) + 1 if len(s) else 1) + 1 if sigma is None else sigma + 1
    n = len(s) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    small = sigma <= BUCKETS
    t = np.zeros(n, np.int16 if small else np.int64)
    t[:-1] = s.astype(t.dtype) + 1
    is_s, lms = _leftmost_smaller(t)
    stops = np.full(n, n - 1)
    stops[lms[:-1]] = lms[1:]
    if small:
        first, marked = _induce(t, is_s, lms, sigma), np.zeros(n, bool)
        marked[lms] = True
        ordered = first[marked[first]]
        named = np.empty(n, np.int64)
        named[ordered] = _names(t, ordered, stops[ordered])
        names = named[lms]
    else:
        names = _sort_substrings(t, is_s, lms, stops[lms])
    ordered = lms[np.argsort(names) if int(names.max()) == len(lms) - 1 else suffix_array(names)]
    return (_induce if small else _induce_each)(t, is_s, ordered, sigma)[1:]


def permuted_common(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position in text order, the length (up to `most`) of its common prefix with the suffix before it in `order`;
    the permuted array of longest common prefixes. Eight bytes are compared at a time; 0 for the first and for what isn't in order."""
    before = np.full(len(s), -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(s), np.int64)
    at = np.flatnonzero(before >= 0)
    padded = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.ndarray(len(s) + 1, "<u8", padded.tobytes(), strides=(1,))
    limit = np.minimum(len(s) - np.maximum(at, before[at]), most)  # common prefixes end with the text
    k = 0
    while len(at):
        here, there = np.minimum(at + k, len(s)), np.minimum(before[at] + k, len(s))
        differ = word[here] ^ word[there]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        done = (equal < 8) | (k + 8 >= limit)
        common[at[done]] = np.minimum(k + equal[done], limit[done])
        at, limit = at[~done], limit[~done]
        k += 8
    return common


# ---- segments ------------------------------------------------------------------------------------------------------


def _grams(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each position."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    one, size, power = _TABLE[buf], 1, factor
    out, done = None, 0
    with np.errstate(over="ignore"):
        while size <= k:
            if k & size:
                if out is None:
                    out = one[: len(buf) - size + 1]
                else:
                    m = len(buf) - done - size + 1
                    out = out[:m] * power + one[done : done + m]
                done += size
            one = one[: len(one) - size] * power + one[size:] if len(one) > size else one[:0]
            power, size = power * power, size * 2
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def segments(buf: np.ndarray, stops: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest k-gram: first window, number of windows, the k-gram's hash. stops: ends of the texts in buf."""
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _grams(buf, gram)
    low = (h & ~np.uint64((1 << 28) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    low &= np.uint64((1 << 28) - 1)
    valid = np.ones(len(low) + 1, bool)
    valid[-1] = False
    for k in stops[:-1].tolist():
        valid[max(k - length + 1, 0) : k] = False
    change = np.flatnonzero(np.diff(low) != 0) + 1
    edge = np.zeros(len(low) + 1, bool)
    edge[change] = True
    edge[0] = True
    edge[1:] |= valid[:-1] != valid[1:]
    cuts = np.flatnonzero(edge)
    cuts = cuts[cuts < len(low)]
    runs = np.diff(np.append(cuts, len(low)))
    good = valid[cuts]
    return cuts[good], runs[good], h[low[cuts[good]].astype(np.int64)]


def _zip(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unzip(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes of text (of one document at least): slice, and its ids and texts as one payload."""
    part, turn, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

    def made() -> pa.RecordBatch:
        payload = _zip(np.array(ids, np.int64), np.array([len(x) for x in held], np.int64), b"".join(held))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + turn]), pa.array([payload], pa.binary())], names=["slice", "payload"])

    for b in batches:
        for lo in range(0, b.num_rows, 256):
            some = b.slice(lo, 256)
            for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NO_ID if doc is None else doc)
                held.append(text)
                size += len(text)
                if size >= SLICE:
                    yield made()
                    turn, ids, held, size = turn + 1, [], [], 0
    if held:
        yield made()


def _runs(whole: bytes, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """segments() of a slice and the row of each; a very long text goes in pieces that overlap by a window less one."""
    stops, out = np.cumsum(sizes), []
    if len(whole) <= 4 * SLICE:
        out.append(segments(np.frombuffer(whole, np.uint8), stops, length, gram))
    else:
        for start, stop in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
            for lo in range(start, stop, 4 * SLICE):
                piece = whole[lo : min(stop, lo + 4 * SLICE + length - 1)]
                at, run, h = segments(np.frombuffer(piece, np.uint8), np.array([len(piece)]), length, gram)
                out.append((at + lo, run, h))
    at, run, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, run, h, np.searchsorted(stops, at, side="right")


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _keys(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32-bit key of each k-gram's hash. Keys of different k-grams may agree, which costs work but no result."""
    return (h % np.uint64(shards)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


def _planes(x: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte, which compresses well."""
    return np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _anchors(batches: Iterator[pa.RecordBatch], shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each slice and shard: the distinct keys of its segments, and which of them two documents of the slice have."""
    for b in batches:
        for name, raw in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
            ids, sizes, whole = _unzip(raw)
            _, _, h, row = _runs(whole, sizes, length, gram)
            shard, key = _keys(h, shards)
            doc, names, blobs = ids[row], [], []
            for s, at in _by_shard(shard, shards):
                order = at[np.argsort(key[at], kind="stable")]
                first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
                twice = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
                names.append(s)
                blobs.append(_zip(_planes(key[order][first]), np.packbits(twice)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([name] * len(names), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "slice", "blob"])


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Of a shard's keys, those that two slices have, or two documents of one slice; back to each slice that has them."""
    keys, twice = [], []
    for raw in group["blob"]:
        planes, marks = _unzip(raw)
        keys.append(_from_planes(planes))
        twice.append(np.unpackbits(marks, count=len(keys[-1])).astype(bool))
    all_keys = np.sort(np.concatenate(keys))
    shared = np.unique(np.concatenate([all_keys[1:][all_keys[1:] == all_keys[:-1]], *(k[t] for k, t in zip(keys, twice, strict=True))]))
    out = [(name, shard, _planes(found)) for name, shard, k in zip(group["slice"], group["shard"], keys, strict=True) if len(found := k[np.isin(k, shared, assume_unique=True)])]
    return pd.DataFrame(out, columns=["slice", "shard", "keys"])


def _shard_out(batches: Iterator[pa.RecordBatch], shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The segments with repeated keys, by shard. Equal segments of a slice are sent once, for the smallest id; under larger ids they are settled."""
    for b in batches:
        for name, raw, found in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), b.column("found").to_pylist(), strict=True):
            if found is None:  # no repeated key in this slice
                continue
            ids, sizes, whole = _unzip(raw)
            at, run, h, row = _runs(whole, sizes, length, gram)
            shard, key = _keys(h, shards)
            known = np.sort(np.concatenate([(np.uint64(x["shard"]) << np.uint64(32)) | _from_planes(x["keys"]).astype(np.uint64) for x in found]))
            mine = (shard.astype(np.uint64) << np.uint64(32)) | key
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            idx = np.flatnonzero(known[place] == mine)
            idx = idx[np.argsort(ids[row[idx]], kind="stable")]  # the smallest id comes first
            at, run, key, row, shard = at[idx], run[idx], key[idx], row[idx], shard[idx]
            content = [whole[x:y] for x, y in zip(at.tolist(), (at + run + length - 1).tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            first = np.fromiter((seen.setdefault(c, i) for i, c in enumerate(content)), np.int64, len(content))
            doc, pos = ids[row], at - (np.cumsum(sizes) - sizes)[row]
            later = doc[first] < doc
            names, blobs = [], []
            for s, some in _by_shard(shard, shards):
                done, sent = some[later[some]], some[~later[some]]
                settled = (row[done].astype(np.uint32), pos[done].astype(np.uint32), run[done].astype(np.uint8))
                names.append(s)
                blobs.append(_zip(settled, doc[sent], row[sent].astype(np.uint32), pos[sent].astype(np.uint32), run[sent].astype(np.uint8), key[sent], b"".join([content[i] for i in sent.tolist()])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([name] * len(names), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "slice", "blob"])


def _least(content: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For distinct segments and the smallest document of each: the smallest document of every window, by suffix array."""
    sizes = np.array([len(c) for c in content], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    s = np.frombuffer(bytes([BREAK]).join(content), np.uint8)
    order = suffix_array(s, sigma=257)
    windows = sizes - length + 1
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    owner = np.full(len(s), -1, np.int64)
    owner[at] = np.repeat(np.arange(len(content)), windows)
    order = order[owner[order] >= 0]
    same = permuted_common(s, order, length)[order] >= length
    group = np.cumsum(~same) - 1
    found = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(found, group, least[owner[order]])
    by_place = np.empty(len(s), np.int64)
    by_place[order] = found[group]
    return np.split(by_place[at], np.cumsum(windows)[:-1])


def _settle(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """All segments of a shard: for each slice the removed windows, as row, first window and end."""
    marks: list[tuple[np.ndarray, ...]] = []  # slice, row, first window, end
    parts, contents = [], []
    for name, raw in zip(group["slice"], group["blob"], strict=True):
        (row, pos, run), *sent, content = _unzip(raw)
        marks.append((np.full(len(row), name, np.int64), row.astype(np.int64), pos.astype(np.int64), pos.astype(np.int64) + run))
        run = sent[3].astype(np.int64)
        parts.append((np.full(len(run), name, np.int64), sent[0], sent[1].astype(np.int64), sent[2].astype(np.int64), run, sent[4], np.full(len(run), len(contents)), np.cumsum(run + length - 1)))
        contents.append(content)
    slice_, doc, row, pos, run, gram, blob, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(doc):
        order = np.argsort(gram, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(gram[order]) != 0)))
        lo, hi = np.minimum.reduceat(doc[order], edges), np.maximum.reduceat(doc[order], edges)
        idx = order[np.repeat(lo != hi, np.diff(np.append(edges, len(order))))]
        of = [contents[b][e - r - length + 1 : e] for b, e, r in zip(blob[idx].tolist(), stop[idx].tolist(), run[idx].tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        name = np.fromiter((seen.setdefault(c, len(seen)) for c in of), np.int64, len(of))
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, name, doc[idx])
        later = least[name] < doc[idx]
        done = idx[later]
        marks.append((slice_[done], row[done], pos[done], pos[done] + run[done]))
        # segments whose k-gram has other bytes around it elsewhere
        gram_of = np.empty(len(seen), np.uint32)
        gram_of[name] = gram[idx]
        _, which, times = np.unique(gram_of, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(times[which] > 1)
        if len(mixed):
            texts_of, place = list(seen), np.full(len(seen), -1)
            place[mixed] = np.arange(len(mixed))
            windows = _least([texts_of[i] for i in mixed.tolist()], least[mixed], length)
            for i in np.flatnonzero(~later & (place[name] >= 0)).tolist():
                gone = windows[place[name[i]]] < doc[idx[i]]
                if gone.any():
                    cut = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    k, n = idx[i], len(cut) // 2
                    marks.append((np.full(n, slice_[k]), np.full(n, row[k]), pos[k] + cut[::2], pos[k] + cut[1::2]))
    slice_, row, start, end = (np.concatenate(x) for x in zip(*marks, strict=True))
    order = np.argsort(slice_, kind="stable")
    cuts = np.flatnonzero(np.diff(slice_[order])) + 1
    out = [(int(slice_[at[0]]), _zip(row[at].astype(np.uint32), start[at].astype(np.uint32), end[at].astype(np.uint32))) for at in np.split(order, cuts) if len(at)]
    return pd.DataFrame(out, columns=["slice", "marks"])


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every document of a slice without the bytes of its removed windows."""
    for b in batches:
        for raw, marks in zip(b.column("payload").to_pylist(), b.column("marks").to_pylist(), strict=True):
            ids, sizes, whole = _unzip(raw)
            starts = np.cumsum(sizes) - sizes
            depth = np.zeros(len(whole) + 1, np.int32)
            for row, start, end in map(_unzip, marks or []):
                np.add.at(depth, starts[row] + start, 1)
                np.add.at(depth, starts[row] + end + length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            out = []
            for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                cut, text = gone[lo : lo + n], whole[lo : lo + n]
                if cut.any():
                    text = np.frombuffer(text, np.uint8)[~cut].tobytes()
                runs = np.count_nonzero(np.diff(np.concatenate(([0], cut.view(np.int8)))) > 0)
                out.append((n, n - len(text), runs, hashlib.sha256(text).hexdigest(), text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            doc = pa.array(ids, pa.int64(), mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays([doc, *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each document.

    A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. Null texts are
    empty; texts shorter than length keep all; null ids are below all others and equal to each other; rows with one
    id are one document as sources, and each is cleaned by itself; an empty table gives no rows; other columns go.
    A k-gram in very many different surroundings keeps their distinct segments in one shard.
    """
    slices = stored(texts(docs).mapInArrow(_slices, "slice long, payload binary"), "text-slices")
    total = slices.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    how = {"shards": shards, "length": length, "gram": gram}
    anchors = slices.mapInArrow(partial(_anchors, **how), "shard int, slice long, blob binary")
    shared = anchors.groupBy("shard").applyInPandas(_repeated, "slice long, shard int, keys binary")
    shared = shared.groupBy("slice").agg(F.collect_list(F.struct("shard", "keys")).alias("found"))
    # a left join like the last one, so that both read the same shuffled slices
    sent = slices.join(shared, "slice", "left").mapInArrow(partial(_shard_out, **how), "shard int, slice long, blob binary")
    marks = sent.groupBy("shard").applyInPandas(partial(_settle, length=length), "slice long, marks binary")
    marks = marks.groupBy("slice").agg(F.collect_list("marks").alias("marks"))
    return slices.join(marks, "slice", "left").mapInArrow(partial(_finish, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
