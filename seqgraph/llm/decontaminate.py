"""Benchmark decontamination by a generalised suffix automaton.

The normalised benchmark items become one automaton over word ids. Training documents stream through it;
after each word it knows the longest piece of any item that ends there, which gives the words hit, the
items met and the spans to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WINDOW = 13
#: Everything but digits, ASCII letters and non-ASCII bytes separates words; A-Z are lower-cased.
_NORMAL = bytes(c if c in b"0123456789" or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words of items in one automaton; a larger benchmark is matched in so many blocks.
BLOCK_WORDS = 200_000


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that each long enough state occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[str]] = [set()]
        whole: list[tuple[list[int], str]] = []
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w, owners)
                owners[last].add(name)
            if len(ids) < window:
                whole.append((ids, name))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[v]] >= window:  # shorter states are never asked for their items
                owners[self.link[v]] |= owners[v]
        self.owners = owners
        #: Short items are windows as a whole: state -> [(length, item)], taken over by the states below.
        ends: dict[int, list[tuple[int, str]]] = {}
        for ids, name in whole:
            v = 0
            for w in ids:
                v = self.next[v][w]
            ends.setdefault(v, []).append((len(ids), name))
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.length]
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ends[v] = self.ends[self.link[v]] + ends.get(v, []) if ends else []
        self.shortest = min([window, *(len(ids) for ids, _ in whole)])

    def _state(self, length: int, owners: list[set[str]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int, owners: list[set[str]]) -> int:
        clone = self._state(self.length[p] + 1, owners)
        self.next[clone], self.link[clone], self.link[q] = dict(self.next[q]), self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, owners: list[set[str]]) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, owners)
        cur, p = self._state(self.length[last] + 1, owners), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, owners)
        return cur

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) after each word; an unknown word has id -1 and matches nothing."""
        v = n = 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(ids):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(w)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
            yield i, v, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [from, to) of the words inside any window, and the items whose windows occur."""
        known = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a < self.shortest:  # no window fits between unknown words
                continue
            for i, v, n in self.stream(known[a:b].tolist()):
                reach = 0
                for k, name in self.ends[v]:
                    if k <= n:
                        reach = max(reach, k)
                        items.add(name)
                if n >= self.window:
                    reach = self.window
                    while self.length[self.link[v]] >= self.window:
                        v = self.link[v]
                    items |= self.owners[v]
                if reach:
                    lo, hi = a + i + 1 - reach, a + i + 1
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, hi))
        return spans, items


@lru_cache(maxsize=2)
def _built(items: tuple[tuple[str, bytes], ...], window: int) -> Automaton:
    return Automaton([(name, text.split(b" ") if text else []) for name, text in items], window)


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[tuple[str, bytes], ...]]:
    """The items in blocks of about block_words words, streamed to the driver in turn."""
    block, n = [], 0
    for row in bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).distinct().toLocalIterator():
        words = words_of(row["t"])
        block.append((row["i"], b" ".join(words)))
        n += len(words)
        if n >= block_words:
            yield tuple(sorted(block))
            block, n = [], 0
    yield tuple(sorted(block))


def _match(batches: Iterator[pa.RecordBatch], block, window: int, first: bool, last: bool, coverage: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Adds a block's spans and items to those of earlier blocks; the last block's call turns them into the result."""
    automaton = _built(block.value, window)
    for b in batches:
        spans, items = ([], []) if first else (b.column("_spans").to_pylist(), b.column("_items").to_pylist())
        bodies, n_words = b.column("_text").cast(pa.binary()).to_pylist(), []
        for i, text in enumerate(bodies):
            words = words_of(text)
            found, met = automaton.hits(words)
            n_words.append(len(words))
            flat = [x for s in found for x in s]
            if first:
                spans.append(flat)
                items.append(sorted(met))
            else:
                spans[i] += flat
                items[i] += sorted(met)
        rest = [n for n in b.schema.names if n not in ("_spans", "_items", "_text")]
        if last:
            cols = [_digest(*x, coverage, cut) for x in zip(bodies, n_words, spans, items, strict=True)]
            arrays = [pa.array([c[j] for c in cols], kind) for j, (_, kind) in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), *arrays], names=[*rest, *(n for n, _ in RESULT)])
        else:
            arrays = [pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), b.column("_text"), *arrays], names=[*rest, "_text", "_spans", "_items"])


RESULT = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("clean_text", pa.string()), ("item_ids", pa.list_(pa.string())))


def _digest(text: bytes, n: int, flat: list[int], items: list[str], coverage: int, cut: bool) -> tuple:
    spans, names = _merged(flat), sorted(set(items))
    hit = sum(y - x for x, y in spans)
    return n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and coverage * hit >= n, _cut(text, spans).decode() if cut else None, names


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words in spans; what stands between removed words goes too."""
    if not spans:
        return text
    form = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], form.view(np.int8), [0]))))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : edges[2 * a]])
        at = edges[2 * b - 1]
    return b"".join([*out, text[at:]])


def _merged(flat: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: int = 20, keep: tuple[str, ...] = (), cut: bool = True, block_words: int = BLOCK_WORDS, item_col: str = "item_id") -> DataFrame:
    """doc_id, kept columns, n_words, n_hit, n_items, items_sha256, contaminated, clean_text and item_ids for each document.

    A window is `window` consecutive words of an item, or a shorter item as a whole. Words inside any
    occurrence of a window are hit and absent from clean_text (null with cut=False). contaminated: a word is
    hit, and coverage * n_hit >= n_words. A benchmark of more than block_words words is matched block by
    block, each broadcast on its own. Null texts have no words; items without words are no windows; a null
    item id reads as the empty text; equal items count once each by id; empty tables give no rows or no hits;
    other columns are dropped and can't clash.
    """
    spark = docs.sparkSession
    out = texts(docs.withColumns({f"_keep_{c}": F.col(c) for c in keep}), *[f"_keep_{c}" for c in keep]).withColumnRenamed("text", "_text")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out.schema if f.name.startswith("_keep_"))
    between = f"doc_id long, {kept}_text string, _spans array<int>, _items array<string>"
    result = f"doc_id long, {kept}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string, item_ids array<string>"
    out = out.select("doc_id", *[f"_keep_{c}" for c in keep], "_text")
    blocks = _blocks(bench, item_col, "text", block_words)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        out = out.mapInArrow(partial(_match, block=spark.sparkContext.broadcast(block), window=window, first=first, last=after is None, coverage=coverage, cut=cut), between if after is not None else result)
        block, first = after, False
    return out.select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], *[n for n, _ in RESULT if n not in keep])
