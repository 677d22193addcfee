"""Token-id files: Parquet with one row for each document and its ids as a list column.

Token lists are dictionary encoded (ids repeat, the dictionary is bounded by the vocabulary), the other
columns delta encoded (they ascend or vary little). Row groups and pages are kept small, and page indexes let
a reader fetch single documents, or the metadata without any tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, texts

END = 0
FIELDS = "doc_id long, part int, at long, n_tokens long, tokens array<int>"
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
#: A worker's memory of encoded pieces (about 200 bytes each); it is emptied at this many. A speed-up only.
PIECES = 1_000_000
#: Longer pieces than this aren't remembered, so the memory has a bound in bytes too.
LONG = 64
_LETTERS = re.compile(r"[^\W\d_]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + b - sum(x < b for x in plain)) for b in range(256)]


class Encoder:
    """Whole texts to ids, equal to the library's encode(), with a memory of pieces.

    The byte-level pre-tokenizer never joins a space to a non-space before it, so a text falls apart before each
    single space that follows a non-space, and on both sides of a line end between non-spaces; and a run of letters,
    with the space before it, is a pre-token of its own. Such pieces repeat often and are encoded once, a run of
    letters by the library's model alone. Texts with other white space side by side, or at an end,
    and texts that hold an added token (such as <|endoftext|>, which is one id wherever it stands), go to the library whole.
    """

    def __init__(self, path: str, limit: int = PIECES):
        import os

        self.limit = limit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token."""
        found = self.pieces.get(word)
        if found is None and len(word) > LONG:
            return self._whole(word)
        if found is None:
            symbols = word.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
        return found

    def _piece(self, piece: str) -> bytes:
        m = _LETTERS.match(piece, int(piece[0] == " "))
        if m is None or not m[0].isalpha():
            return self._whole(piece)
        stem, tail = piece[: m.end()], piece[m.end() :]
        if not tail:
            return self._word(stem)
        if tail[0].isalpha():
            return self._whole(piece)
        rest = self.pieces.get(tail)
        if rest is None:
            rest = self._whole(tail)
            if len(tail) <= LONG:
                self.pieces[tail] = rest
        return self._word(stem) + rest

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without an end id."""
        if "\0" in text or any(x in text for x in self.added):
            return self._whole(text)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        new = set(parts).difference(self.pieces)
        if any(not p or p[-1].isspace() or (p[0] != " " and p[0].isspace()) for p in new if p != "\n"):  # white space beside white space, or at an end
            return self._whole(text)
        if len(self.pieces) > self.limit:
            self.pieces.clear()
            new = set(parts)
        for p in new:
            self.pieces[p] = self._whole(p) if p == "\n" else self._piece(p)
        out = b"".join(map(self.pieces.__getitem__, parts))
        for p in new:
            if len(p) > LONG:
                del self.pieces[p]
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, limit: int) -> Encoder:
    return Encoder(path, limit)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, pieces: int) -> Iterator[pa.RecordBatch]:
    encoder, part, at = _encoder(path, pieces), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            some = b.slice(lo, 512)
            ids = [encoder.encode(x) + end for x in some.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            stops = np.cumsum(n)
            flat = pa.Array.from_buffers(pa.int32(), int(stops[-1]) if len(n) else 0, [None, pa.py_buffer(b"".join(ids))])
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + stops - n), pa.array(n), tokens], names=["doc_id", "part", "at", "n_tokens", "tokens"])
            at += int(stops[-1]) if len(n) else 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END, pieces: int = PIECES) -> None:
    """Encodes docs and writes them to path in ascending doc_id order (nulls first), one file for each range of ids.

    at counts the ids before a document in its file; null texts are empty; repeated rows are written each,
    in the order of their texts; an empty table writes no rows; other columns are dropped.
    """
    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(partial(_encoded, path=tokenizer or default_tokenizer(), end_id=end_id, pieces=pieces), FIELDS).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens. Columns not asked for are not read.

    start is at plus what the files before hold; those totals are a row for each file.
    """
    rows = spark.read.schema(FIELDS).parquet(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each task that wrote
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        at = at - at[0]
        sums = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = END, pieces: int = PIECES) -> DataFrame:
    """Writes docs' ids to the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, pieces)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
