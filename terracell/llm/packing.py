"""Packing along a space-filling curve.

Every document becomes token ids and a point: its hashed token counts, projected to a few
dimensions.  Documents are range-sorted by the Hilbert key of the point, so neighbours on
the curve hold like text, and are laid end to end into sequences of a fixed length.  What
is left at the end of a range is cut at powers of two, which take no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.recent import Recent
from terracell.llm.registry import query, read
from terracell.llm.store import columns, parts, written
from terracell.llm.words import chunks

DIMENSIONS, BITS = 4, 8
END_ID = 1
LENGTH = 2048
MAX_CACHED = 400_000
# White space in Unicode (fixed values).
_WS = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Byte-level pre-tokens never reach over these cuts: a word takes one space before it,
# letters end where punctuation begins, longer white space leaves its last character.
_CUTS = re.compile(
    rf" ?[{_LETTERS}]+(?=[,.!?*#$%&;:{_WS}]|$)|[{_WS}]+(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]"
)
_WORD = re.compile(rf" ?[{_LETTERS}]+")


class Encoder:
    """Ids of a byte-level BPE vocabulary, word by word with a table of recent words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text with the string of an added token goes to the library whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.recent = Recent(self._ids, MAX_CACHED)
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        # The letters that stand for a byte in the vocabulary; ASCII letters are their own.
        self.ascii = str.maketrans({" ": self._levelled(" ")})

    def _levelled(self, word: str) -> str:
        return self.level.pre_tokenize_str(word)[0][0]

    def _ids(self, cut: str) -> bytes:
        if _WORD.fullmatch(cut):  # one pre-token: straight to the merges
            word = cut.translate(self.ascii) if cut.isascii() else self._levelled(cut)
            ids = [token.id for token in self.tokenizer.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(cut, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers."""
        if self.added and self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}H", *ids)
        return b"".join(map(self.recent.__getitem__, _CUTS.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _projection(size: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((size, dimensions)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below ``2**bits``."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the excess work of inner cubes, from the largest down
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[n - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hilbert key of each document, from its ids (``starts`` has where each begins)."""
    points = np.add.reduceat(_projection(size, DIMENSIONS)[ids], starts, axis=0)
    points /= np.diff(np.append(starts, len(ids)))[:, None]
    cells = ((np.clip(2 * points, -1, 1) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
    return hilbert_keys(cells, BITS)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, curve): 16-bit ids with the end id, and the key on the curve."""

    def run(batches):
        own = encoder(path)
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            for part in chunks(batch):
                rows = [own.encode(t or "") + end for t in part.column("text").to_pylist()]
                starts = np.cumsum([0] + [len(r) // 2 for r in rows[:-1]])
                keys = curve_keys(np.frombuffer(b"".join(rows), dtype="<u2"), starts, own.size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows, pa.binary()), pa.array(keys)], ["doc_id", "ids", "curve"]
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids binary, curve long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of ``length`` ids.

    A document is its ids and the end id; it may be cut anywhere, and each id lies in one
    piece.  Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset),
    and ids where asked.  Every sequence is full but the last few of a range, whose lengths
    are powers of two.  A null text is empty and gives its end id; a null doc_id stays
    null; repeated rows are packed each; copies share a key and are dealt out by doc_id;
    other columns are ignored; an empty table gives no rows.
    """
    if length & (length - 1):
        raise ValueError("the length must be a power of two")
    table = written(tokenised(docs, path), "packing").withColumn("deal", F.xxhash64("doc_id", F.crc32("ids")))
    ordered = table.repartitionByRange(parts(docs), "curve", "deal").sortWithinPartitions("curve", "deal", "doc_id", "ids")
    schema = PIECES + (", ids binary" if with_ids else "")
    return ordered.select("doc_id", "ids").mapInArrow(lambda batches: _pack(batches, length, with_ids), schema)


def _pack(batches, length: int, with_ids: bool):
    number = TaskContext.get().partitionId() << 33
    pending: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open sequence
    held = 0
    rows: list[tuple] = []

    def close(pieces):
        nonlocal number
        offset = 0
        for doc_id, start, ids, n in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((doc_id, start, len(ids), crc, n, number, offset, ids.tobytes()))
            offset += len(ids)
        number += 1

    def flushed():
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        keep = 8 if with_ids else 7
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names[:keep])

    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(data, dtype="<u2")
            at = 0
            while at < len(ids):
                taken = min(length - held, len(ids) - at)
                pending.append((doc_id, at, ids[at : at + taken], len(ids)))
                held, at = held + taken, at + taken
                if held == length:
                    close(pending)
                    pending, held = [], 0
                if len(rows) >= 20_000:
                    yield flushed()
    while pending:  # the rest, by its largest powers of two
        room = 1 << (held.bit_length() - 1)
        held -= room
        part = []
        while room:
            doc_id, start, ids, n = pending.pop(0)
            part.append((doc_id, start, ids[:room], n))
            if len(ids) > room:
                pending.insert(0, (doc_id, start + room, ids[room:], n))
            room -= min(room, len(ids))
        close(part)
    yield flushed()


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
