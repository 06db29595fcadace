"""SentencePiece BPE encoding that keeps, for every piece, its bytes in the original text.

The model file is read directly.  Normalisation walks the compiled character map (a
double-array trie) for the longest prefix at each place, and records for each byte it
writes which byte of the source it came from.  Text is then cut where no piece of the
vocabulary can reach across, each cut is encoded by merging the best-scored neighbours,
and cuts met again are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terracell.llm.recent import Recent
from terracell.llm.registry import query, read
from terracell.llm.store import columns
from terracell.llm.words import chunks

SPACE = "▁"
# Piece kinds of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MAX_CACHED = 250_000
UNKNOWN_TEXT = " \u2047 "


def _fields(data: bytes):
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map: longest source prefix to replacement text."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest entry that begins at ``at``."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = self._base(unit)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


def _ids(said: bytes) -> list[int]:
    return list(map(int, said.split(b",")))


class Model:
    """Vocabulary, normaliser settings and the encoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        normal: dict = {}
        trainer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.char_map = CharMap(normal.get(2, b""))
        self.dummy_prefix = bool(normal.get(3, 1))
        self.remove_extra = bool(normal.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        mark = SPACE.encode()
        self.sizes = [len(r) - (len(mark) - 1) * r.count(mark) for r in self.raw]  # in source bytes
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        # No piece goes from a letter to a space mark, and a line end is no part of any.
        self.cuts = None if crossing else re.compile(rf"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (r"|\n" if alone else ""))
        self.recent = Recent(self._cut, MAX_CACHED)

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The text that is encoded, and for each of its UTF-8 bytes the source byte; one more at the end."""
        source = text.encode()
        out, places = bytearray(), []
        mark = SPACE.encode()
        at, end = 0, len(source)
        previous_space = self.remove_extra
        pending = self.dummy_prefix
        while at < end:
            hit = self.char_map.longest(source, at)
            if hit is None:
                lead = source[at]
                taken = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                made = source[at : at + taken]
            else:
                taken, made = hit
            for k in range(len(made)):
                byte = made[k : k + 1]
                if byte == b" " and previous_space:
                    continue
                if pending:
                    out += mark
                    places += [at] * len(mark)
                    pending = False
                out += mark if byte == b" " else byte
                places += [at] * (len(mark) if byte == b" " else 1)
                previous_space = self.remove_extra and byte == b" "
            at += taken
        if self.remove_extra:
            while out.endswith(mark):
                del out[-len(mark) :], places[-len(mark) :]
        return out.decode(), [*places, end]

    def _plain(self, text: str) -> str | None:
        """The normalised text where every character stays itself, else None."""
        if self.char_map.units or self.remove_extra:
            return None
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def _merge(self, text: str) -> list[str]:
        """Pieces of one cut: the best-scored pair of neighbours is merged first, the leftmost of equals."""
        if len(text) > 24:
            return self._merge_long(text)
        rank, none = self.rank, float("inf")
        parts = list(text)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap, for long cuts."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            if joined in self.rank:
                heapq.heappush(heap, (self.rank[joined], a, b, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in parts if p is not None]

    def _cut(self, cut: str) -> tuple[bytes, bytes, bytes]:
        """Of one cut: its ids in decimal joined by commas, the bytes that they decode to, and alignment.

        Alignment is the length of each piece in source bytes, as int32, where each mark is
        a space and all else stands for itself; of the bytes of a character the last holds it.
        """
        ids: list[int] = []
        steps = array("i")
        for piece in self._merge(cut):
            known = self.ids.get(piece)
            if known is not None:
                ids.append(known)
                steps.append(self.sizes[known])
                continue
            data = piece.encode()  # of one character
            if self.bytes:
                ids += [self.bytes[b] for b in data]
                steps.extend([0] * (len(data) - 1))
            else:
                ids.append(self.unknown)
            steps.append(1 if piece == SPACE else len(data))
        return ",".join(map(str, ids)).encode(), self._decoded(ids), steps.tobytes()

    def _ends(self, ids, normal: str) -> list[int]:
        """Where each piece ends in the bytes of the normalised text."""
        data, ends, at = normal.encode(), [], 0
        for i in ids:
            if self.kinds[i] == BYTE:
                at += 1
            elif i == self.unknown:
                lead = data[at]
                at += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            else:
                at += len(self.pieces[i].encode())
            ends.append(at)
        return ends

    def _cuts(self, normal: str) -> list[tuple[bytes, bytes, bytes]]:
        cuts = self.cuts.findall(normal) if self.cuts else [normal] if normal else []
        return list(map(self.recent.__getitem__, cuts))

    def _found(self, text: str):
        normal = self._plain(text)
        return self._cuts(self.normalise(text)[0] if normal is None else normal)

    def encode(self, text: str) -> list[int]:
        return [i for said, *_ in self._found(text) for i in _ids(said)]

    def _joined(self, text: str) -> tuple[bytes, bytes, bytes]:
        """``_cut`` for a whole text; the mark in front counts as a byte of the source.

        Where each character stays itself and no mark is in the source, the cuts know their
        own alignment; other texts go byte by byte through ``normalise``.
        """
        normal = self._plain(text)
        places = None
        if normal is None or SPACE in text:
            normal, places = self.normalise(text)
        found = self._cuts(normal)
        if not found:
            return b"", b"", b""
        said, back, steps = zip(*found)
        if places is None:
            return b",".join(said), b"".join(back), b"".join(steps)
        stops = np.array(places, np.int64)[self._ends([i for own in said for i in _ids(own)], normal)]
        stops += self.dummy_prefix
        return b",".join(said), b"".join(back), np.diff(stops, prepend=0).astype("<i4").tobytes()

    def aligned(self, texts: list[str]) -> list[tuple[int, bytes, bytes, np.ndarray]]:
        """For each text the number of ids, the ids in decimal joined by commas, the decoded text
        in UTF-8, and the end of each piece in source bytes: spans follow one another from 0.

        The ends of all texts come from one running sum of the lengths of their pieces.
        """
        rows = [self._joined(text) for text in texts]
        steps = np.frombuffer(b"".join([r[2] for r in rows]), "<i4")
        counts = np.array([len(r[2]) // 4 for r in rows], np.int64)
        cuts = np.append(0, np.cumsum(counts))
        total = np.append(0, np.cumsum(steps, dtype=np.int64))
        # The mark in front is no byte of the source.
        stops = total[1:] - np.repeat(total[cuts[:-1]] + self.dummy_prefix, counts)
        np.maximum(stops, 0, out=stops)
        return [
            (int(n), said, self._text(back).encode(), stops[a:b])
            for (said, back, _), n, a, b in zip(rows, counts, cuts[:-1], cuts[1:])
        ]

    def round_trip(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal joined by commas, the decoded text in UTF-8."""
        return self.aligned([text])[0][:3]

    def _decoded(self, ids) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def _raw(self, i: int) -> bytes:
        """The bytes that an id decodes to."""
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == UNKNOWN:
            return UNKNOWN_TEXT.encode()
        return b"" if self.kinds[i] == CONTROL else self.pieces[i].encode()

    def _text(self, data: bytes) -> str:
        """Decoded bytes as text: marks are spaces, and the mark put in front goes."""
        text = data.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self._text(self._decoded(ids))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte in the UTF-8 of the original text) of each piece.

        Spans follow one another; a mark put in front of the text is empty in the source,
        and of a character in byte pieces the last piece holds it all.
        """
        normal, places = self.normalise(text)
        out, at = [], 0
        for said, *_ in self._cuts(normal):
            for i in _ids(said):
                if self.kinds[i] == BYTE:
                    size = 1
                elif i == self.unknown:
                    size = len(normal.encode()[at:].decode()[0].encode())
                else:
                    size = len(self.pieces[i].encode())
                out.append((i, places[at], places[at + size]))
                at += size
        return out


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)`` without begin or end ids; a null text is empty."""

    def run(batches):
        own = model(path)
        for batch in batches:
            for part in chunks(batch):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def piece_spans(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, pieces) with each piece's id and its bytes in the original text."""

    def run(batches):
        own = model(path)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                rows = [
                    [{"id": i, "first": a, "end": b} for i, a, b in own.spans(t or "")]
                    for t in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "pieces"])

    return columns(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, pieces array<struct<id:int,first:long,end:long>>"
    )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ends_sha256) for each row of ``docs(doc_id, text)``.

    ``ends_sha256`` is of the end of each piece in the UTF-8 of the source, as little-endian
    64-bit numbers; a piece begins where the one before ends.

    Every whole text is encoded and decoded again; nulls count as empty texts, which have
    no ids.  Repeated rows and ids give a row each, a null doc_id stays null, other columns
    are ignored, and an empty table gives no rows.
    """

    def run(batches):
        own = model(path)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for n, *found, stops in own.aligned([t or "" for t in part.column("text").to_pylist()]):
                    rows.append((n, *(hashlib.sha256(x).hexdigest() for x in (*found, stops.astype("<i8", copy=False)))))
                n, said, back, ends = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(said), pa.array(back), pa.array(ends)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"],
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"
    )


@query("op9_pieces")
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
