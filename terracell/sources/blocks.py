"""Raw raster blocks in binary files: packed, written, read and decoded where they lie.

A file holds many blocks, one after another.  A block is the cells of one tile and day,
row by row, as 32-bit floats with NaN for a missing value, behind a header and the
checksum of what follows it.  Other formats come in through a reader of the user's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from terracell.schema import TILE_SCHEMA, Grid

# Mark, checksum, bytes of the source's name, days since 1970, first row, first column, width, values.
_HEADER = "<4sIHiiiii"
_HEAD = struct.calcsize(_HEADER)
_MARK = b"TCB1"
_END = b"\n"
VALUES_PER_BATCH = 1_000_000

FILE_TILES = T.StructType([*TILE_SCHEMA, T.StructField("path", T.StringType()), T.StructField("status", T.StringType())])


def pack_blocks(cells: DataFrame, grid: Grid) -> DataFrame:
    """(source, date, tile_id, content) of archive cells, one block for each tile and day.

    A tile has at most ``grid.tile`` squared cells, so the groups are bounded; a cell that
    isn't there is packed as missing.  Cells must be one for each day and place.
    """
    tile, per_row, n_rows, n_cols = grid.tile, grid.tiles_per_row, grid.n_rows, grid.n_cols
    cell = F.struct("row", "col", "value")
    groups = cells.groupBy("source", "date", "tile_id").agg(F.collect_list(cell).alias("cells"))
    groups = groups.select("source", "date", "tile_id", F.unix_date("date").alias("day"), "cells")

    def pack(source, tile_id, day, rows, cols, values) -> bytes:
        first_row, first_col = tile_id // per_row * tile, tile_id % per_row * tile
        width, height = min(tile, n_cols - first_col), min(tile, n_rows - first_row)
        block = np.full(width * height, np.nan, "<f4")
        block[(rows - first_row) * width + cols - first_col] = values
        name = source.encode()
        head = struct.pack(_HEADER, _MARK, 0, len(name), day, first_row, first_col, width, len(block))[8:]
        body = head + name + block.tobytes()
        return _MARK + struct.pack("<I", zlib.crc32(body)) + body

    def run(batches):
        for batch in batches:
            found, listed = [], batch.column("cells")
            inner, ends = listed.flatten(), np.asarray(listed.offsets)
            ends = ends - ends[0]
            rows, cols = (np.asarray(inner.field(k)) for k in (0, 1))
            values = inner.field(2).to_numpy(zero_copy_only=False).astype("<f4")
            source, tile_id, day = (batch.column(c).to_pylist() for c in ("source", "tile_id", "day"))
            for k in range(batch.num_rows):
                a, b = ends[k], ends[k + 1]
                found.append(pack(source[k], tile_id[k], day[k], rows[a:b], cols[a:b], values[a:b]))
            kept = [batch.column(c) for c in ("source", "date", "tile_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], ["source", "date", "tile_id", "content"])

    return groups.mapInArrow(run, "source string, date date, tile_id int, content binary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks to ``.txt``-named binary files of Spark's own writer, so any file system of Spark's will do.

    The bytes go out as they are; a line end stands after each block.
    """
    blocks.select(F.col("content").cast("string")).write.mode("append").option("lineSep", _END.decode()).text(path)


def read_blocks(content: bytes) -> Iterable[tuple]:
    """(source, days since 1970, first_row, first_col, width, values) of each block of a file.

    Raises ``ValueError`` where the file is cut off or damaged.
    """
    at = 0
    while at < len(content):
        if len(content) - at < _HEAD:
            raise ValueError("cut off")
        mark, check, name, day, first_row, first_col, width, n = struct.unpack_from(_HEADER, content, at)
        start = at + _HEAD
        end = start + name + 4 * n
        if mark != _MARK or n < 0 or end > len(content) or zlib.crc32(content[at + 8 : end]) != check:
            raise ValueError("damaged")
        yield content[start : start + name].decode(), day, first_row, first_col, width, np.frombuffer(content, "<f4", n, start + name)
        at = end + (content[end : end + 1] == _END)


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of raw files; content is read only where it is asked for.

    Spark leaves out files of no bytes.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def decode_files(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]] = read_blocks) -> DataFrame:
    """Tiles of raw files, with the ``path`` they are from and a ``status``.

    ``reader`` turns the bytes of one file into tiles as ``read_blocks`` does.  A file
    counts as a whole: if the reader raises anywhere in it, it gives one row without a
    tile, of status ``unreadable``; without a tile it is ``empty`` (null content, too).
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def batch_of(tiles: list, paths: list, said: list) -> pa.RecordBatch:
        heads = list(zip(*[t[:5] for t in tiles]))
        cols = [pa.array(list(h), k) for h, k in zip(heads, kinds)]
        cols[1] = cols[1].cast(pa.date32())
        values = [t[5] for t in tiles]
        ends = np.append(0, np.cumsum([0 if v is None else len(v) for v in values]))
        gaps = pa.array([None if v is None else int(e) for v, e in zip(values, ends)] + [int(ends[-1])], pa.int32())
        joined = np.concatenate([np.zeros(0, np.float32), *[v for v in values if v is not None]]).astype(np.float32)
        cols.append(pa.ListArray.from_arrays(gaps, pa.array(joined)))
        return pa.RecordBatch.from_arrays([*cols, pa.array(paths), pa.array(said)], FILE_TILES.names)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    tiles = list(reader(content.as_py() or b""))
                    said = "ok" if tiles else "empty"
                except Exception:  # whatever a user's reader raises is told of in the status
                    tiles, said = [], "unreadable"
                tiles = tiles or [(None,) * 6]
                at = 0
                while at < len(tiles):
                    size, end = 0, at
                    while end < len(tiles) and (end == at or size < VALUES_PER_BATCH):
                        size += 0 if tiles[end][5] is None else len(tiles[end][5])
                        end += 1
                    yield batch_of(tiles[at:end], [path] * (end - at), [said] * (end - at))
                    at = end

    return files.select("path", "content").mapInArrow(run, FILE_TILES)
