"""Raw raster files and sorted answer files."""

import glob
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geo
from terracell.operators import conform
from terracell.schema import Grid
from terracell.sources import blocks, requests, tiles

GRID = Grid(lat0=0.0, lon0=-60.0, dlat=-0.5, dlon=0.5, n_rows=23, n_cols=31, tile=20)


def cells_of(spark, rows):
    df = spark.createDataFrame(rows, "source string, date string, row int, col int, value float")
    df = df.withColumn("date", F.col("date").cast("date"))
    return conform.with_keys(df.withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)}), GRID)


def some_rows(seed=3, n=400):
    rng = random.Random(seed)
    days = ["1969-12-31", "2020-02-29", "2020-03-01"]
    keys = {(rng.choice(["a", "über"]), rng.choice(days), rng.randrange(23), rng.randrange(31)) for _ in range(n)}
    # Bytes of these values hold line ends (10) and bytes that are no UTF-8.
    odd = [float(np.frombuffer(b, "<f4")[0]) for b in (b"\n\n\n\n", b"\xff\x0a\xc3\x28", b"\x00\x00\x00\x00")]
    return [(*k, rng.choice([None, 1.5, -7.25, *odd])) for k in sorted(keys)]


def test_blocks_come_back_bit_by_bit(spark, tmp_path):
    rows, path = some_rows(), str(tmp_path / "raw")
    packed = blocks.pack_blocks(cells_of(spark, rows), GRID)
    blocks.write_blocks(packed.coalesce(2), path)
    assert len(glob.glob(path + "/part-*")) <= 2 < packed.count()  # many tiles a file
    found = blocks.decode_files(blocks.scan_files(spark, path, "part-*"))
    assert {r.status for r in found.select("status").collect()} == {"ok"}
    got = tiles.tiles_to_cells(found, GRID).where("value IS NOT NULL")
    got = sorted((r.source, str(r.date), r.row, r.col, r.value) for r in got.collect())
    assert got == sorted(r for r in rows if r[4] is not None)
    # A block is its whole tile: what was not there is missing, and edges are not exceeded.
    whole = tiles.tiles_to_cells(found, GRID)
    assert whole.agg(F.max("row"), F.max("col")).first() == (22, 30)
    assert whole.count() == whole.select("source", "date", "row", "col").distinct().count()


def test_bad_files_are_told_of_and_the_others_decoded(spark, tmp_path):
    packed = blocks.pack_blocks(cells_of(spark, some_rows()), GRID).orderBy("source", "date", "tile_id")
    good = [bytes(r.content) for r in packed.limit(3).collect()]
    flipped = bytearray(good[1])
    flipped[-2] ^= 1
    files = {
        "good": b"\n".join(good), "none": b"", "cut": good[0] + good[1][:-3], "short": good[0] + b"TCB",
        "flipped": good[0] + bytes(flipped), "other": b"%PDF-1.7 and more than a header of bytes",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = blocks.decode_files(blocks.scan_files(spark, str(tmp_path)))
    said = {(r.path.rpartition("/")[2], r.status): r.n for r in found.groupBy("path", "status").agg(F.count("values").alias("n")).collect()}
    assert said == {
        ("good", "ok"): 3, ("cut", "unreadable"): 0, ("short", "unreadable"): 0,
        ("flipped", "unreadable"): 0, ("other", "unreadable"): 0,
    }  # Spark's scan leaves out files of no bytes
    bare = spark.createDataFrame([("x", b""), ("y", None)], "path string, content binary")
    assert {(r.path, r.status) for r in blocks.decode_files(bare).collect()} == {("x", "empty"), ("y", "empty")}


def test_a_reader_of_the_users_own(spark, tmp_path):
    def reader(content):
        for k, line in enumerate(content.decode().split("\n")):
            yield "own", 18262 + k, 0, 0, 2, [float(x) for x in line.split()]

    (tmp_path / "a.asc").write_text("1 2 3 4\n5 6 7 8")
    (tmp_path / "b.asc").write_text("1 two")
    (tmp_path / "c.txt").write_text("9 9")
    found = blocks.decode_files(blocks.scan_files(spark, str(tmp_path), "*.asc"), reader)
    rows = sorted((r.status, str(r.date), r["values"]) for r in found.collect())
    assert rows == [("ok", "2020-01-01", [1, 2, 3, 4]), ("ok", "2020-01-02", [5, 6, 7, 8]), ("unreadable", "None", None)]


def test_no_cells_no_blocks(spark):
    assert blocks.pack_blocks(cells_of(spark, some_rows()).limit(0), GRID).count() == 0


@pytest.mark.parametrize("files", [1, 7])
def test_files_by_name_are_the_order(spark, tmp_path, files):
    rng = random.Random(1)
    # A third of all rows are of one day; some keys are null, some rows are equal.
    rows = [(rng.choice([None, "2020-01-01"] + [f"2020-02-{k:02d}" for k in range(1, 5)]), rng.randrange(50)) for _ in range(900)]
    rows += [("2020-01-01", k) for k in range(400)]
    df = spark.createDataFrame(rows, "date string, id int").repartition(5)
    requests.write_sorted(df, str(tmp_path / "j"), "date", "id", files=files)
    parts = sorted(glob.glob(str(tmp_path / "j" / "part-*.json")))
    found = [json.loads(line) for p in parts for line in open(p)]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.get("date"), r["id"]) for r in found] == want
    assert len(parts) == files
    # The common day is dealt to several files.
    of_day = [p for p in parts if "2020-01-01" in open(p).read()]
    assert len(of_day) > 1 or files == 1
    requests.write_sorted(df, str(tmp_path / "p"), "date", "id", files=files, format="parquet")
    placed = requests.with_position(spark.read.parquet(str(tmp_path / "p"))).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(len(rows))) and [(r.date, r.id) for r in placed] == want


def test_answers_are_lines_of_text(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":2}',)], "answer string")
    for _ in range(2):  # a second run takes the place of the first
        requests.write_answers(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ['{"a":1}', '{"a":2}']


def test_positions_move_no_rows(spark, tmp_path, plan_of):
    """Tables over any broadcast threshold: only the order over files moves."""
    path = str(tmp_path / "p")
    requests.write_sorted(spark.range(1000), path, "id", files=5, format="parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = requests.with_position(spark.read.parquet(path))
        plan = plan_of(placed)
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(_file") == 1  # of the counts
        assert placed.filter("id != position").count() == 0 and placed.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
