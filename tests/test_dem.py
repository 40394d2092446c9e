"""Raster files as a data source: what reaches the reader, what it reads, and how files are shared out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, LessThanOrEqual, StringContains
from pyspark.sql.types import ArrayType, DoubleType, StructType

from orograph.sources import dem, geotiff


@pytest.fixture
def folder(tmp_path):
    grid = np.arange(64 * 64).reshape(64, 64).astype(float)
    grid[:5] = -1
    (tmp_path / "a.tif").write_bytes(geotiff.encode(grid, 10.0, 10.0, 0.1, nodata=-1.0, block=16, overviews=[2]))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.TIFF").write_bytes(geotiff.encode(grid + 1, -20.0, 50.0, 0.05, block=16))
    (tmp_path / "c.tif").write_bytes(b"no raster")
    (tmp_path / "d.txt").write_bytes(b"no raster")
    (tmp_path / "e.tif").write_bytes(b"")
    return str(tmp_path)


def reader(folder, columns=dem.COLUMNS, split=dem.SPLIT_BYTES):
    schema = StructType()
    for c in columns:
        schema = schema.add(c, ArrayType(DoubleType()) if c == "heights" else dem.COLUMNS[c])
    return dem.DemReader(folder, split, schema)


@pytest.fixture
def read_blocks(monkeypatch):
    """The blocks whose bytes were decoded."""
    seen = []
    decode = geotiff.decode
    monkeypatch.setattr(geotiff, "decode", lambda data, h: seen.append((h["path"][-6:], h["level"])) or decode(data, h))
    return seen


def rows(r):
    return [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]


def test_only_blocks_that_pass_are_read(folder, read_blocks):
    every = rows(reader(folder))
    assert len(every) == 16 + 4 + 16 + 1 and len(read_blocks) == 36
    for filters, wanted in (
        ([EqualTo(("level",), 1)], 4),
        ([EqualTo(("level",), 0), LessThan(("left",), 11.7), GreaterThan(("top",), 5.3), GreaterThan(("right",), 10.0)], 2 * 3),
        ([EqualTo(("z",), 3), IsNotNull(("z",))], 16),
        ([In(("block",), (0, 3, 99))], 2 + 2 + 2),
        ([LessThanOrEqual(("x_first",), 3)], 4),
        ([EqualTo(("left",), 77.0)], 0),
    ):
        read_blocks.clear()
        r = reader(folder)
        assert list(r.pushFilters(filters)) == []
        got = rows(r)
        assert len(read_blocks) == len(got) == wanted, filters
        same = [e for e in every if e["block"] is not None and all(_holds(f, e) for f in filters)]
        assert sorted(got, key=str) == sorted(same, key=str)


def _holds(f, row):
    v, w = row[f.attribute[0]], getattr(f, "value", None)
    return {EqualTo: lambda: v == w, LessThan: lambda: v < w, LessThanOrEqual: lambda: v <= w, GreaterThan: lambda: v > w, In: lambda: v in w, IsNotNull: lambda: v is not None}[type(f)]()


def test_other_filters_stay_with_spark(folder):
    left = [StringContains(("path",), "a"), EqualTo(("error",), "x"), EqualTo(("no", "such"), 1)]
    assert list(reader(folder).pushFilters([*left, EqualTo(("z",), 1)])) == left


def test_no_pixels_without_a_column_for_them(folder, read_blocks):
    assert len(rows(reader(folder, columns=["path", "level", "left"]))) == 37 and not read_blocks


@pytest.mark.parametrize("split", [10, 500, 3000, 1 << 30])
def test_each_block_is_in_one_partition(folder, split):
    r = reader(folder, split=split)
    parts = r.partitions()
    assert len(parts) > 1 or split > 5000
    assert sorted(map(str, rows(r))) == sorted(map(str, rows(reader(folder))))


def test_filters_of_a_query_reach_the_plan(spark, folder):
    blocks = dem.scan(spark, folder).where("z = 2 and level = 0 and left < 12 and bottom > 5 and path like '%a.tif'")
    text = blocks._jdf.queryExecution().explainString(blocks.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (pushed,) = [x for x in text.splitlines() if x.startswith("PushedFilters")]
    assert all(p in pushed for p in ("EqualTo(z,2)", "EqualTo(level,0)", "LessThan(left,12.0)", "GreaterThan(bottom,5.0)"))
    assert {(r.block, r.rows, r.columns) for r in blocks.collect()} == {(b, 16, 16) for b in (0, 1, 4, 5, 8, 9)}


def test_pixels_and_errors(spark, folder):
    blocks = dem.scan(spark, folder)
    assert [(r.path[-5:], r.level, r.heights) for r in blocks.where("error is not null").collect()] == [("c.tif", None, None)]
    got = dem.pixels(blocks.where("path like '%a.tif' and level = 0")).collect()
    assert len(got) == 64 * 59 and all(r.h == r.row * 64 + r.col for r in got)
    assert all(r.lon == pytest.approx(10 + (r.col + 0.5) / 10) and r.lat == pytest.approx(10 - (r.row + 0.5) / 10) for r in got)
    counts = {r.z: r.n for r in blocks.groupBy("z").agg(F.count("*").alias("n")).collect()}
    assert counts == {None: 1, 1: 4, 2: 16, 3: 16}


def test_scans_with_other_filters(spark, folder):
    """Each scan has its own filters; one that is used again is not left with those of before."""
    blocks = dem.scan(spark, folder)
    assert [blocks.where(w).count() for w in ("level = 0", "path is not null", "level = 1")] == [32, 37, 4] and blocks.count() == 37
    fine, coarse = dem.scan(spark, folder).where("level = 0"), dem.scan(spark, folder).where("level = 1")
    assert fine.alias("f").join(coarse.alias("c"), "path").count() == 16 * 4


def test_no_files(spark, tmp_path):
    assert dem.scan(spark, str(tmp_path / "nothing")).count() == 0
    assert dem.scan(spark, str(tmp_path)).where("z = 1").count() == 0


def test_a_broken_block_tells_why(spark, folder, tmp_path):
    data = bytearray(open(f"{folder}/a.tif", "rb").read())
    data[12:20] = bytes(8)
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "a.tif").write_bytes(bytes(data))
    found = dem.scan(spark, str(tmp_path / "own")).where("error is not null").collect()
    assert [(r.level, r.block, r.heights) for r in found] == [(0, 0, None)] and isinstance(found[0].error, str)
