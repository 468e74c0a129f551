"""Files, options, outlines and logs against hand-made cases and brute force."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import geometry, labels, scenarios, vector
from talus.plans.options import Options, stamped
from talus.plans.order import ordered
from talus.sources import geotiff, mat, reports, tiff
from talus.streaming import contributions


def lzw(data):
    """A plain encoder of TIFF's LZW."""
    bits, table, width, word = [], {bytes([i]): i for i in range(256)}, 9, b""
    n = 258
    put = lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([b])
    if word:
        put(table[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    joined = "".join(bits)
    return bytes(int(joined[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(joined), 8))


def test_lzw_and_packbits():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"abababababab", bytes(rng.integers(0, 4, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 9_000, dtype=np.uint8))):
        assert tiff.unlzw(lzw(data)) == data
    assert tiff.unpackbits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])


@pytest.mark.parametrize("dtype", ["float32", "float64", "int32", "uint8", "int16"])
def test_tiff_round_trip(dtype):
    rng = np.random.default_rng(2)
    grid = (rng.random((131, 17)) * 200).astype(dtype)
    ref = tiff.GeoRef(5.0, 10.0, 100.0, 900.0, -9999.0 if dtype == "int32" else None, {tiff.GEO_KEYS: (1, 1, 0, 0), tiff.GEO_ASCII: (b"WGS 84|\0",)})
    got, back = tiff.decode(tiff.encode(grid, ref, 50))
    assert (got == grid).all() and got.dtype == grid.dtype and (back.dx, back.dy, back.x, back.y, back.keys) == (5.0, 10.0, 100.0, 900.0, ref.keys)
    assert back.area == 50.0 and (np.isnan(back.nodata) if grid.dtype.kind == "f" else back.nodata == ref.nodata)
    with pytest.raises(ValueError):
        tiff.decode(b"no such thing")


@pytest.mark.parametrize("packing, predictor", [(1, 1), (5, 2), (8, 2), (8, 3), (5, 1)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_other_writers(packing, predictor, order):
    """Tiles of 16 x 16 of a grid of 20 x 18, in either byte order, with predictors."""
    rng = np.random.default_rng(3)
    kind = np.dtype(f"{order}f4" if predictor == 3 else f"{order}i2")
    grid = (rng.random((20, 18)) * 1000).astype(kind)
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            t = np.zeros((16, 16), kind)
            part = grid[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                t[:, 1:] = np.diff(t, axis=1)
            raw = t.tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(t.astype(">f4")).view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
                planes[:, 1:] = np.diff(planes, axis=1)
                raw = planes.tobytes()
            tiles.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](raw))
    fields = [(256, 3, (18,)), (257, 3, (20,)), (258, 3, (8 * kind.itemsize,)), (259, 3, (packing,)), (317, 3, (predictor,)), (322, 3, (16,)), (323, 3, (16,)), (324, 4, None), (325, 4, tuple(map(len, tiles))), (339, 3, (3 if predictor == 3 else 2,))]
    at = 8 + 2 + 12 * len(fields) + 4
    offsets = at + np.cumsum([32, *map(len, tiles)])[:4]
    directory, extra = b"", b""
    for tag, k, v in fields:
        raw = struct.pack(f"{order}{len(v or tiles)}{'H' if k == 3 else 'I'}", *(offsets.tolist() if v is None else v))
        directory += struct.pack(f"{order}HHI", tag, k, len(v or tiles)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    data = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HIH", 42, 8, len(fields)) + directory + struct.pack(f"{order}I", 0) + extra.ljust(32, b"\0") + b"".join(tiles)
    assert (tiff.decode(data)[0] == grid).all()


def test_geotiff_tables(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5), (0, 2, -2.0), (4, 1, None), (4, 2, 7.0)], "r int, c int, z double")
    geotiff.write(df, f"{tmp_path}/one.tif", ref=tiff.GeoRef(2.0, 2.0, 10.0, 50.0))
    got = {(r.r, r.c): r.z for r in geotiff.read(spark, f"{tmp_path}/one.tif").collect()}
    assert len(got) == 15 and {k: v for k, v in got.items() if v is not None} == {(0, 0): 1.5, (0, 2): -2.0, (4, 2): 7.0}
    geotiff.write(df, f"{tmp_path}/many", tile=2, ref=tiff.GeoRef(2.0, 2.0, 10.0, 50.0))
    tiled = {(r.r, r.c): r.z for r in geotiff.read(spark, f"{tmp_path}/many").collect() if r.z is not None}
    assert tiled == {(0, 0): 1.5, (0, 2): -2.0, (4, 2): 7.0}
    ref = geotiff.georef(spark, f"{tmp_path}/many")
    assert (ref.dx, ref.x, ref.y) == (2.0, 10.0, 50.0)
    assert reports.grids(spark, f"{tmp_path}/many").where("changed rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}$'").count() == 4  # a tile without cells has no file


def test_mat_files(spark, tmp_path):
    arrays = {"a": np.arange(6.0).reshape(2, 3), "b": np.array([[1, -2]], "i4"), "c": np.array([[True, False]])}
    got = mat.decode(mat.encode(arrays))
    assert all((got[k] == v).all() for k, v in arrays.items())
    (tmp_path / "x.mat").write_bytes(mat.encode({"prob": np.ones((1, 2))}))
    with pytest.raises(Exception, match="prob_phi"):
        mat.strength(spark, f"{tmp_path}/x.mat").collect()
    (tmp_path / "y.mat").write_bytes(mat.encode({"nogrow_io": np.eye(2), "ridge_io": np.eye(3)}))
    with pytest.raises(Exception, match="shapes"):
        mat.no_grow(spark, f"{tmp_path}/y.mat").collect()
    with pytest.raises(ValueError):
        mat.decode(b"\0" * 200)


def test_options():
    assert Options().problems() == [] and Options(run_index=2).problems(3) == []
    assert len(Options("mat", None, "mat", None, uniform_strength=False).problems()) == 3
    assert Options("mat", None, "mat", None, uniform_strength=False, aggregate=True).problems() == []
    assert len(Options("x", nogrow_source="y", run_index=-1, aggregate=True).problems()) == 4
    assert len(Options(nogrow_source="units").problems()) == 1
    with pytest.raises(ValueError, match="beyond"):
        Options(run_index=3).check(3)
    assert stamped("LS Cluster 1/2", datetime(2026, 1, 2, 3, 4, 5)) == "2026-01-02 03:04:05 LS Cluster 1/2"


def test_bank_is_checked(spark):
    grid = spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(2)], "r int, c int, z double")
    rows = [(1, 0, 0, 0.5, 2, False), (2, 1, 1, 0.4, 2, False)]
    bank = lambda x: spark.createDataFrame(x, "run int, r int, c int, prob double, n_runs int, no_slides boolean")
    with pytest.warns(UserWarning, match="0.1"):
        assert scenarios.aggregate_contributions(bank(rows), grid, 2).agg(F.sum("sus")).first()[0] == pytest.approx(90)
    for wrong in (rows[:1], [*rows, (3, 0, 0, 0.1, 2, False)], [rows[0], (2, 1, 1, 0.4, 3, False)], [*rows, (1, 0, 1, 0.4, 2, False)]):
        with pytest.raises(ValueError, match="not complete"):
            scenarios.aggregate_contributions(bank(wrong), grid, 2)
    with pytest.raises(ValueError, match="another grid"):
        scenarios.aggregate_contributions(bank([(1, 5, 0, 1.0, 1, False)]), grid, 1)


def test_boundaries(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        mask = rng.random((14, 14)) < 0.55
        df = spark.createDataFrame([(int(r), int(c), bool(mask[r, c])) for r in range(14) for c in range(14)], "r int, c int, mask boolean")
        found = labels.components(df)
        whole = {}
        for x in found.collect():
            whole.setdefault(x.root, set()).add((x.r, x.c))
        paths = {}
        for x in geometry.boundaries(found).orderBy("root", "seq").collect():
            paths.setdefault(x.root, []).append((x.r, x.c))
        assert set(paths) == set(whole)
        for root, cells in whole.items():
            path = paths[root]
            assert path[0] == path[-1] and path[:-1] == geometry.trace(cells)
            outside, todo = set(), [(-1, -1)]
            while todo:  # what can be reached from beyond the grid by rows and columns
                r, c = todo.pop()
                if (r, c) in outside or (r, c) in cells or not (-1 <= r <= 14 and -1 <= c <= 14):
                    continue
                outside.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
            assert set(path) == {(r, c) for r, c in cells if any((r + a, c + b) in outside for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}


def test_vectors_by_extension(spark, tmp_path):
    rows = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "unit int, geometry string")
    for name in ("a.geojson", "b.json", "c.csv", "d.parquet"):
        vector.write_vector(rows, f"{tmp_path}/{name}")
    assert spark.read.parquet(f"{tmp_path}/d.parquet").count() == 1
    assert vector.read_geojson(spark, f"{tmp_path}/a.geojson", "unit int").first().unit == 1
    for name in ("x.shp", "x.gpkg", "x"):
        with pytest.raises(ValueError):
            vector.write_vector(rows, f"{tmp_path}/{name}")


def test_tail_of_a_log(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("".join(f"line {i}\n" for i in range(1000)))
    last = lambda **k: [r.value for r in contributions.tail(spark, str(log), **k).collect()]
    assert last() == [f"line {i}" for i in range(975, 1000)] and last(lines=3, most=20) == ["line 998", "line 999"] and last(lines=0) == []


def test_stream_of_contributions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 0.5, 2, False), (2, 0, 0, 0.25, 2, False), (2, 1, 1, 0.25, 2, False)], "run int, r int, c int, prob double, n_runs int, no_slides boolean")
    scenarios.bank(rows, f"{tmp_path}/bank")
    stream = contributions.accumulate(spark, f"{tmp_path}/bank", "banked_so_far", f"{tmp_path}/checkpoint")
    stream.awaitTermination(120)
    assert {(r.r, r.c): r.prob for r in spark.table("banked_so_far").collect()} == {(0, 0): 0.75, (1, 1): 0.25}
    f = spark.range(1).select(contributions.fraction(F.lit(2), F.lit(4), F.lit(5), F.lit(10)).alias("a"), contributions.fraction(F.lit(5), F.lit(4), F.lit(5), F.lit(0)).alias("b")).first()
    assert (f.a, f.b) == (0.375, 0.99)


def test_places_over_a_whole_table(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(0, 9, 500), strict=True))]
    got = ordered(spark.createDataFrame(rows, "k long, v long, i long").repartition(7), [F.col("k").desc(), F.col("i")], "at", {"total": F.col("v")}).collect()
    want, total = sorted(rows, key=lambda x: (-x[0], x[2])), 0
    by_place = {r["at"]: r for r in got}
    for at, (_, v, i) in enumerate(want):
        total += v
        assert (by_place[at].i, by_place[at].total) == (i, total)
    assert ordered(spark.createDataFrame([], "k long"), [F.col("k")], "at").count() == 0
