"""Warping of images, points, fields and geometries, tile by tile, against whole arrays; image files."""

import io
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.kernels import codecs as Z
from tilewright.kernels import images as I
from tilewright.kernels import resample as K
from tilewright.operators import fields as D
from tilewright.operators import resample as RS
from tilewright.operators import tiles as T
from tilewright.operators import warp as W
from tilewright.sources import images as SI


def smooth(h, w, seed=0):
    return I.gaussian(np.random.default_rng(seed).random((h, w)) * 255, 2.0)


def pixels(spark, img, image=0, names=("v",)):
    img = img[..., None] if img.ndim == 2 else img
    y, x = np.mgrid[: img.shape[0], : img.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"image": image, "x": x.ravel(), "y": y.ravel(), **{n: img[..., k].ravel() for k, n in enumerate(names)}}))


def field_table(spark, f, slide=0):
    y, x = np.mgrid[: f.shape[1], : f.shape[2]]
    return spark.createDataFrame(pd.DataFrame({"slide": slide, "gx": x.ravel(), "gy": y.ravel(), "dx": f[0].ravel(), "dy": f[1].ravel()})).selectExpr("slide", "cast(gx as int) gx", "cast(gy as int) gy", "dx", "dy")


def image(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def field_array(df, shape):
    out = np.zeros((2, *shape))
    for r in df.collect():
        out[:, r.gy, r.gx] = r.dx, r.dy
    return out


M = np.array([[0.95, -0.2, 6.5], [0.18, 1.02, -3.25], [0, 0, 1]])


def reference(img, m, f, shape, order, fill):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    if f is not None:
        x, y = x + f[0], y + f[1]
    sx, sy = K.through(m, x.ravel(), y.ravel())
    near = (np.floor(sx + 0.5), np.floor(sy + 0.5)) if order == 0 else (sx, sy)
    inside = (near[0] >= 0) & (near[1] >= 0) & (near[0] <= img.shape[1] - 1) & (near[1] <= img.shape[0] - 1)
    return np.where(inside, K.sample(img[..., None], sx, sy, order)[:, 0], fill).reshape(shape)


@pytest.mark.parametrize("interpolation", ["nearest", "bilinear", "bicubic"])
def test_images_by_tiles_equal_whole_ones(spark, interpolation):
    img = smooth(70, 90)
    y, x = np.mgrid[:60, :80]
    f = np.stack([3 * np.sin(y * 0.1), 2 * np.cos(x * 0.07)])
    frame = spark.createDataFrame([(0, M.ravel().tolist(), 80, 60)], "slide long, m array<double>, w int, h int")
    t = RS.pack(pixels(spark, img), ["v"], side=32)
    out = RS.resample(
        frame.withColumn("reach", F.lit(3.0)).withColumn("of", F.col("slide")), [("field", "back", "of", "reach"), ("matrix", "m")], t, {"back": RS.field_tiles(field_table(spark, f), 16)}, 1, "float64", interpolation, 9.0, 24, 32, field_side=16,
    )
    got = image(RS.unpack(out, ["v"]), (60, 80))
    assert np.allclose(got, reference(img, M, f, (60, 80), RS.INTERPOLATION[interpolation], 9.0), atol=1e-6)
    assert {(r.w, r.h) for r in out.collect()} == {(24, 24), (8, 24), (24, 12), (8, 12)}
    plain = RS.warp_images(RS.pack(pixels(spark, img), ["v"]), frame.withColumns({"x": F.lit(10), "y": F.lit(5), "w": F.lit(20), "h": F.lit(15)}), None, 1, "uint8", interpolation)
    want = reference(img, M, None, (60, 80), RS.INTERPOLATION[interpolation], 0)[5:20, 10:30]
    assert np.abs(image(RS.unpack(plain, ["v"]), (15, 20)) - K.cast(want, "uint8")).max() <= 1


def test_there_and_back_and_between(spark):
    img = smooth(64, 64)
    s = spark.createDataFrame([(0, M.ravel().tolist(), 64, 64), (1, [1.0, 0.0, 3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0], 64, 64)], "slide long, m array<double>, w int, h int")
    t = RS.pack(pixels(spark, img), ["v"])
    there = RS.warp_images(t, s.where("slide = 0"), None, 1, "float64", "bicubic", -99.0)
    back = image(RS.unpack(RS.unwarp_images(there, s.where("slide = 0"), None, 1, "float64", "bicubic", -99.0), ["v"]), (64, 64))
    inner = back[20:44, 20:44]
    assert np.abs(inner - img[20:44, 20:44]).max() < 6
    pairs = spark.createDataFrame([(0, 1, 64, 64)], "from_slide long, to_slide long, w int, h int")
    moved = image(RS.unpack(RS.warp_between(t, pairs, s.select("slide", "m"), dtype="float64", interpolation="bilinear", fill=-1.0), ["v"]), (64, 64))
    n = np.array([[1, 0, 3], [0, 1, 2], [0, 0, 1]])
    assert np.allclose(moved, reference(img, M @ np.linalg.inv(n), None, (64, 64), 1, -1.0), atol=1e-6)
    empty = RS.warp_images(t.where("false"), s.where("slide = 0"), None, 1, "uint8", fill=7)
    assert {r.v for r in RS.unpack(empty, ["v"]).collect()} == {7.0}


def test_sizes_pyramids_and_turns(spark):
    img = smooth(50, 70)
    t = RS.pack(pixels(spark, img), ["v"], side=32)
    size = spark.createDataFrame([(0, 70, 50, 35, 25)], "slide long, in_w int, in_h int, w int, h int")
    half = image(RS.unpack(RS.resample(size.withColumn("m", A.matrix(2, 0, 0.5, 0, 2, 0.5, 0, 0, 1)), [("matrix", "m")], t, None, 1, "float64", "bilinear", None, 256, 32), ["v"]), (25, 35))
    mean = (img[::2, ::2] + img[1::2, ::2] + img[::2, 1::2] + img[1::2, 1::2]) / 4
    assert np.allclose(half, mean, atol=1e-6)
    big = image(RS.unpack(RS.resize(RS.pack(pixels(spark, img), ["v"]), spark.createDataFrame([(0, 70, 50, 140, 100)], "slide long, in_w int, in_h int, w int, h int"), 1, "float64", "bilinear"), ["v"]), (100, 140))
    assert np.isfinite(big).all() and abs(big.mean() - img.mean()) < 1
    levels = RS.pyramid(t, 3, 32)
    two = image(RS.unpack(levels.where("level = 1").drop("level"), ["v"]), (25, 35))
    assert np.allclose(two, mean) and {(r.w, r.h) for r in levels.where("level = 2").collect()} == {(18, 13)}
    turn = RS.unpack(RS.rotate(RS.pack(pixels(spark, img), ["v"]), size.select("slide", "in_w", "in_h"), F.lit(np.pi / 2), 1, "float64", "nearest"), ["v"])
    assert np.allclose(image(turn, (70, 50)), np.rot90(img, 1)) or np.allclose(image(turn, (70, 50)), np.rot90(img, -1))


def test_fields_by_tiles_equal_whole_ones(spark):
    f = np.stack([3 * smooth(50, 60, 1) / 255 - 1.5, 4 * smooth(50, 60, 2) / 255 - 2])
    t = field_table(spark, f)
    assert np.allclose(field_array(D.smooth(t, 2.0, tile=16), (50, 60)), I.gaussian_field(f, 2.0))
    assert np.allclose(field_array(D.invert(t, tile=16), (50, 60)), I.invert_field(f))
    inverse = field_array(D.invert(t), (50, 60))
    y, x = np.mgrid[:50, :60].astype(float)
    at = K.sample(np.moveaxis(f, 0, -1), (x + inverse[0]).ravel(), (y + inverse[1]).ravel(), 1).reshape(50, 60, 2)
    assert np.abs(inverse + np.moveaxis(at, -1, 0))[:, 5:-5, 5:-5].max() < 0.02
    both = field_array(D.compose(t, t, tile=16), (50, 60))
    at = K.sample(np.moveaxis(f, 0, -1), (x + f[0]).ravel(), (y + f[1]).ravel(), 1).reshape(50, 60, 2)
    assert np.allclose(both, f + np.moveaxis(at, -1, 0))
    assert np.allclose(field_array(D.add(t, t), (50, 60)), 2 * f)
    gaps = t.where("gx between 20 and 24 and gy between 20 and 24")
    filled = field_array(D.fill_gaps(t, gaps), (50, 60))
    assert np.abs(filled - f).max() < 1 and np.allclose(filled[:, :20], f[:, :20])
    near = D.from_points(spark.createDataFrame([(0, 10.0, 10.0, 2.0, -1.0)], "slide long, x double, y double, dx double, dy double"), spark.createDataFrame([(0, 40, 40)], "slide long, w int, h int"), 5.0, 5.0)
    rows = {(r.gx, r.gy): (r.dx, r.dy) for r in near.collect()}
    assert rows[2, 2] == pytest.approx((2.0, -1.0)) and rows[8, 8] == (0.0, 0.0)


def test_invasive_displacements(spark):
    f = np.zeros((2, 20, 20))
    f[0, 8:12, 15:] = 10.0  # leads out of an image of 20 pixels
    s = spark.createDataFrame([(0, np.eye(3).ravel().tolist(), 20, 20)], "slide long, m array<double>, src_w int, src_h int")
    got = field_array(D.remove_invasive(field_table(spark, f), s, 1), (20, 20))
    assert not got.any()
    f[0] = 0
    f[1, 5:8, 5:8] = 2.0
    kept = field_array(D.remove_invasive(field_table(spark, f), s, 1), (20, 20))
    assert np.allclose(kept, f)


def test_points_there_and_back(spark):
    f = np.stack([2 * np.sin(np.mgrid[:60, :80][0] * 0.1), np.cos(np.mgrid[:60, :80][1] * 0.1)])
    t = field_table(spark, f)
    size = {"fit_w": 100, "fit_h": 80, "pt_w": 400, "pt_h": 320, "reg_w": 80, "reg_h": 60, "out_w": 160, "out_h": 120}
    s = spark.createDataFrame([(0, M.ravel().tolist()), (1, [1.0, 0.0, 2.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0])], "slide long, m array<double>").select("slide", "m", *[F.lit(v).alias(k) for k, v in size.items()])
    both = t.unionByName(t.withColumn("slide", F.lit(1).cast("long")))
    inverse = D.invert(both)
    pts = spark.createDataFrame([(0, 100.0 + 7 * k, 90.0 + 5 * k, f"p{k}") for k in range(20)], "slide long, x double, y double, name string")
    there = W.warp_xy(pts, s, inverse)
    assert there.columns == ["slide", "x", "y", "name", "wx", "wy"]
    back = W.unwarp_xy(there.select("slide", F.col("wx").alias("x"), F.col("wy").alias("y"), "name"), s, both)
    want = {r.name: (r.x, r.y) for r in pts.collect()}
    assert all(abs(r.wx - want[r.name][0]) < 1 and abs(r.wy - want[r.name][1]) < 1 for r in back.collect())
    r = there.where("name = 'p3'").first()
    q = np.linalg.inv(M) @ [(100 + 21) / 4, (90 + 15) / 4, 1]
    d = field_array(inverse.where("slide = 0"), (60, 80))
    m = K.sample(np.moveaxis(d, 0, -1), q[:1], q[1:2], 1)[0]
    assert (r.wx, r.wy) == pytest.approx((2 * (q[0] + m[0]), 2 * (q[1] + m[1])))
    across = W.warp_xy_between(pts, s, F.lit(1).cast("long"), inverse, both)
    assert across.columns == ["slide", "x", "y", "name", "to_slide", "wx", "wy"] and across.count() == 20
    same = W.warp_xy_between(pts, s, F.lit(0).cast("long"), inverse, both)
    assert all(abs(x.wx - x.x) < 1 and abs(x.wy - x.y) < 1 for x in same.collect())
    cubic = {r.name: (r.wx, r.wy) for r in W.displace(pts.withColumns({"x": F.col("x") / 8, "y": F.col("y") / 8}), t, 1.0, 3).collect()}
    x, y = np.array([100.0 + 7 * k for k in range(20)]) / 8, np.array([90.0 + 5 * k for k in range(20)]) / 8
    c = K.sample(np.moveaxis(f, 0, -1), x, y, 3)
    assert all(cubic[f"p{k}"] == pytest.approx((x[k] + c[k, 0], y[k] + c[k, 1])) for k in range(20))
    assert W.warp_xy(pts.where("false"), s, inverse).count() == 0


def test_geometries_of_all_kinds(spark):
    point, line = [3.0, 4.0], [[0.0, 0.0], [5.0, 1.0]]
    ring, hole = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 0.0]], [[2.0, 1.0], [3.0, 1.0], [3.0, 2.0], [2.0, 1.0]]
    kinds = {"Point": point, "LineString": line, "MultiPoint": line, "Polygon": [ring, hole], "MultiLineString": [line, line], "MultiPolygon": [[ring], [ring, hole]]}
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"name": k}} for k, c in kinds.items()]
    features.append({"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": point}, {"type": "Polygon", "coordinates": [ring]}]}, "properties": {}})
    docs = spark.createDataFrame([(1, json.dumps({"type": "FeatureCollection", "features": features}))], "slide int, geojson string")
    t = spark.createDataFrame([(1, [1.0, 0.0, -2.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0])], "slide int, m array<double>")
    got = W.warp_geojson(docs, t)

    def moved(c):
        return [c[0] + 2, c[1] + 3] if isinstance(c[0], float) else [moved(x) for x in c]

    for r in got.collect():
        g, want = json.loads(r.geometry), features[r.feature]["geometry"]
        assert g["type"] == want["type"]
        if "coordinates" in want:
            assert g["coordinates"] == moved(want["coordinates"]) and r.properties == {"name": g["type"]}
        else:
            assert [x["coordinates"] for x in g["geometries"]] == [moved(x["coordinates"]) for x in want["geometries"]]
    again = json.loads(W.collections(got).first().geojson)
    assert again["type"] == "FeatureCollection" and len(again["features"]) == 7 and again["features"][3]["properties"] == {"name": "Polygon"}
    bad = spark.createDataFrame([(1, json.dumps({"features": [{"geometry": {"type": "Circle", "coordinates": [1, 2]}}]}))], "slide int, geojson string")
    with pytest.raises(Exception, match="unknown geometry"):
        W.warp_geojson(bad, t).collect()


def test_grids_and_polygons(spark):
    f = spark.createDataFrame([(1, 11, 7)], "slide int, w int, h int")
    assert [(r.x, r.y) for r in T.mesh(f, 5).orderBy("row", "col").collect()] == [(x, y) for y in (0, 5) for x in (0, 5, 10)]
    assert [(r.x, r.y) for r in T.mesh(f, 4, inclusive=True).orderBy("row", "col").collect()] == [(x, y) for y in (0, 4, 6) for x in (0, 4, 8, 10)]
    tri = T.triangles(T.mesh(f, 5))
    assert tri.count() == 8 and {(r.cx, r.cy) for r in tri.collect()} == {(2.5, 2.5), (7.5, 2.5)}
    shape = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    polygons = spark.createDataFrame([(1, 1, shape((0, 0), (10, 0), (10, 10), (0, 10))), (1, 2, shape((5, -5), (15, 5), (5, 15), (-5, 5))), (1, 3, shape((30, 30), (31, 30), (30, 31))), (2, 1, shape((0, 0), (1, 0), (0, 1)))], "slide int, id int, corners array<struct<x: double, y: double>>")
    (r,) = T.overlapping_polygons(polygons, 4.0).collect()
    assert (r.slide, r.a, r.b) == (1, 1, 2) and r.area == pytest.approx(100.0)
    ranks = T.ranked(spark.range(1000).withColumn("k", F.hash("id")), "k").orderBy("k").collect()
    assert [r.place for r in ranks] == list(range(1000))
    line = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 4.0, 0.0), ("a", 2, 4.0, 3.0)], "line string, k int, x double, y double")
    assert [(r.x, r.y) for r in T.split_line(line, 2.0).orderBy("n").collect()] == [(0, 0), (2, 0), (4, 0), (4, 2)]


def lzw(data):
    """Codes as a writer of such files makes them."""
    table, out, bits, n = {bytes([k]): k for k in range(256)}, [], 0, 258
    codes, w = [(256, 9)], b""
    width = lambda: 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    for c in data:
        k = w + bytes([c])
        if k in table:
            w = k
            continue
        codes.append((table[w], width()))
        table[k] = n
        n += 1
        w = bytes([c])
        if n > 4093:
            codes.append((256, 12))
            table, n = {bytes([k]): k for k in range(256)}, 258
    codes += [(table[w], width())]
    n += 1
    codes += [(257, width())]
    for code, size in codes:
        out.append(f"{code:0{size}b}")
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_codecs():
    rng = np.random.default_rng(6)
    for img in (rng.integers(0, 256, (30, 41)), rng.integers(0, 256, (13, 17, 3))):
        img = img.astype(np.uint8)
        assert (Z.decode_png(Z.encode_png(img)).squeeze() == img).all()
    data = bytes(rng.integers(0, 5, 20_000).astype(np.uint8))
    assert Z.unpack_lzw(lzw(data)) == data
    assert Z.unpack_bits(b"\x02abc\xfdx\x80\x00y") == b"abcxxxxy"
    with pytest.raises(NotImplementedError):
        Z.decompress(b"", 7)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(7)
    img = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    rows, before = b"", np.zeros(15, int)
    for y, how in enumerate((0, 1, 2, 3, 4, 4)):
        own = img[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(3, int), own[:-3]]), np.concatenate([np.zeros(3, int), before[:-3]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * own, left, before, (left + before) // 2, paeth][how]
        rows += bytes([how]) + ((own - guess) % 256).astype(np.uint8).tobytes()
        before = own
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = Z.PNG_HEAD + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    assert (Z.decode_png(raw) == img).all()


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    img = rng.integers(0, 60000, (150, 210, 2)).astype(np.uint16)
    t = RS.pack(pixels(spark, img, "a", ("p", "q")), ["p", "q"], "uint16", 64)
    levels = RS.pyramid(t, 3, 64).select(*[c.split()[0] for c in SI.TILE_SCHEMA.split(", ")])
    (r,) = SI.write_tiff(levels, str(tmp_path / "out"), 64, {"a": "<OME/>"}).collect()
    assert r.slide == "a" and r.path.endswith("a.ome.tiff") and r.bytes > 0
    for got in (SI.read_images(spark, str(tmp_path / "out")), None):
        if got is None:
            spark.dataSource.register(SI.TiffTiles)
            got = spark.read.format("tiff_tiles").option("path", r.path).load()
        rows = [x for x in got.collect() if x.level == 0]
        whole = np.zeros_like(img)
        for x in rows:
            whole[x.y0 : x.y0 + x.h, x.x0 : x.x0 + x.w] = np.frombuffer(x.data, x.dtype).reshape(x.h, x.w, x.bands)
        assert (whole == img).all() and {x.level for x in got.collect()} == {0, 1, 2}
    assert spark.read.format("tiff_tiles").option("path", r.path).option("level", "2").load().agg(F.max(F.col("x0") + F.col("w"))).first()[0] == 53
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path", "content")
    seen = SI.probe(files).first()
    assert (seen.reader, seen.is_ome, seen.pages, seen.levels, seen.w, seen.h, seen.bands, seen.dtype) == ("ome_tiff", True, 1, 3, 210, 150, 2, "uint16")
    SI.convert(spark, str(tmp_path / "out"), str(tmp_path / "again"), xywh=(10, 20, 100, 90), levels=2, side=32).collect()
    part = SI.read_images(spark, str(tmp_path / "again")).where("level = 0")
    whole = np.zeros((90, 100, 2), np.uint16)
    for x in part.collect():
        whole[x.y0 : x.y0 + x.h, x.x0 : x.x0 + x.w] = np.frombuffer(x.data, x.dtype).reshape(x.h, x.w, x.bands)
    assert (whole == img[20:110, 10:110]).all()


def flat_tiff(pages, planar=False):
    """A plain TIFF of strips, page after page, in the other order of bytes."""
    import struct

    out, places = bytearray(b"MM\x00\x2a\x00\x00\x00\x00"), []
    for img in pages:
        at = len(out)
        out += img.astype(">u2").tobytes()
        directory = len(out)
        tags = [(256, 3, img.shape[1]), (257, 3, img.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, at), (277, 3, 1), (278, 3, img.shape[0]), (279, 4, img.size * 2)]
        out += struct.pack(">H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
        places.append((directory, len(out)))
        out += b"\0\0\0\0"
    out[4:8] = struct.pack(">I", places[0][0])
    for (_, end), (start, _) in zip(places, places[1:], strict=False):
        out[end : end + 4] = struct.pack(">I", start)
    return bytes(out)


def test_flattened_pages_are_told(spark):
    rng = np.random.default_rng(9)
    pages = [rng.integers(0, 999, s) for s in ((40, 60), (40, 60), (20, 30), (20, 30))]
    raw = flat_tiff(pages)
    t = Z.Tiff(io.BytesIO(raw))
    assert [(p.w, p.h) for p in t.pages] == [(60, 40), (60, 40), (30, 20), (30, 20)] and (t.tile(t.pages[2], 0, 0)[..., 0] == pages[2]).all()
    files = spark.createDataFrame([("a.tif", bytearray(raw)), ("b.png", bytearray(Z.encode_png(np.zeros((3, 3), np.uint8)))), ("c", bytearray(b"nothing")), ("d.tif", bytearray(flat_tiff(pages[:1])))], "path string, content binary")
    got = {r.path: (r.reader, r.levels) for r in SI.probe(files).collect()}
    assert got == {"a.tif": ("flattened_tiff", 2), "b.png": ("image", 1), "c": (None, 0), "d.tif": ("tiff", 1)}


def test_thumbnails_and_merging(spark):
    img = np.stack([smooth(90, 120), smooth(90, 120, 1)], axis=-1)
    t = RS.pack(pixels(spark, img, "a", ("p", "q")), ["p", "q"], "uint8")
    (r,) = SI.thumbnails(t, 60).collect()
    small = Z.decode_png(bytes(r.png))
    assert (r.w, r.h) == (60, 45) and small.shape == (45, 60, 1) and abs(small.mean() - img[..., 0].mean()) < 2
    both = t.unionByName(RS.pack(pixels(spark, img[..., ::-1], "b", ("p", "q")), ["p", "q"], "uint8"))
    channels = spark.createDataFrame([("a", 0, 0, "DAPI"), ("a", 0, 1, "CD3"), ("b", 1, 0, "DAPI"), ("b", 1, 1, "CD8")], "slide string, stack_idx int, pos int, name string")
    assert [(x.place, x.slide, x.name) for x in T.merged_channels(channels).orderBy("place").collect()] == [(0, "a", "DAPI"), (1, "a", "CD3"), (2, "b", "CD8")]
    merged = T.merge_tiles(both, channels, "uint8")
    out = np.zeros((90, 120, 3))
    for x in merged.collect():
        out[x.y0 : x.y0 + x.h, x.x0 : x.x0 + x.w] = np.frombuffer(x.data, x.dtype).reshape(x.h, x.w, x.bands)
    want = K.cast(np.stack([img[..., 0], img[..., 1], img[..., 0]], -1), "uint8")
    assert (out == want).all()


def test_tiles_of_one_batch_and_of_several(spark):
    """Small tiles that share a batch of rows, and tiles of more rows than a batch has, for keys that may be null."""
    from tilewright.operators.tiled import by_tile

    rows = [(k, x, y, float(x * 7 + y * 3 + n)) for n, k in enumerate(("a", "b", None)) for x in range(9 + n) for y in range(8)]
    pixels = spark.createDataFrame(rows, "image string, x int, y int, v double")
    run = lambda a, there: {"s": np.where(there, a["v"] + there.sum(), 0)}
    want = by_tile(pixels, ["v"], run, {"s": "double"}, 4).collect()
    size = {}
    for k, x, y, _ in rows:
        size[k, x // 4, y // 4] = size.get((k, x // 4, y // 4), 0) + 1
    assert sorted(map(str, want)) == sorted(str(type(want[0])(image=k, x=x, y=y, s=v + size[k, x // 4, y // 4])) for k, x, y, v in rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(str, by_tile(pixels, ["v"], run, {"s": "double"}, 4).collect())) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
