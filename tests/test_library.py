"""Column functions, the registrar, sources and streams."""

import duckdb  # noqa: F401
import numpy as np
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.functions import names as N
from tilewright.operators import grouped as G
from tilewright.operators import matching as M
from tilewright.operators import raster as P
from tilewright.operators import tiles as T
from tilewright.plans import views as V
from tilewright.plans.registrar import Registrar, register_function
from tilewright.plans import q_colour, q_register, q_tiles, q_warp  # noqa: F401
from tilewright.plans.registry import QUERIES
from tilewright.session import table
from tilewright.sources import readers as S
from tilewright.streaming import points as ST


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_matrices(spark):
    m = np.array([[1.2, -0.4, 30], [0.4, 1.1, -8], [0.001, 0.0005, 1]])
    col = A.matrix(*m.ravel().tolist())
    r = one(spark, A.inverse(col).alias("i"), A.matmul(col, A.inverse(col)).alias("e"), A.warp_rigid(col, F.lit(5.0), F.lit(7.0)).alias("p"), A.inverse(A.matrix(1, 2, 0, 2, 4, 0, 0, 0, 1)).alias("s"))
    assert np.allclose(r.i, np.linalg.inv(m).ravel()) and np.allclose(r.e, np.eye(3).ravel(), atol=1e-12) and r.s is None
    q = np.linalg.inv(m) @ [5, 7, 1]
    assert np.allclose([r.p.x, r.p.y], q[:2] / q[2])
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    r = one(spark, A.polygon_area(square).alias("a"), A.point_in_polygon(F.lit(1.0), F.lit(1.0), square).alias("i"), A.point_in_polygon(F.lit(5.0), F.lit(1.0), square).alias("o"))
    assert (r.a, r.i, r.o) == (12.0, True, False)


def test_names(spark):
    r = one(spark, N.slide_name(F.lit("/a/b.c/x.ome.tiff")).alias("a"), N.slide_name(F.lit("y.SVS")).alias("b"), N.slide_name(F.lit("z.txt")).alias("c"), N.edit_distance(F.lit(""), F.lit("abc")).alias("d"), N.elapsed(F.lit(90.0)).alias("e"), N.hex_to_rgb(F.lit("#0aff10")).alias("f"))
    assert (r.a, r.b, r.c, r.d, tuple(r.e), tuple(r.f)) == ("x", "y", "z.txt", 0, (1.5, "minutes"), (10, 255, 16))


def test_filters_at_their_edges(spark):
    m = spark.createDataFrame([(0, 1, i, 1.0) for i in range(5)] + [(1, 2, i, float(i)) for i in range(5)] + [(1, 2, 9, 100.0)], "image1 int, image2 int, i int, r double")
    kept = {(r.image1, r.i) for r in M.tukey_filter(m).collect()}
    assert kept == {(1, i) for i in range(5)}
    d = spark.createDataFrame([(0, 1, 0, 0, 1.0), (0, 1, 0, 1, 1.0), (0, 1, 1, 0, 1.0), (0, 1, 1, 1, 2.0)], "image1 int, image2 int, i int, j int, d double")
    assert {(r.i, r.j) for r in M.nearest(d).collect()} == {(0, 0)}
    assert M.nearest(d, max_distance=1.0).count() == 0 and {(r.i, r.j) for r in M.nearest(d, False, max_ratio=0.9).collect()} == {(1, 0)}


def test_components_of_a_snake(spark):
    path = [(x, 0) for x in range(30)] + [(29, y) for y in range(30)] + [(x, 29) for x in range(30)] + [(50, 50)]
    got = P.components(spark.createDataFrame([(0, x, y) for x, y in path], "image int, x int, y int")).collect()
    assert {r.comp for r in got} == {0, (50 << 32) + 50}


def test_tiles(spark):
    s = spark.createDataFrame([(1, 1024, 500), (2, 513, 512), (3, 100, 30)], "slide int, w int, h int")
    got = T.grid_boxes(s, 512, 512).collect()
    assert {(r.slide, r.tx, r.ty, r.w, r.h) for r in got} == {(1, 0, 0, 512, 500), (1, 1, 0, 512, 500), (2, 0, 0, 512, 512), (2, 1, 0, 1, 512), (3, 0, 0, 100, 30)}
    assert T.grid_boxes(s, 512, 512, inclusive=False).count() == 0
    assert [r.t for r in s.orderBy("slide").select(T.output_tile_side(F.col("w")).cast("int").alias("t")).collect()] == [512, 512, 16]


def test_registrar(spark, sf_dir, tmp_path):
    kp = V.keypoints(spark, sf_dir)
    r = Registrar(kp).register()
    assert r.summary().count() > 0
    pts = spark.createDataFrame([(1, 10.0, 20.0)], "slide int, x double, y double")
    back = r.warp_xy_from_to(pts, F.lit(1)).first()
    assert np.allclose([back.wx, back.wy], [10, 20])
    r.save(str(tmp_path / "stack"))
    again = Registrar.load(spark, str(tmp_path / "stack"), kp)
    assert again.warp_xy(pts).first() == r.warp_xy(pts).first()
    register_function("matcher", "none", lambda k, pairs: M.match_pairs(k, pairs).where("false"))
    assert Registrar(kp, matcher="none").register().summary().count() == 0


def test_sources(spark, tmp_path):
    img = np.arange(700 * 600, dtype=np.uint16).reshape(700, 600)
    np.save(tmp_path / "slide.npy", img)
    t = S.read_slide(spark, str(tmp_path / "slide.npy"), "tile", tile="256")
    rows = t.collect()
    assert len(rows) == 9
    whole = np.zeros_like(img)
    for r in rows:
        whole[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
    assert (whole == img).all()
    S.write_tiles(t, str(tmp_path / "tiles"))
    some = S.read_tiles(spark, str(tmp_path / "tiles"), "slide", 0, (0, 0, 100, 300))
    assert {(r.tx, r.ty) for r in some.collect()} == {(0, 0), (0, 1)} and "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString()
    d = S.decode_binary_arrays(spark.read.format("binaryFile").load(str(tmp_path / "slide.npy"))).first()
    assert (d.w, d.h, d.bands, d.dtype) == (600, 700, 1, "uint16")
    for reader, error in (("ome_tiff", NotImplementedError), ("who", ValueError)):
        try:
            S.read_slide(spark, "x", reader)
            raise AssertionError
        except error:
            pass


def test_metadata_round_trip(spark):
    xml = S.ome_xml(F.lit(640), F.lit(480), F.lit("uint8"), F.lit(0.5), F.array(F.lit("DAPI"), F.lit("CD<3>\x01")))
    r = one(spark, S.ome_metadata(xml).alias("m")).m
    assert (r.size_x, r.size_y, r.size_c, r.type, r.px_x, r.unit, r.channels) == (640, 480, 2, "uint8", 0.5, "µm", ["DAPI", "CD3"])


def test_landmarks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("anon_id,point_id,mpp_source,x_source,y_source,mpp_target\n1,2,0.5,10,20,0.25\n")
    t = S.read_landmarks(spark, str(tmp_path / "l.csv"))
    assert (t.first().x, t.first().y) == (20.0, 40.0)
    S.write_landmarks(t.withColumns({"wx": F.col("x"), "wy": F.col("y")}), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).first().x_target == 5.0


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = spark.createDataFrame([(1, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0])], "slide int, m array<double>")
    spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0)], "slide int, x double, y double").write.parquet(src)
    for _ in range(2):
        ST.write_stream(ST.warp_stream(spark, src, "slide int, x double, y double", t), out, str(tmp_path / "cp")).awaitTermination()
    assert [(r.wx, r.wy) for r in spark.read.parquet(out).collect()] == [(3.0, 2.0)]
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0, 1, 0.0, 0.0, 3.0, 4.0)], "ts string, image1 int, image2 int, x1 double, y1 double, x2 double, y2 double").selectExpr("to_timestamp(ts) as ts", "image1", "image2", "x1", "y1", "x2", "y2")
    assert ST.error_windows(rows, "ts").first().mean_error == 5.0


def test_ransac_operator_passes_small_pairs(spark):
    m = spark.createDataFrame([(0, 1, i, i, float(i), 0.0, float(i), 9.0 * i) for i in range(3)], "image1 int, image2 int, i int, j int, x1 double, y1 double, x2 double, y2 double")
    assert G.ransac_filter(m).count() == 3


def test_queries_over_all_slides(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").count()
    slides = table(spark, sf_dir, "part").count()
    rows = {"natural_order": names, "affine_decompose": names, "warped_canvas": 5 * names, "affine_decompose_all": slides, "affine_scaled_all": slides, "affine_inverse_all": slides, "warped_area_all": 5 * slides, "warped_canvas_all": 5 * slides, "warp_geojson_all": 15 * slides}
    for name, n in rows.items():
        assert QUERIES[name](spark, sf_dir).count() == n, name


def test_queries_over_whole_images(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    assert QUERIES["stitched_tiles"](spark, sf_dir).count() == p.count()
    frames = p.groupBy("image").agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("n")).agg(F.sum("n")).first()[0]
    assert QUERIES["warp_raster_nearest"](spark, sf_dir).count() == frames
