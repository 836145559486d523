"""Queries: names, readers, pyramids, tiles, channels and other metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import names as N
from tilewright.operators import tiles as T
from tilewright.plans import views as V
from tilewright.plans.registry import query
from tilewright.session import table

EXTS = ("ome.tiff", "svs", "czi", "png", "tif", "txt", "npy")
FILES = "files AS (SELECT c_custkey, '/data/' || c_mktsegment || '/' || c_name || '.' || (['" + "', '".join(EXTS) + "'])[c_custkey % 7 + 1] AS path FROM customer)"


def files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(e) for e in EXTS]), (F.col("c_custkey") % 7).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("."), ext).alias("path"))


@query("WITH " + FILES + " SELECT c_custkey, regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.(ome\\.tiff|ome\\.tif|tiff|tif|svs|ndpi|czi|png|jpg)$', '') AS name FROM files")
def slide_names(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("c_custkey", N.slide_name(F.col("path")).alias("name"))


@query(
    "WITH " + FILES + """, e AS (SELECT c_custkey, regexp_extract(path, '\\.([A-Za-z]+)$', 1) AS ext, path LIKE '%.ome.%' AS is_ome FROM files)
SELECT c_custkey, ext, CASE WHEN ext IN ('png', 'jpg', 'jpeg', 'bmp') THEN 'image' WHEN ext IN ('svs', 'ndpi', 'mrxs', 'scn', 'vms', 'bif') THEN 'openslide' WHEN ext = 'czi' THEN 'czi'
  WHEN ext IN ('tif', 'tiff') AND is_ome THEN 'ome_tiff' WHEN ext IN ('tif', 'tiff') THEN 'tiff' WHEN ext IN ('npy', 'tile') THEN 'tile' END AS reader FROM e"""
)
def reader_plan(spark: SparkSession, d: str) -> DataFrame:
    e = files(spark, d).select("c_custkey", F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("ext"), F.col("path").contains(".ome.").alias("is_ome"))
    return e.select("c_custkey", "ext", T.reader_for(F.col("ext"), F.col("is_ome")).alias("reader"))


@query("SELECT p_partkey, CASE WHEN length(p_brand) = 0 THEN 0 ELSE levenshtein(p_brand, p_type) END::INT AS d FROM part")
def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", N.edit_distance(F.col("p_brand"), F.col("p_type")).alias("d"))


@query("SELECT user_id, round(CASE WHEN s < 60 THEN s WHEN s < 3600 THEN s / 60 ELSE s / 3600 END, 3) AS value, CASE WHEN s < 60 THEN 'seconds' WHEN s < 3600 THEN 'minutes' ELSE 'hours' END AS unit FROM (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS s FROM events GROUP BY user_id)")
def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    """The time between a user's first and last event."""
    s = table(spark, d, "events").groupBy("user_id").agg(((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6).alias("s"))
    return s.select("user_id", N.elapsed(F.col("s")).alias("e")).select("user_id", "e.*")


@query("SELECT p_partkey, '#' || lpad(printf('%x', p_partkey * 7919 % 16777216), 6, '0') AS hex, (p_partkey * 7919 % 16777216 // 65536)::INT AS r, (p_partkey * 7919 % 65536 // 256)::INT AS g, (p_partkey * 7919 % 256)::INT AS b FROM part")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    return table(spark, d, "part").select("p_partkey", code.alias("hex")).select("p_partkey", "hex", N.hex_to_rgb(F.col("hex")).alias("c")).select("p_partkey", "hex", "c.*")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey)::INT AS place FROM supplier")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Names of which the numbers aren't padded, in the order of the numbers."""
    s = table(spark, d, "supplier").select("s_suppkey", N.natural_key(F.concat(F.lit("slide_"), F.col("s_suppkey").cast("string"), F.lit(".tif"))).alias("key"))
    return T.ranked(s, "key").select("s_suppkey", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT p_partkey, p_name || CASE WHEN n > 1 THEN '_' || lpad((k - 1)::VARCHAR, length(n::VARCHAR)::INT, '0') ELSE '' END AS name FROM (SELECT p_partkey, p_brand AS p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.row_number().over(w.orderBy("p_partkey")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return p.select("p_partkey", N.distinct_names(F.col("p_brand"), F.col("k"), F.col("n")).alias("name"))


@query("SELECT r_regionkey, arg_min(n_nationkey, (levenshtein(lower(n_name), lower(r_name)), n_nationkey)) AS reference FROM region, nation WHERE n_regionkey = r_regionkey GROUP BY r_regionkey")
def reference_image(spark: SparkSession, d: str) -> DataFrame:
    """Of each stack the image with the name nearest to the one asked for, the first of equals."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    near = F.min(F.struct(F.levenshtein(F.lower("n_name"), F.lower("r_name")).alias("d"), F.col("n_nationkey").alias("k")))
    return j.groupBy("r_regionkey").agg(near.alias("m")).select("r_regionkey", F.col("m.k").alias("reference"))


@query("WITH f AS (SELECT s_nationkey AS dir, (['tif', 'tif', 'mrxs', 'tif'])[s_suppkey % 4 + 1] AS ext, s_name AS file FROM supplier), b AS (SELECT dir, ext, count(*) AS n, min(file) AS file FROM f GROUP BY ALL) SELECT dir, arg_min(file, (n, ext)) AS master FROM b GROUP BY dir HAVING count(*) > 1 AND min(n) = 1")
def staining_rounds(spark: SparkSession, d: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(e) for e in ("tif", "tif", "mrxs", "tif")]), (F.col("s_suppkey") % 4).cast("int"))
    return T.staining_rounds(table(spark, d, "supplier").select(F.col("s_nationkey").alias("dir"), ext.alias("ext"), F.col("s_name").alias("file")))


@query("WITH " + FILES + " SELECT regexp_extract(path, '^/data/([^/]+)/', 1) AS dir, count(*) AS n, min(path) AS first FROM files WHERE regexp_extract(path, '\\.([A-Za-z]+)$', 1) IN ('tif', 'tiff', 'svs', 'czi', 'png') GROUP BY 1")
def image_listing(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).isin("tif", "tiff", "svs", "czi", "png"))
    return f.groupBy(F.regexp_extract("path", "^/data/([^/]+)/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("SELECT o.o_orderkey, c.c_custkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey % 2 = 0 UNION ALL SELECT o.o_orderkey, c.c_custkey, c.c_name FROM orders o JOIN customer c ON c.c_name = 'Customer#' || lpad(o.o_custkey::VARCHAR, 9, '0') WHERE o.o_orderkey % 2 = 1")
def slide_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Slides by number or by name: a union of two equi joins."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name")
    by_key = o.where("o_orderkey % 2 = 0").join(c, F.col("o_custkey") == F.col("c_custkey"))
    by_name = o.where("o_orderkey % 2 = 1").join(c, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")) == F.col("c_name"))
    return by_key.unionByName(by_name).select("o_orderkey", "c_custkey", "c_name")


@query(V.with_views("slide_levels", "SELECT slide, coalesce(min(level) FILTER (WHERE greatest(w, h) <= 1024), max(level)) AS level FROM slide_levels GROUP BY slide"))
def level_for_size(spark: SparkSession, d: str) -> DataFrame:
    return T.level_for(V.slide_levels(spark, d), 1024)


@query(V.with_views("slide_levels", "SELECT l.slide, l.level, round(0.25::DOUBLE * b.w / l.w, 9) AS px_x, round(0.25::DOUBLE * b.h / l.h, 9) AS px_y, round(100 * 1 / (0.25::DOUBLE * b.w / l.w), 9) AS px_per_100um, round(l.w::DOUBLE * l.h * 3 * 16 / 8 / 1073741824, 9) AS memory_gb FROM slide_levels l JOIN slide_levels b ON b.slide = l.slide AND b.level = 0"))
def physical_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Pixel sizes of all levels in micrometres, pixels of a length, and memory of three bands of 16 bits."""
    return T.sizes_at_levels(V.slide_levels(spark, d), F.lit(0.25), 3, 16).select("slide", "level", *[F.round(c, 9).alias(c) for c in ("px_x", "px_y", "px_per_100um", "memory_gb")])


@query(
    V.with_views(
        "slide_levels",
        """AND p AS (SELECT slide, level * 3 + c AS page, w, h FROM slide_levels, (VALUES (0), (1), (2)) v(c)), l AS (SELECT *, CASE WHEN w * h <> lag(w * h) OVER o THEN 1 ELSE 0 END AS new FROM p WINDOW o AS (PARTITION BY slide ORDER BY page)),
g AS (SELECT *, sum(new) OVER (PARTITION BY slide ORDER BY page)::BIGINT AS lv FROM l) SELECT slide, lv AS level, max(w) AS w, max(h) AS h, count(*) AS pages FROM g GROUP BY slide, lv""",
    )
)
def flattened_pyramid(spark: SparkSession, d: str) -> DataFrame:
    pages = V.slide_levels(spark, d).selectExpr("slide", "level", "w", "h", "explode(sequence(0, 2)) as c").selectExpr("slide", "level * 3 + c as page", "w", "h")
    return T.pyramid_levels(pages)


@query(
    V.with_views(
        "slide_levels",
        """AND s AS (SELECT slide, level, w, h, (w - 1) // 512 AS nx, (h - 1) // 512 AS ny FROM slide_levels), t AS (SELECT slide, level, w, h, nx, unnest(range(0, ny + 1))::INT AS ty FROM s), u AS (SELECT slide, level, w, h, ty, unnest(range(0, nx + 1))::INT AS tx FROM t)
SELECT slide, level, tx, ty, tx * 512 AS x, ty * 512 AS y, least(512, w - tx * 512) AS w, least(512, h - ty * 512) AS h FROM u""",
    )
)
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return T.grid_boxes(V.slide_levels(spark, d), 512, 512, keys=("slide", "level"))


@query(
    V.with_views(
        "slide_levels",
        """AND s AS (SELECT slide, level, w, h, (w - 1) // 512 - 1 AS nx, (h - 1) // 512 - 1 AS ny FROM slide_levels), t AS (SELECT slide, level, w, h, nx, unnest(range(0, ny + 1))::INT AS ty FROM s WHERE nx >= 0 AND ny >= 0), u AS (SELECT slide, level, w, h, ty, unnest(range(0, nx + 1))::INT AS tx FROM t)
SELECT slide, level, tx, ty, tx * 512 AS x, ty * 512 AS y, least(512, w - tx * 512) AS w, least(512, h - ty * 512) AS h FROM u""",
    )
)
def tile_grid_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return T.grid_boxes(V.slide_levels(spark, d), 512, 512, inclusive=False, keys=("slide", "level"))


@query(V.with_views("slide_levels", "AND p AS (SELECT slide, level, w, unnest([16, 32, 64, 128, 256, 512]) AS t FROM slide_levels) SELECT slide, level, CASE WHEN any_value(w) >= 512 THEN 512 ELSE arg_min(t, (ceil(w / t::DOUBLE) * t - w, -t)) END::INT AS tile FROM p GROUP BY slide, level"))
def output_tile_sizes(spark: SparkSession, d: str) -> DataFrame:
    return V.slide_levels(spark, d).select("slide", "level", T.output_tile_side(F.col("w")).cast("int").alias("tile"))


@query(V.with_views("channels", "SELECT (row_number() OVER (ORDER BY stack_idx, pos) - 1)::INT AS place, slide, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stack_idx, pos) AS k FROM channels) WHERE k = 1"))
def merged_channels(spark: SparkSession, d: str) -> DataFrame:
    return T.merged_channels(V.channels(spark, d))


@query(V.with_views("channels", "SELECT slide, pos, CASE WHEN name IS NULL OR name IN ('None', 'red') THEN 'C' || (pos + 1) ELSE name END AS name FROM channels"))
def channel_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of channels, with default ones in place of those that say nothing."""
    return T.named_channels(V.channels(spark, d), F.col("name").isin("None", "red")).select("slide", "pos", "name")


@query(V.with_views("channels", "AND colours AS (SELECT DISTINCT name FROM channels WHERE length(name) <= 6) SELECT slide, count(*) AS n, (count(*) FILTER (WHERE name NOT IN (SELECT name FROM colours)))::BIGINT AS missing, (count(*) FILTER (WHERE name NOT IN (SELECT name FROM colours))) = 0 AS coloured FROM channels GROUP BY slide"))
def colormap_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a map of colours, here of the short names, has all channels of a slide; one without goes uncoloured."""
    c = V.channels(spark, d)
    return T.check_colours(c, c.where(F.length("name") <= 6).select("name"))


TYPES = "(VALUES ('uint8', 'short', 8), ('int8', 'byte', 8), ('uint16', 'int', 16), ('int16', 'short', 16), ('uint32', 'long', 32), ('int32', 'int', 32), ('float', 'float', 32), ('double', 'double', 64)) t(pixel, spark_type, bits)"


@query("SELECT p_partkey, pixel, spark_type, bits FROM (SELECT p_partkey, (['uint8', 'int8', 'uint16', 'int16', 'uint32', 'int32', 'float', 'double'])[p_size % 8 + 1] AS pixel FROM part) JOIN " + TYPES + " USING (pixel)")
def pixel_types(spark: SparkSession, d: str) -> DataFrame:
    # Spark's types that hold pixel types, and their bits.
    kinds = {"uint8": ("short", 8), "int8": ("byte", 8), "uint16": ("int", 16), "int16": ("short", 16), "uint32": ("long", 32), "int32": ("int", 32), "float": ("float", 32), "double": ("double", 64)}
    p = table(spark, d, "part").select("p_partkey", F.get(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % 8).alias("pixel"))
    of = lambda k: F.create_map(*[F.lit(x) for n, v in kinds.items() for x in (n, v[k])])
    return p.select("p_partkey", "pixel", of(0)[F.col("pixel")].alias("spark_type"), of(1)[F.col("pixel")].alias("bits"))


@query("SELECT p_partkey, (p_size % 2 = 0) AS is_rgb, CASE WHEN p_size % 2 = 0 THEN 'brightfield' ELSE 'fluorescence' END AS image_type, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'custom' END, CASE WHEN p_size % 2 = 0 THEN 'od' ELSE 'channel' END) AS processor FROM part")
def processors(spark: SparkSession, d: str) -> DataFrame:
    """The processor of each image: one asked for by name, or its type's."""
    rgb = F.col("p_size") % 2 == 0
    asked = F.when(F.col("p_partkey") % 5 == 0, "custom")
    return table(spark, d, "part").select("p_partkey", rgb.alias("is_rgb"), T.image_type(rgb).alias("image_type"), T.processor_for(rgb, asked).alias("processor"))


@query(V.with_views("slide_levels", "SELECT slide, level, w, h, (min(greatest(w, h)) OVER (PARTITION BY level))::INT AS most, greatest(1, round(w * (min(greatest(w, h)) OVER (PARTITION BY level))::DOUBLE / greatest(w, h)))::INT AS new_w FROM slide_levels"))
def common_size(spark: SparkSession, d: str) -> DataFrame:
    """Images shrunk to the smallest of their largest sides."""
    return T.common_size(V.slide_levels(spark, d)).drop("new_h")


@query(V.with_views("slide_levels", "SELECT slide, level, (h // 2 * w + w // 3)::BIGINT AS flat, ((h // 2 * w + w // 3) // w)::INT AS row, ((h // 2 * w + w // 3) % w)::INT AS col FROM slide_levels"))
def flat_index(spark: SparkSession, d: str) -> DataFrame:
    s = V.slide_levels(spark, d).selectExpr("slide", "level", "w", "cast(h div 2 * w + w div 3 as bigint) as flat")
    return s.selectExpr("slide", "level", "flat", "cast(flat div w as int) as row", "cast(flat % w as int) as col")


@query(
    V.with_views(
        "pixels",
        """AND e AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image),
c AS (SELECT image, x, y, v1, w, h, x // 12 - p AS i, y // 16 - q AS j FROM pixels JOIN e USING (image), (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q)),
t AS (SELECT image, x, y, v1 + i + j AS v, x - 12 * i AS px, y - 16 * j AS py, least(16, w - 12 * i) AS tw, least(20, h - 16 * j) AS th FROM c
  WHERE i >= 0 AND j >= 0 AND x < 12 * i + 16 AND y < 16 * j + 20 AND (i = 0 OR 12 * i + 4 < w) AND (j = 0 OR 16 * j + 4 < h)),
g AS (SELECT image, x, y, v, least(least(px, tw - 1 - px), least(py, th - 1 - py)) + 1 AS weight FROM t)
SELECT image, x, y, round(sum(weight * v) / sum(weight), 6) AS v FROM g GROUP BY image, x, y""",
    )
)
def stitched_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Whole images from tiles of 16 x 20 pixels that share 4 with the next; the last ones end with the image."""
    p = V.pixels(spark, d)
    p = p.join(F.broadcast(p.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))), "image")
    near = lambda c, n: F.explode(F.array(F.expr(f"cast({c} div {n} as int)"), F.expr(f"cast({c} div {n} as int) - 1")))
    p = p.withColumn("i", near("x", 12)).withColumn("j", near("y", 16)).where("i >= 0 AND j >= 0 AND x < 12 * i + 16 AND y < 16 * j + 20 AND (i = 0 OR 12 * i + 4 < w) AND (j = 0 OR 16 * j + 4 < h)")
    t = p.selectExpr("image", "struct(i, j) as tile", "12 * i as tx", "16 * j as ty", "least(16, w - 12 * i) as tw", "least(20, h - 16 * j) as th", "x", "y", "v1 + i + j as v")
    return T.stitch(t).select("image", "x", "y", F.round("v", 6).alias("v"))


@query(V.with_views("transforms", "AND v AS (SELECT slide, k, a * k AS x, b * k * k AS y FROM transforms, (SELECT unnest(range(0, 12)) AS k)), s AS (SELECT slide, k // 4 AS win, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY slide, k // 4 ORDER BY k)), g AS (SELECT slide, win, sum(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS len, sqrt(pow(arg_max(x, k) - arg_min(x, k), 2) + pow(arg_max(y, k) - arg_min(y, k), 2)) AS chord FROM s GROUP BY ALL) SELECT slide, round((count(*) - 1) / sum(len) * sum(len / chord - 1), 6) AS tortuosity FROM g GROUP BY slide"))
def polygon_tortuosity(spark: SparkSession, d: str) -> DataFrame:
    """How much longer a line is than the chords of its windows of four vertices."""
    v = V.transforms(spark, d).selectExpr("slide", "a", "b", "explode(sequence(0, 11)) as k").selectExpr("slide", "k", "a * k as x", "b * k * k as y")
    return T.tortuosity(v).select("slide", F.round("tortuosity", 6).alias("tortuosity"))