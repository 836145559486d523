"""Plans of tiles, pyramids, readers and channels: metadata as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.kernels.images import clip_convex
from tilewright.kernels.resample import cast
from tilewright.session import checkpointed


def grid_boxes(images: DataFrame, tile_w: int, tile_h: int, inclusive: bool = True, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """(*keys, tx, ty, x, y, w, h): tiles row by row. With ``inclusive`` partial tiles close the last row
    and column; otherwise only tiles between two grid lines below the size count."""
    last = (lambda k, t: F.floor((F.col(k) - 1) / t)) if inclusive else (lambda k, t: F.floor((F.col(k) - 1) / t) - 1)
    s = images.select(*keys, "w", "h", last("w", tile_w).cast("int").alias("nx"), last("h", tile_h).cast("int").alias("ny")).where("nx >= 0 AND ny >= 0")
    s = s.select("*", F.explode(F.expr("sequence(0, ny)")).alias("ty")).select("*", F.explode(F.expr("sequence(0, nx)")).alias("tx"))
    x, y = F.col("tx") * tile_w, F.col("ty") * tile_h
    return s.select(*keys, "tx", "ty", x.alias("x"), y.alias("y"), F.least(F.lit(tile_w), F.col("w") - x).alias("w"), F.least(F.lit(tile_h), F.col("h") - y).alias("h"))


def mesh(frames: DataFrame, spacing: int, inclusive: bool = False, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """(*keys, row, col, x, y): points of a grid over each frame (w, h), or over a box of it (x, y, w, h); with ``inclusive``
    the last row and column of pixels close it."""
    has_box = {"x", "y"} <= set(frames.columns)
    s = frames.select(*keys, "w", "h", *[(F.col(c) if has_box else F.lit(0)).alias(f"__{c}") for c in "xy"])

    def places(size: str) -> Column:
        at = F.sequence(F.lit(0), F.col(size) - 1, F.lit(spacing))
        return F.array_distinct(F.concat(at, F.array(F.col(size) - 1))) if inclusive else at

    s = s.select("*", F.posexplode(places("h")).alias("row", "__r")).select("*", F.posexplode(places("w")).alias("col", "__c"))
    return s.select(*keys, "row", "col", (F.col("__x") + F.col("__c")).alias("x"), (F.col("__y") + F.col("__r")).alias("y"))


def triangles(grid: DataFrame, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """(*keys, row, col, side, ax, ay, bx, by, cx, cy): the four triangles of each cell of a mesh: two corners that are next to each
    other, in order of the sides top, right, bottom, left, and the cell's middle."""
    corner = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])).alias("o")
    p = grid.select(*keys, "row", "col", "x", "y", corner).select(*keys, (F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), "o.r", "o.c", "x", "y")
    at = lambda v, r, c: F.sum(F.when((F.col("r") == r) & (F.col("c") == c), F.col(v)))
    cells = p.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n"), *[at(v, r, c).alias(f"{v}{r}{c}") for v in "xy" for r in (0, 1) for c in (0, 1)]).where("n = 4")
    mid = lambda v: (F.col(f"{v}00") + F.col(f"{v}01") + F.col(f"{v}10") + F.col(f"{v}11")) / 4
    sides = [("top", "00", "01"), ("right", "01", "11"), ("bottom", "11", "10"), ("left", "10", "00")]
    of = lambda k, a, b: F.struct(F.lit(k).alias("side"), F.col(f"x{a}").alias("ax"), F.col(f"y{a}").alias("ay"), F.col(f"x{b}").alias("bx"), F.col(f"y{b}").alias("by"), mid("x").alias("cx"), mid("y").alias("cy"))
    return cells.select(*keys, "row", "col", F.explode(F.array(*[of(*s) for s in sides])).alias("t")).select(*keys, "row", "col", "t.*")


def expanded_box(x: Column, y: Column, w: Column, h: Column, by: Column, frame_w: Column, frame_h: Column) -> Column:
    """struct(x, y, w, h): a box grown on all sides, within its frame. The corner is held at 0 first, and the sides, grown twice, end with the frame."""
    left, top = F.greatest(x - by, F.lit(0)), F.greatest(y - by, F.lit(0))
    return F.struct(left.alias("x"), top.alias("y"), F.least(w + 2 * by, frame_w - left).alias("w"), F.least(h + 2 * by, frame_h - top).alias("h"))


def clipped(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y): a point within a frame, edges included."""
    return F.struct(F.least(F.greatest(x, F.lit(0.0)), w).alias("x"), F.least(F.greatest(y, F.lit(0.0)), h).alias("y"))


def box_pixels(boxes: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """(*keys, x, y): the pixels of boxes (x, y, w, h), with the row and column that they end before."""
    b = boxes.select(*keys, "y", "h", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w"))).alias("__x"))
    return b.select(*keys, F.col("__x").alias("x"), F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h"))).alias("y"))


def sizes_at_levels(levels: DataFrame, px: Column, bands: int, bits: int) -> DataFrame:
    """(slide, level, px_x, px_y, px_per_100um, memory_gb): pixel sizes of all levels, pixels of 100 units, and memory of an image of so many bands and bits."""
    base = levels.where("level = 0").select("slide", F.col("w").alias("w0"), F.col("h").alias("h0"))
    x = px * F.col("w0") / F.col("w")
    gb = F.col("w").cast("double") * F.col("h") * bands * bits / 8 / (1 << 30)
    return levels.join(base, "slide").select("slide", "level", x.alias("px_x"), (px * F.col("h0") / F.col("h")).alias("px_y"), (100 * 1 / x).alias("px_per_100um"), gb.alias("memory_gb"))


def named_channels(channels: DataFrame, bare: Column) -> DataFrame:
    """Channels of which the names that say nothing (null, or ``bare``) are C and their number, from 1."""
    own = F.concat(F.lit("C"), (F.col("pos") + 1).cast("string"))
    return channels.withColumn("name", F.when(F.col("name").isNull() | bare, own).otherwise(F.col("name")))


def check_colours(channels: DataFrame, colours: DataFrame) -> DataFrame:
    """(slide, n, missing, coloured): whether ``colours`` (name, and what else) has all channels of a slide; one without goes uncoloured."""
    known = colours.select("name").distinct().withColumn("__known", F.lit(1))
    c = channels.join(known, "name", "left").groupBy("slide").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__known").isNull()).alias("missing"))
    return c.withColumn("coloured", F.col("missing") == 0)


def processor_for(is_rgb: Column, asked: Column, brightfield: str = "od", fluorescence: str = "channel") -> Column:
    """The processor of an image: one asked for by name, or its type's."""
    return F.coalesce(asked, F.when(is_rgb, brightfield).otherwise(fluorescence))


def image_type(is_rgb: Column) -> Column:
    return F.when(is_rgb, "brightfield").otherwise("fluorescence")


def common_size(levels: DataFrame) -> DataFrame:
    """Images shrunk to the smallest of their largest sides, level by level: most, new_w and new_h."""
    side = F.greatest("w", "h")
    least = levels.groupBy("level").agg(F.min(side).alias("most"))
    new = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * F.col("most").cast("double") / side).cast("int"))
    return levels.join(least, "level").select("slide", "level", "w", "h", "most", new("w").alias("new_w"), new("h").alias("new_h"))


def crop_box(crop: Column, w: Column, h: Column, overlap_part: float = 0.8, all_part: float = 1.25) -> Column:
    """struct(x, y, w, h) of the part of the registered frame that a crop policy keeps: 'reference' the reference's own frame, 'overlap' the
    middle that all slides share, 'all' a frame that holds all; whole pixels, sizes rounded up."""
    pick = lambda a, b, c: F.when(crop == "reference", a).when(crop == "overlap", b).otherwise(c).cast("int")
    edge = (1 - overlap_part) / 2
    part = lambda v, k: F.ceil(F.round(v * k, 9))
    corner = lambda v: pick(F.lit(0), F.floor(F.round(v * edge, 9)), F.lit(0))
    return F.struct(corner(w).alias("x"), corner(h).alias("y"), pick(w, part(w, overlap_part), part(w, all_part)).alias("w"), pick(h, part(h, overlap_part), part(h, all_part)).alias("h"))


def aligned_size(reg_w: Column, reg_h: Column, fit_w: Column, fit_h: Column, level_w: Column, level_h: Column) -> Column:
    """struct(w, h) of the registered frame at a level: as much larger as the level is than the image of the fit, rounded up."""
    return F.struct(F.ceil(F.round(reg_w * level_w / fit_w, 9)).alias("w"), F.ceil(F.round(reg_h * level_h / fit_h, 9)).alias("h"))


def uncropped(points: DataFrame, boxes: DataFrame, key: str = "slide") -> DataFrame:
    """Points, or pixels, of a crop in the whole frame. ``boxes`` (key, x, y) are the crops' corners."""
    j = points.join(boxes.select(key, F.col("x").alias("__x"), F.col("y").alias("__y")), key)
    place = {c: F.col(c) + F.col(f"__{c}") for c in "xy"}
    return j.select(*[place.get(c, F.col(c)).alias(c) for c in points.columns])


def tortuosity(lines: DataFrame, window: int = 4, key: str = "slide") -> DataFrame:
    """(key, tortuosity): how much longer a line (key, k, x, y) is than the chords of its windows of ``window`` vertices."""
    v = lines.withColumn("__win", F.floor(F.col("k") / window))
    w = Window.partitionBy(key, "__win").orderBy("k")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    g = v.withColumn("__step", step).groupBy(key, "__win").agg(F.sum("__step").alias("len"), F.min_by(F.struct("x", "y"), "k").alias("p"), F.max_by(F.struct("x", "y"), "k").alias("q"))
    chord = F.sqrt(F.pow(F.col("q.x") - F.col("p.x"), 2) + F.pow(F.col("q.y") - F.col("p.y"), 2))
    return g.groupBy(key).agg(((F.count(F.lit(1)) - 1) / F.sum("len") * F.sum(F.col("len") / chord - 1)).alias("tortuosity"))


def split_line(lines: DataFrame, step: float, key: str = "line") -> DataFrame:
    """(key, n, x, y): places every ``step`` along lines (key, k, x, y), from the first vertex on; those that close end where they begin."""
    w = Window.partitionBy(key).orderBy("k")
    s = lines.select(key, "k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 IS NOT NULL")
    s = s.withColumn("len", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))
    s = s.withColumn("from", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).where("len > 0")
    first, last = F.ceil(F.round(F.col("from") / step, 9)), F.ceil(F.round((F.col("from") + F.col("len")) / step, 9)) - 1
    s = s.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("n"))
    t = (F.col("n") * step - F.col("from")) / F.col("len")
    return s.select(key, F.col("n").cast("int").alias("n"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def overlapping_polygons(polygons: DataFrame, cell: float = 256.0) -> DataFrame:
    """(slide, a, b, area, corners): pairs of a slide's convex polygons (slide, id, corners) that overlap, and the polygon that they share.

    Polygons meet in the cells of a grid that their boxes cover; a kernel cuts one by the other, each pair once.
    """
    ends = [f(F.col("corners")[c]).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))]
    b = polygons.select("slide", "id", "corners", *ends)
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"lo{c}") / cell), F.floor(F.col(f"hi{c}") / cell)))
    cells = b.select("*", span("x").alias("cx")).select("*", span("y").alias("cy"))
    near = F.expr("p.slide = q.slide AND p.cx = q.cx AND p.cy = q.cy AND p.id < q.id AND p.lox < q.hix AND q.lox < p.hix AND p.loy < q.hiy AND q.loy < p.hiy")
    pairs = cells.alias("p").join(cells.alias("q"), near).select("p.slide", F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    one, two = (polygons.select("slide", F.col("id").alias(k), F.col("corners").alias(f"c{k}")) for k in "ab")

    def run(batches):  # noqa: ANN001, ANN202
        for t in batches:
            rows = []
            for slide, a, b_, p, q in zip(t["slide"], t["a"], t["b"], t["ca"], t["cb"], strict=True):
                flat = lambda c: np.array([[v["x"], v["y"]] for v in c])
                part = clip_convex(flat(p), flat(q))
                if len(part) > 2:
                    x, y = part[:, 0], part[:, 1]
                    area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2
                    if area > 1e-12:
                        rows.append((slide, a, b_, area, [{"x": float(u), "y": float(v)} for u, v in part]))
            yield pd.DataFrame(rows, columns=["slide", "a", "b", "area", "corners"])

    kinds = {c: polygons.schema[c].dataType.simpleString() for c in ("slide", "id")}
    return pairs.join(one, ["slide", "a"]).join(two, ["slide", "b"]).select("slide", "a", "b", "ca", "cb").mapInPandas(run, f"slide {kinds['slide']}, a {kinds['id']}, b {kinds['id']}, area double, corners array<struct<x: double, y: double>>")


def level_for(levels: DataFrame, max_dim: int) -> DataFrame:
    """(slide, level): the first level of which the larger side is at most ``max_dim``, or the last."""
    fits = F.greatest("w", "h") <= max_dim
    return levels.groupBy("slide").agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("level")).alias("level"))


def output_tile_side(side: Column, default: int = 512) -> Column:
    """A multiple of 16: the default, or for a smaller image the power of two that hangs over least, the
    largest of equals."""
    powers = F.transform(F.sequence(F.lit(4), F.lit(default.bit_length() - 1)), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    over = F.array_min(F.transform(powers, lambda p: F.struct((F.ceil(side / p) * p - side).alias("over"), (-p).alias("back"))))
    return F.when(side >= default, F.lit(default)).otherwise(-over["back"])


def merged_channels(channels: DataFrame) -> DataFrame:
    """(place, slide, name): channels of all slides in stack order, each name from the first slide that has it. They make up one
    image, so the list of its channels is a row, put in order as a whole."""
    first = channels.groupBy("name").agg(F.min(F.struct("stack_idx", "pos", "slide")).alias("at"))
    listed = first.agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("all"))
    return listed.select(F.posexplode("all").alias("place", "c")).select("place", F.col("c.at.slide").alias("slide"), F.col("c.name").alias("name"))


def merge_tiles(tiles: DataFrame, channels: DataFrame, dtype: str) -> DataFrame:
    """Tiles of one image named 'merged' of the channels of all slides, in the order of ``merged_channels``; tiles of a place meet in a task."""
    places = merged_channels(channels).join(channels.select("slide", "name", "pos"), ["slide", "name"]).groupBy("slide", "place").agg(F.min("pos").alias("pos"))
    n = places.count()
    own = places.groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("place", "pos"))).alias("use"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        rows = t.to_dict("records")
        h, w = max(r["h"] for r in rows), max(r["w"] for r in rows)
        out = np.zeros((h, w, n))
        for r in rows:
            img = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"])
            for u in r["use"]:
                out[: r["h"], : r["w"], u["place"]] = img[..., u["pos"]]
        r = rows[0]
        return pd.DataFrame({"slide": ["merged"], "tx": r["tx"], "ty": r["ty"], "x0": r["x0"], "y0": r["y0"], "w": w, "h": h, "bands": n, "dtype": dtype, "data": cast(out, dtype).tobytes()})

    j = tiles.join(own, "slide")
    return j.groupBy("tx", "ty").applyInPandas(run, "slide string, tx int, ty int, x0 int, y0 int, w int, h int, bands int, dtype string, data binary")


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with place, their number from 0 in an order: each range of the order is numbered by its own task, from where
    the ranges before it end, so no task sees all rows."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    n = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = n.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a task
    return dealt.join(F.broadcast(starts), "__part").withColumn("place", F.col("__id") - F.col("__first") + F.col("__before")).drop("__part", "__id", "__first", "__before")


def pyramid_levels(pages: DataFrame) -> DataFrame:
    """(slide, level, w, h, pages): levels of pages in order; a new one begins where the area changes."""
    w = Window.partitionBy("slide").orderBy("page")
    area = F.col("w") * F.col("h")
    p = pages.withColumn("new", (area != F.lag(area).over(w)).cast("int"))
    p = p.withColumn("level", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("slide", "level").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.count(F.lit(1)).alias("pages"))


def staining_rounds(files: DataFrame) -> DataFrame:
    """(dir, master): folders that are one slide of many files, as one extension occurs once among several."""
    by = files.groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    d = by.groupBy("dir").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct("n", "ext", "file")).alias("rarest"))
    return d.where("kinds > 1 AND rarest.n = 1").select("dir", F.col("rarest.file").alias("master"))


def reader_for(ext: Column, is_ome: Column) -> Column:
    """The reader of a file, by what its name says."""
    # Extensions by reader.
    openslide = ["svs", "ndpi", "mrxs", "scn", "vms", "bif"]
    return (
        F.when(ext.isin("png", "jpg", "jpeg", "bmp"), "image").when(ext.isin(openslide), "openslide").when(ext == "czi", "czi").when(ext.isin("tif", "tiff") & is_ome, "ome_tiff").when(ext.isin("tif", "tiff"), "tiff").when(ext.isin("npy", "tile"), "tile")
    )


def stitch(tiles: DataFrame) -> DataFrame:
    """(image, x, y, v): overlapping tiles as one image, each pixel weighted by its distance from its tile's edge.

    ``tiles`` has (image, tile, tx, ty, tw, th, x, y, v) with the tile's box and pixels in the image's frame.
    """
    edge = lambda p, t, s: F.least(F.col(p) - F.col(t), F.col(t) + F.col(s) - 1 - F.col(p)) + 1
    w = F.least(edge("x", "tx", "tw"), edge("y", "ty", "th"))
    return tiles.groupBy("image", "x", "y").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))
