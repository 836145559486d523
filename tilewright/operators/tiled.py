"""Kernels over images of any size: an image is cut in tiles, each with a margin of its neighbours' pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Kernel = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def with_margin(pixels: DataFrame, tile: int, margin: int) -> DataFrame:
    """Rows with the tiles (tx, ty) that they are part of, as a pixel of the tile or of the margin around it."""
    first = lambda k: F.floor((F.col(k) - margin) / tile).cast("int")
    last = lambda k: F.floor((F.col(k) + margin) / tile).cast("int")
    out = pixels.withColumn("tx", F.explode(F.sequence(first("x"), last("x")))) if margin else pixels.withColumn("tx", first("x"))
    return out.withColumn("ty", F.explode(F.sequence(first("y"), last("y")))) if margin else out.withColumn("ty", first("y"))


def by_tile(pixels: DataFrame, values: list[str], kernel: Kernel, out: dict[str, str], tile: int = 512, margin: int = 0, key: str = "image", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(key, x, y, *out): what ``kernel`` makes of each image, pixel by pixel.

    The kernel gets arrays of the values, 0 where there is no pixel, and which pixels there are; it gives arrays of the
    same shape. Tiles come with ``margin`` pixels around, as far as the image goes, of which the results are cut off
    again, so a kernel that looks no further gives the same as on the whole image. A task holds a tile, and a batch of small ones.
    """
    x, y = xy
    src = with_margin(pixels.select(key, F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"), *[F.col(v).cast("double").alias(v) for v in values]), tile, margin)

    kinds = {c: to_arrow_type(StructType.fromDDL(f"v {k}")[0].dataType) for c, k in out.items()}

    def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The results of rows that make up whole tiles."""
        t = pa.Table.from_batches(parts)
        edges, _ = _groups(t)
        px, py, tx, ty, *vs = (t.column(c).to_numpy() for c in ("x", "y", "tx", "ty", *values))
        kept, done = [], {c: [] for c in out}
        for lo, hi in zip(edges, [*edges[1:], t.num_rows], strict=True):
            gx, gy = px[lo:hi], py[lo:hi]
            own = (gx // tile == tx[lo]) & (gy // tile == ty[lo])
            if not own.any():
                continue
            at = (gy - gy.min(), gx - gx.min())
            there = np.zeros((int(at[0].max()) + 1, int(at[1].max()) + 1), bool)
            there[at] = True
            arrays = {}
            for v, a in zip(values, vs, strict=True):
                arrays[v] = np.zeros(there.shape)
                arrays[v][at] = a[lo:hi]
            result, cells = kernel(arrays, there), (at[0][own], at[1][own])
            kept.append(lo + np.flatnonzero(own))
            for c in out:
                done[c].append(result[c][cells])
        if kept:
            kept = np.concatenate(kept)
            columns = {key: t.column(key).take(pa.array(kept)), x: pa.array(px[kept], pa.int32()), y: pa.array(py[kept], pa.int32())}
            yield from pa.table(columns | {c: pa.array(np.concatenate(a)).cast(kinds[c], safe=False) for c, a in done.items()}).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last tile, of which more may come
        for b in batches:
            if not b.num_rows:
                continue
            edges, first = _groups(b)
            if held and (edges[-1] or first != _groups(held[-1])[1]):
                # What is held ends within this batch, or before it.
                yield from made([*held, b.slice(0, edges[-1])] if edges[-1] else held)
                held = []
            elif edges[-1]:
                yield from made([b.slice(0, edges[-1])])
            held.append(b.slice(edges[-1]))
        if held:
            yield from made(held)

    schema = f"{key} {pixels.schema[key].dataType.simpleString()}, {x} int, {y} int, " + ", ".join(f"{c} {k}" for c, k in out.items())
    # Tiles follow each other in a partition, so that small ones share a batch.
    src = src.select(F.col(key), "tx", "ty", "x", "y", *values)
    return src.repartition(key, "tx", "ty").sortWithinPartitions(key, "tx", "ty").mapInArrow(run, schema)


def _groups(rows: pa.RecordBatch | pa.Table) -> tuple[list[int], tuple]:
    """Where tiles begin among rows sorted by them, and the first row's tile. The first three columns tell tiles apart."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for c in rows.columns[:3]:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change).tolist(), tuple(c[0].as_py() for c in rows.columns[:3])
