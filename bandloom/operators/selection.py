"""Which frames and pixels take part: selectors, crops, subsamples, tiles, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import finite


def parse_size(text: str) -> tuple[int, int]:
    """``N`` or ``NxM``; anything else is a ValueError."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:[xX]\s*(\d+)\s*)?", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]), int(m[2] or m[1])


def parse_sizes(text: str) -> list[tuple[int, int]]:
    return [parse_size(x) for x in text.split(",") if x.strip()]


def parse_index(text: str) -> int | None:
    """None, all frames, for ``all`` and ``-1``; else the number."""
    return None if text.strip().lower() in ("all", "-1") else int(text)


def numbered(frames: DataFrame, order: str = "frame_id") -> DataFrame:
    """Frames (one row each, far fewer than pixels) with frame_idx from 0 in the order of the column."""
    return frames.withColumn("frame_idx", F.row_number().over(Window.orderBy(order)) - 1)


def select_frames(frames: DataFrame, index: int | slice | list[int] | None, n: int) -> DataFrame:
    """Rows by frame_idx of ``n`` frames: None or -1 is all, other negatives count from the end, out of range is an error."""
    if index is None or index == -1:
        return frames
    if isinstance(index, slice):
        wanted = list(range(*index.indices(n)))
    else:
        wanted = [i + n if i < 0 else i for i in ([index] if isinstance(index, int) else index)]
        if any(not 0 <= i < n for i in wanted):
            raise IndexError(f"frame index {index} of {n} frames")
    return frames.filter(F.col("frame_idx").isin(wanted))


def crop_top_left(px: DataFrame, h: int, w: int) -> DataFrame:
    """A comparison of keys, which reaches the scan."""
    return px.filter((F.col("y") < h) & (F.col("x") < w))


def crop_centre(px: DataFrame, height: int, width: int, size: int) -> DataFrame:
    y0, x0 = (height - size) // 2, (width - size) // 2
    return px.filter(F.col("y").between(y0, y0 + size - 1) & F.col("x").between(x0, x0 + size - 1))


def evenly_spaced(rows: DataFrame, index: str, n: int | None, most: int) -> DataFrame:
    """``most`` of ``n`` rows by an index from 0, evenly spaced with both ends; all of them where there are no more.

    Without ``n`` the rows are counted in the same plan, as one row that is broadcast.
    """
    names = rows.columns
    if n is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all"))))
    count = F.lit(n) if n is not None else F.col("__all")
    if most == 1:
        return rows.filter((F.col(index) == 0) | (count <= most)).select(names)
    # i is picked if some k has floor(k * (n - 1) / (most - 1)) = i
    i, a, b = F.col(index), count - 1, most - 1
    k = F.ceil(F.try_divide(i * b, a)).cast("long")
    return rows.filter((count <= most) | (k < most) & (F.floor(k * a / b) == i)).select(names)


def indexed(px: DataFrame, index: str = "index") -> DataFrame:
    """``px`` with the number of each pixel from 0, by frame, row and column. Lines are numbered within frames and frames by their counts, so no task orders all pixels."""
    lines = px.groupBy("frame_id", "y").agg(F.count("*").alias("__line"))
    frames = lines.groupBy("frame_id").agg(F.sum("__line").alias("__frame"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frames = frames.select("frame_id", before("__frame", Window.orderBy("frame_id")).alias("__frames"))  # a row for each frame
    lines = lines.select("frame_id", "y", before("__line", Window.partitionBy("frame_id").orderBy("y")).alias("__lines")).join(frames, "frame_id")
    place = F.row_number().over(Window.partitionBy("frame_id", "y").orderBy("x")) - 1
    return px.withColumn("__place", place).join(lines, ["frame_id", "y"]).select(*px.columns, (F.col("__frames") + F.col("__lines") + F.col("__place")).alias(index))


def tiled(px: DataFrame, th: int, tw: int) -> DataFrame:
    return px.withColumn("tile_y", F.floor(F.col("y") / th).cast("int")).withColumn("tile_x", F.floor(F.col("x") / tw).cast("int"))


def by_tile(px: DataFrame, th: int, tw: int, partitions: int | None = None) -> DataFrame:
    """Pixels dealt out by frame and tile."""
    keys = ["frame_id", "tile_y", "tile_x"]
    return tiled(px, th, tw).repartition(*([partitions] if partitions else []), *keys)


def has_bands(dn: Column, nf: int = 6) -> Column:
    """The array, or an error where it hasn't ``nf`` values."""
    return F.when(F.size(dn) == nf, dn).otherwise(F.raise_error(F.concat(F.lit(f"expected {nf} bands, got "), F.size(dn).cast("string"))))


def frame_shapes(px: DataFrame) -> DataFrame:
    """frame_id, height, width, n of each frame."""
    return px.groupBy("frame_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("n"))


def check_one_shape(px: DataFrame) -> tuple[int, int]:
    """The shape that all frames share; a ValueError where they differ."""
    shapes = frame_shapes(px).select("height", "width").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("frames differ in shape" if shapes else "no frames")
    return shapes[0]["height"], shapes[0]["width"]


def input_checks(px: DataFrame, nf: int = 6, dn: str = "dn") -> DataFrame:
    """One row of counts: pixels, values that aren't finite and negative ones (both become 0), pixels of zeros, and pixels with another number of bands."""
    v = F.col(dn)
    count = lambda f: F.coalesce(F.sum(F.size(F.filter(v, f))), F.lit(0)).cast("long")
    return px.agg(
        F.count("*").alias("n_pixels"),
        count(lambda x: ~finite(x)).alias("n_not_finite"),
        count(lambda x: finite(x) & (x < 0)).alias("n_negative"),
        F.count_if(F.forall(v, lambda x: x == 0)).alias("n_all_zero"),
        F.count_if(F.coalesce(F.size(v) != nf, F.lit(True))).alias("n_other_bands"),
    )


def check_inputs(px: DataFrame, nf: int = 6, dn: str = "dn") -> list[str]:
    """What is wrong with the values, as warnings. Pixels with another number of bands, or no pixel above 0, are a ValueError."""
    x = input_checks(px, nf, dn).first()
    if x["n_other_bands"]:
        raise ValueError(f"{x['n_other_bands']} pixels don't have {nf} bands")
    if x["n_pixels"] and x["n_all_zero"] == x["n_pixels"]:
        raise ValueError("all counts are 0")
    said = {"n_not_finite": "values aren't finite and become 0", "n_negative": "values are negative and become 0", "n_all_zero": "pixels are 0 in all bands"}
    return [f"{x[k]} {text}" for k, text in said.items() if x[k]]
