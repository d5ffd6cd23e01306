"""Raw frames in FITS files: their headers as a catalogue, and complete sets as pixels.

The format is read here: 2880-byte blocks, header cards of 80 characters, and
big-endian data of the first unit that has two axes or more. Compressed units
aren't read. Files are listed and read by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .npz import listing, runs

BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
CATALOGUE = "filepath string, timestamp_utc string, wavelength int, exptime double, naxis1 int, naxis2 int, filesize_bytes long, hash_md5 string"


def header(content: bytes, at: int = 0) -> tuple[dict[str, object], int]:
    """The cards of the unit at an offset, and where its data begin. A ValueError where there is no such unit."""
    cards: dict[str, object] = {}
    start = at
    while at + BLOCK <= len(content):
        block = content[at : at + BLOCK].decode("ascii", "replace")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD]
            key = card[:8].strip()
            if start == 0 and not cards and key != "SIMPLE":
                raise ValueError("not a FITS file")
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                cards.setdefault(key, value(card[10:]))
    raise ValueError("a header without an end")


def value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        end = text.find("'", 1)
        while end != -1 and text[end + 1 : end + 2] == "'":
            end = text.find("'", end + 2)
        return text[1 : end if end != -1 else None].replace("''", "'").rstrip()
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E") if kind is float else text)
        except ValueError:
            pass
    return text


def size_of(cards: dict[str, object]) -> int:
    axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
    return abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0


def image(content: bytes) -> tuple[dict[str, object], np.ndarray]:
    """The header and the scaled image of the first unit that has one."""
    at = 0
    first: dict[str, object] = {}
    while at < len(content):
        cards, data = header(content, at)
        first = first or cards
        n = size_of(cards)
        if int(cards.get("NAXIS", 0)) >= 2 and n and not cards.get("ZIMAGE"):
            shape = tuple(int(cards[f"NAXIS{i}"]) for i in range(int(cards["NAXIS"]), 0, -1))
            raw = np.frombuffer(content, KINDS[int(cards["BITPIX"])], int(np.prod(shape)), data).reshape(shape)
            return first | cards, raw * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
        at = data + -(-n // BLOCK) * BLOCK
    raise ValueError("no image")


def catalogue(spark: SparkSession, directory: str, pattern: str = "*.fits", tolerant: bool = True) -> DataFrame:
    """A manifest row for each file below the folder; files that can't be read are skipped, or else an error."""
    files = listing(spark, directory, pattern, recursive=True).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path, length, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = content.as_py()
                try:
                    cards, _ = image(raw)
                except (ValueError, KeyError):
                    if tolerant:
                        continue
                    raise
                time = cards.get("DATE-OBS") or cards.get("T_OBS") or cards.get("DATE_OBS")
                number = lambda k, f: None if cards.get(k) is None else f(cards[k])  # noqa: E731, B023
                rows.append({"filepath": path, "timestamp_utc": None if time is None else str(time), "wavelength": number("WAVELNTH", lambda v: int(float(v))), "exptime": number("EXPTIME", float), "naxis1": number("NAXIS1", int), "naxis2": number("NAXIS2", int), "filesize_bytes": length, "hash_md5": hashlib.md5(raw).hexdigest()})
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip([x.split()[0] for x in CATALOGUE.split(", ")], kinds, strict=True))))

    return files.mapInArrow(run, CATALOGUE).withColumn("timestamp_utc", F.try_to_timestamp("timestamp_utc"))


def pixels_of_sets(spark: SparkSession, directory: str, sets: DataFrame, bands: list[int], pattern: str = "*.fits", tolerant: bool = False) -> DataFrame:
    """frame_id, y, x, dn of complete sets (d8, bucket, ``w<band>`` paths), bands in the given order.

    A set's few files meet in one task and are cut to their smallest common shape; pixels leave it in batches. A set
    without one of its files is an error, or skipped with ``tolerant``.
    """
    wanted = sets.select(F.concat_ws("_", "d8", "bucket").alias("frame_id"), F.posexplode(F.array(*(f"w{w}" for w in bands))).alias("band", "path"))
    files = listing(spark, directory, pattern, recursive=True).select("path", "content")
    rows = wanted.join(files, "path", "left").select("frame_id", "band", "content").repartition("frame_id").sortWithinPartitions("frame_id", "band")
    nf = len(bands)

    def of(name: str, held: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        if len(held) != nf or any(c is None for c in held):
            if tolerant:
                return
            raise ValueError(f"set {name} lacks a file")
        images = [np.squeeze(image(c)[1]) for c in held]
        h, w = (min(i.shape[k] for i in images) for k in (0, 1))
        step = max(1, 50_000 // w)
        for y0 in range(0, h, step):
            part = np.stack([i[y0 : min(y0 + step, h), :w] for i in images], axis=-1).astype(np.float64)
            n = part.shape[0] * w
            y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * nf + 1, nf, dtype=np.int32)), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(y + np.int32(y0)), pa.array(x), lists], names=["frame_id", "y", "x", "dn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != name:
                    if held:
                        yield from of(name, held)
                    name, held = own, []
                held.append(content.as_py())
        if held:
            yield from of(name, held)

    return rows.mapInArrow(run, "frame_id string, y int, x int, dn array<double>")


def write_images(rows: DataFrame, directory: str, **cards: object) -> DataFrame:
    """path of a file for each name and wavelength of rows (name, wavelength, date_obs, y, x, value): ``<name>_<wavelength>.fits``, as large as its largest y and x, 0 where no row is.

    A task writes an image from Arrow values; names may have folders.
    """
    one = Window.partitionBy("name", "wavelength")
    held = rows.select("name", F.col("wavelength").cast("int").alias("wavelength"), "date_obs", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    held = held.select("*", (F.max("y").over(one) + 1).alias("height"), (F.max("x").over(one) + 1).alias("width"), F.concat_ws("_", "name", "wavelength").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..runtime import put

        name, image_, facts = None, None, {}

        def finished() -> Iterator[pa.RecordBatch]:
            if name is not None:
                put(f"{directory}/{name}.fits", encoded(image_, **facts, **cards))
                yield pa.RecordBatch.from_pydict({"path": [f"{directory}/{name}.fits"]})

        for b in batches:
            names, starts = runs(b.column("file"))
            for own, lo, hi in zip(names, starts, [*starts[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if own != name:
                    yield from finished()
                    first = part.slice(0, 1).to_pylist()[0]
                    name, image_, facts = own, np.zeros((first["height"], first["width"])), {"wavelnth": first["wavelength"], "date_obs": first["date_obs"]}
                image_[part.column("y").to_numpy(), part.column("x").to_numpy()] = part.column("value").to_numpy()
        yield from finished()

    return held.mapInArrow(run, "path string")


def encoded(data: np.ndarray, **cards: object) -> bytes:
    """A file of one unit of doubles."""
    lines = ["SIMPLE  =                    T", "BITPIX  =                  -64", f"NAXIS   = {data.ndim:20d}"]
    lines += [f"NAXIS{i + 1}  = {n:20d}" for i, n in enumerate(data.shape[::-1])]
    lines += [f"{k.replace('_obs', '-obs').upper():8}= {repr(v) if isinstance(v, str) else str(v).rjust(20)}" for k, v in cards.items()] + ["END"]
    head = "".join(x.ljust(CARD) for x in lines)
    raw = data.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode() + raw.ljust(-(-len(raw) // BLOCK) * BLOCK, b"\0")


def write(path: str, data: np.ndarray, **cards: object) -> None:
    """A file of one unit of doubles, on the driver; for tests and fixtures."""
    with open(path, "wb") as f:
        f.write(encoded(data, **cards))
