"""Raster stacks in NPZ files, as pixels and as frames.

Files are listed and read by Spark (``binaryFile``), so any store that Spark
reaches will do; a listing has each file once, so nothing is shuffled. One task
decodes a file, as its arrays are compressed whole; a crop is cut before pixels
are made, and metadata read only the arrays' headers. Pickled arrays are refused. Convert once with :func:`bandloom.sources.tables.write_pixels`
where frames are read more than once: Parquet prunes columns, frames and crops.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import warnings
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.calibration import complete

#: Names of the counts, the first that a file has; a file with both ``bands`` and ``stack`` gives its bands.
KEYS = ("bands", "stack", "data", "cube")
PIXELS = "frame_id string, path string, y int, x int, dn array<double>, edn array<double>"
FRAMES = (
    "frame_id string, path string, height int, width int, n_bands int, wavelengths array<int>, ts_utc string, bucket_12s string, "
    "fits_files array<string>, exptime array<double>, dtype string, quant_meta_json string, has_calibration boolean"
)


def listing(spark: SparkSession, directory: str, pattern: str = "*.npz", recursive: bool = False) -> DataFrame:
    """path, length and modificationTime of each matching file once, by path; empty where the folder isn't there."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return reader.load(directory) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")


def shape_of(content: bytes, key: str) -> tuple[tuple[int, ...], str]:
    """Shape and dtype of an array in an NPZ, from its header alone."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(f"{key}.npy") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = read(f)
        return shape, str(dtype)


def frame_shape(shape: tuple[int, ...], nf: int = 6) -> tuple[int, int, int]:
    """Frames, height and width of an array of this shape; a ValueError for other ranks or numbers of bands."""
    kind = layouts(shape, nf)
    if kind is None:
        raise ValueError(f"no axis of {shape} has {nf} bands, or its rank isn't 2 to 4")
    if kind == "NC":
        return 1, shape[0], 1
    n, rest = (shape[0], shape[1:]) if "F" in kind else (1, shape)
    return (n, *rest[1:]) if kind.endswith("CHW") else (n, *rest[:2])


def layouts(shape: tuple[int, ...], nf: int) -> str | None:
    """Which of the axes hold bands: ``CHW``, ``HWC``, ``FCHW``, ``FHWC``, ``NC`` (pixels by bands), or None."""
    if len(shape) == 2:
        return "NC" if shape[1] == nf else None
    if len(shape) == 3:
        return "CHW" if shape[0] == nf else "HWC" if shape[2] == nf else None
    if len(shape) == 4:
        return "FCHW" if shape[1] == nf else "FHWC" if shape[3] == nf else None
    return None


def to_frames(array: np.ndarray, nf: int = 6) -> np.ndarray:
    """Frames by height by width by bands; a ValueError for other ranks or numbers of bands."""
    frame_shape(array.shape, nf)
    kind = layouts(array.shape, nf)
    if kind == "NC":
        return array[None, :, None, :]
    if "F" not in kind:
        array = array[None]
    return np.moveaxis(array, 1, -1) if kind.endswith("CHW") else array


def pick(npz: np.lib.npyio.NpzFile, key: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Counts and uncertainties: ``dn`` and ``edn`` where a file has them, else the key or the first known one, else the first arrays."""
    if key:
        return npz[key], None
    if "dn" in npz.files:
        return npz["dn"], npz["edn"] if "edn" in npz.files else None
    for k in KEYS:
        if k in npz.files:
            return npz[k], None
    arrays = [npz[k] for k in npz.files if npz[k].ndim >= 2]
    if not arrays:
        raise ValueError("no array of rank 2 or more")
    return arrays[0], arrays[1] if len(arrays) > 1 and arrays[1].shape in (arrays[0].shape, (1, *arrays[0].shape[1:])) else None


def stack_key(names: list[str], raw: bytes) -> str:
    """The key of the counts, as :func:`pick` finds them, without decoding."""
    for k in ("dn", *KEYS):
        if k in names:
            return k
    found = next((k for k in names if len(shape_of(raw, k)[0]) >= 2), None)
    if found is None:
        raise ValueError("no array of rank 2 or more")
    return found


#: Fixed names of a calibration's parts: responses (samples by bands), their log T, and bin edges in Kelvin.
CALIBRATION = {"tresp": ("tresp", "T_RESP"), "tresp_logt": ("tresp_logt", "logt", "T_RESP_LOGT"), "temps": ("temps", "TEMPS")}


def read_calibration(spark: SparkSession, *places: str, nf: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses, log T and edges from the first of the places (NPZ files, or folders of NPY files) that has each; the rest is made.

    A calibration has some kilobytes; only its arrays are decoded, on the driver.
    """
    found: dict[str, np.ndarray] = {}
    for place in places:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(place).select("path", "content")
        for path, content in sorted(rows.filter(F.length("content") > 0).collect()):
            if path.endswith(".npy"):
                arrays = {path.rsplit("/", 1)[-1].removesuffix(".npy"): content}
                get = lambda k, arrays=arrays: np.load(io.BytesIO(arrays[k]), allow_pickle=False) if k in arrays else None
            else:
                npz = np.load(io.BytesIO(content), allow_pickle=False)
                get = lambda k, npz=npz: npz[k] if k in npz.files else None
            for part, names in CALIBRATION.items():
                value = next((v for v in map(get, names) if v is not None), None)
                if value is not None:
                    found.setdefault(part, value)
    return complete(*(found.get(k) for k in CALIBRATION), nf=nf)


def write_stacks(px: DataFrame, directory: str, nf: int = 6, dtype: str = "float64", compressed: bool = True) -> DataFrame:
    """frame_id, path and written: an NPZ of bands by height by width for each frame, unless its file is there already.

    One task writes a frame, from Arrow values into one array of its shape, which it tells by the frame's largest y and x;
    a file appears under its name only when it is complete, so a task that is run again does no harm. Without compression
    :mod:`bandloom.sources.stacks` reads a file in parts. ``directory`` is a folder that all executors share, as a path or a URI.
    """
    one = Window.partitionBy("frame_id")
    rows = px.select(F.col("frame_id").cast("string").alias("frame_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("dn", F.array_repeat(F.lit(0.0), nf)).cast("array<double>").alias("dn"))
    rows = rows.select("*", (F.max("y").over(one) + 1).alias("height"), (F.max("x").over(one) + 1).alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory.removeprefix('file:')}")
        store.create_dir(root, recursive=True)
        name, cube = None, None

        def finished() -> Iterator[pa.RecordBatch]:
            if name is None:
                return
            target = f"{root}/{name}.npz"
            if cube is not None:
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    (np.savez_compressed if compressed else np.savez)(out, bands=cube)
                store.move(part, target)
            yield pa.RecordBatch.from_pydict({"frame_id": [name], "path": [target], "written": [cube is not None]})

        for b in batches:
            names, starts = runs(b.column(0))
            for own, lo, hi in zip(names, starts, [*starts[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if own != name:
                    yield from finished()
                    there = store.get_file_info(f"{root}/{own}.npz").type != fs.FileType.NotFound
                    name, cube = own, None if there else np.zeros((nf, part.column(4)[0].as_py(), part.column(5)[0].as_py()), dtype)
                if cube is not None:
                    y, x = (part.column(i).to_numpy() for i in (1, 2))
                    cube[:, y, x] = part.column(3).flatten().to_numpy().reshape(-1, nf).T
        yield from finished()

    return rows.mapInArrow(run, "frame_id string, path string, written boolean")


def runs(column: pa.Array) -> tuple[list[str], list[int]]:
    """Values that stand together, and where each begins."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy()
    starts = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
    return [coded.dictionary[int(codes[k])].as_py() for k in starts], starts


def write_files(rows: DataFrame, directory: str) -> DataFrame:
    """path and length of a file for each row (name, content) below ``directory``, a folder that all executors share; tasks write their own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..runtime import put

        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, content in zip(names, b.column(1), strict=True):
                raw = content.as_py() or b""
                put(f"{directory}/{name}", raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_pydict({"path": [f"{directory}/{x}" for x in names], "length": sizes}, schema=pa.schema([("path", pa.string()), ("length", pa.int64())]))

    return rows.select("name", "content").mapInArrow(run, "path string, length long")


def write_archives(rows: DataFrame, directory: str) -> DataFrame:
    """archive and members: a ZIP for each archive of rows (archive, name, content), its members in the order of their names. An archive's members meet in one task, as the file does."""

    def run(table: pa.Table) -> pa.Table:
        from ..runtime import put

        name, held = table["archive"][0].as_py(), io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            warnings.simplefilter("ignore")  # names may come twice
            for member, content in sorted(zip(table["name"].to_pylist(), table["content"].to_pylist(), strict=True)):
                z.writestr(member, content)
        put(f"{directory}/{name}", held.getvalue())
        return pa.table({"archive": [name], "members": pa.array([table.num_rows], pa.int64())})

    return rows.select("archive", "name", "content").groupBy("archive").applyInArrow(run, "archive string, members long")


def flat_members(z: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """NPZ files of an archive by their names without folders; the first of a name is kept."""
    found: dict[str, zipfile.ZipInfo] = {}
    for x in z.infolist():
        if x.filename.endswith(".npz"):
            found.setdefault(x.filename.rpartition("/")[2], x)
    return found


def unpack(spark: SparkSession, archives: str, directory: str, sha256: str | None = None, pattern: str = "*.zip") -> DataFrame:
    """name and length of every NPZ in the archives, written flat to ``directory``, a folder that all executors share.

    ``sha256``: what the archives' digest must be, in either case; another one is an error and nothing is written. Folders
    within an archive are dropped from names, of which the first in an archive is kept; a name that two archives have is an
    error too, found before anything is written. One task unpacks an archive, member by member.
    """
    files = listing(spark, archives, pattern).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64())])

    def members(write: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ..runtime import put

            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = content.as_py()
                    if sha256 and hashlib.sha256(raw).hexdigest() != sha256.lower():
                        raise ValueError(f"{path} has another digest")
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        found = flat_members(z)
                        for name, x in found.items():
                            if write:
                                put(f"{directory}/{name}", z.read(x))
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "name": list(found), "length": [x.file_size for x in found.values()]}, schema=schema)

        return files.mapInArrow(run, "path string, name string, length long")

    twice = members(False).groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two archives have a {twice[0]['name']}")
    return members(True).select("name", "length")


def write_calibrations(taken: DataFrame, directory: str) -> DataFrame:
    """name and path: an NPZ of responses (samples by bands) and their log T for each name of samples (name, i, band, logt, value)."""

    def run(table: pa.Table) -> pa.Table:
        from ..runtime import put

        name = table["name"][0].as_py()
        i, band = table["i"].to_numpy(), table["band"].to_numpy()
        tresp, logt = np.zeros((i.max() + 1, band.max() + 1)), np.zeros(i.max() + 1)
        tresp[i, band], logt[i] = table["value"].to_numpy(), table["logt"].to_numpy()
        held = io.BytesIO()
        np.savez(held, tresp=tresp, logt=logt)
        put(f"{directory}/{name}.npz", held.getvalue())
        return pa.table({"name": [name], "path": [f"{directory}/{name}.npz"]})

    return taken.select("name", "i", "band", "logt", "value").groupBy("name").applyInArrow(run, "name string, path string")


def read_calibrations(spark: SparkSession, directory: str, pattern: str = "*.npz") -> DataFrame:
    """name, i, band, logt and value of the responses of all calibrations of a folder, each decoded by the task that has its file; one without responses and their log T is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as npz:
                    part = lambda kind: next((npz[k] for k in CALIBRATION[kind] if k in npz.files), None)  # noqa: E731, B023
                    tresp, logt = part("tresp"), part("tresp_logt")
                if tresp is None or logt is None:
                    raise ValueError(f"{path} lacks responses or their log T")
                n, nf = tresp.shape
                at = np.repeat(np.arange(n, dtype=np.int32), nf)
                yield pa.RecordBatch.from_arrays([pa.array([stem(path)] * (n * nf)), pa.array(at), pa.array(np.tile(np.arange(nf, dtype=np.int32), n)), pa.array(np.asarray(logt, float)[at]), pa.array(np.ascontiguousarray(tresp, float).ravel())], names=["name", "i", "band", "logt", "value"])

    return listing(spark, directory, pattern).select("path", "content").mapInArrow(run, "name string, i int, band int, logt double, value double")


def cropped(raw: bytes, key: str, nf: int, crop: tuple[int, int]) -> np.ndarray | None:
    """The top left (h, w) of an array's frames, by bands last, decoded as a stream in which only that part is kept; None where its layout needs it whole."""
    shape, _ = shape_of(raw, key)
    kind = layouts(shape, nf)
    if kind in (None, "NC"):
        return None
    n, height, width = frame_shape(shape, nf)
    h, w = crop
    if h > height or w > width:
        raise ValueError(f"a crop of {crop} from {(height, width)}")
    with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open(f"{key}.npy") as f:
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
        _, by_column, dtype = read(f)
        if by_column or dtype.hasobject:
            return None
        first = kind.endswith("CHW")
        line = width * (1 if first else nf)
        out = np.empty((n, h, w, nf), dtype)
        for i in range(n):
            for band in range(nf if first else 1):
                held = np.frombuffer(_exactly(f, h * line * dtype.itemsize), dtype).reshape(h, width, -1)[:, :w]
                if first:
                    out[i, :, :, band] = held[:, :, 0]
                else:
                    out[i] = held
                left = (height - h) * line * dtype.itemsize
                while left and (i + 1 < n or band + 1 < (nf if first else 1)):
                    left -= len(_exactly(f, min(left, 1 << 20)))
    return out


def _exactly(f, n: int) -> bytes:
    parts = []
    while n:
        part = f.read(n)
        if not part:
            raise ValueError("an array ends early")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npz")


def read_pixels(spark: SparkSession, directory: str, *, pattern: str = "*.npz", array_key: str | None = None, nf: int = 6, crop: tuple[int, int] | None = None, tolerant: bool = False, unit_edn: bool = False) -> DataFrame:
    """A row for each pixel. ``crop``: the top left (h, w), cut out while decoding; more than a frame has is an error. ``tolerant``: skip files that can't be read.

    A file of several frames gives frame ids ``<name>#<n>``. An ``edn`` of one row holds for all pixels; without one it
    is null, or ones with ``unit_edn``.
    """
    files = listing(spark, directory, pattern).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    raw = content.as_py()
                    with np.load(io.BytesIO(raw), allow_pickle=False) as npz:
                        frames = cropped(raw, array_key or stack_key(npz.files, raw), nf, crop) if crop and not ("edn" in npz.files) else None
                        dn, edn = pick(npz, array_key) if frames is None else (frames, None)
                        frames = to_frames(dn, nf) if frames is None else frames
                        if edn is None and unit_edn:
                            edn = np.ones((1, nf))
                        errors = None if edn is None else np.broadcast_to(to_frames(edn, nf) if edn.shape == dn.shape else edn.reshape(-1, nf)[:1].reshape(1, 1, 1, nf), frames.shape)
                except (ValueError, KeyError, OSError):
                    if tolerant:
                        continue
                    raise
                for i, frame in enumerate(frames):
                    h, w = frame.shape[:2]
                    if crop:
                        if crop[0] > h or crop[1] > w:
                            raise ValueError(f"{path}: a crop of {crop} from {(h, w)}")
                        h, w = crop
                    name = stem(path) + (f"#{i}" if len(frames) > 1 else "")
                    step = max(1, 50_000 // max(w, 1))
                    for y in range(0, h, step):
                        part = frame[y : min(y + step, h), :w]
                        yield _pixels(name, path, y, part, None if errors is None else errors[i, y : min(y + step, h), :w])

    return files.mapInArrow(run, PIXELS)


def _pixels(name: str, path: str, y0: int, part: np.ndarray, errors: np.ndarray | None) -> pa.RecordBatch:
    h, w, nf = part.shape
    n = h * w
    offsets = pa.array(np.arange(0, n * nf + 1, nf, dtype=np.int32))
    lists = lambda a: pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a, np.float64).ravel()))
    y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
    edn = pa.nulls(n, pa.list_(pa.float64())) if errors is None else lists(errors)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([path] * n), pa.array(y + np.int32(y0)), pa.array(x), lists(part), edn], names=["frame_id", "path", "y", "x", "dn", "edn"])


def read_frames(spark: SparkSession, directory: str, *, pattern: str = "*.npz", nf: int = 6) -> DataFrame:
    """A row of metadata for each frame; what a file lacks is null. Of a file a task asks for its directory, headers and small arrays alone."""
    files = listing(spark, directory, pattern).select("path")
    schema = spark.createDataFrame([], FRAMES).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import stacks

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, at = stacks.at(path)
                with store.open_input_file(at) as f:
                    found = stacks.arrays(f)
                    n, height, width = stacks.chosen(found, None, nf)[0].frames(nf)
                    f.seek(0)
                    with np.load(f, allow_pickle=False) as npz:
                        get = lambda k: npz[k] if k in found else None  # noqa: E731, B023
                        text = lambda k: None if get(k) is None else str(get(k))  # noqa: E731, B023
                        many = lambda k, kind: None if get(k) is None else [kind(v) for v in np.ravel(get(k))]  # noqa: E731, B023
                        facts = {
                            "path": path, "height": height, "width": width, "n_bands": nf, "wavelengths": many("wavelengths", int), "ts_utc": text("ts_utc"), "bucket_12s": text("bucket_12s"),
                            "fits_files": many("fits_files", str), "exptime": many("exptime", float), "dtype": text("dtype"), "quant_meta_json": text("quant_meta_json"),
                            "has_calibration": all(any(k in found for k in names) for names in CALIBRATION.values()),
                        }
                rows += [{"frame_id": stem(path) + (f"#{i}" if n > 1 else ""), **facts} for i in range(n)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.mapInArrow(run, schema)


ARROW = pa.schema(
    [("frame_id", pa.string()), ("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("n_bands", pa.int32()), ("wavelengths", pa.list_(pa.int32())), ("ts_utc", pa.string()), ("bucket_12s", pa.string()), ("fits_files", pa.list_(pa.string())), ("exptime", pa.list_(pa.float64())), ("dtype", pa.string()), ("quant_meta_json", pa.string()), ("has_calibration", pa.bool_())]
)
QUANT = "bits int, strategy string, scale_per_band array<double>, offset_per_band array<double>"


def with_quantisation(frames: DataFrame) -> DataFrame:
    """Frames with ``quant``, the parsed quantisation."""
    return frames.withColumn("quant", F.from_json("quant_meta_json", QUANT))


def write_frame(path: str, bands: np.ndarray, **meta: object) -> None:
    """One compressed file of bands by height by width with its metadata, on the driver; arrays and strings only."""
    arrays = {"bands": bands}
    for k, v in meta.items():
        arrays[k] = np.asarray(json.dumps(v) if isinstance(v, dict) else v)
        if arrays[k].dtype == object:
            raise TypeError(f"{k} is no array")
    np.savez_compressed(path, **arrays)


def test_frame(size: int = 32, nf: int = 6, seed: int = 12345) -> np.ndarray:
    """Standard normal counts, most pixels of which are invalid."""
    return np.random.default_rng(seed).standard_normal((nf, size, size)).astype(np.float32)
