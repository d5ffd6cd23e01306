"""Raster stacks as a data source: ``spark.read.format("stacks").load(folder)``.

A file (NPZ, or NPY with one array) is read through its directory and its arrays' headers. Planning makes a task for each
range of rows of each frame that is wanted: files and rows outside the cut get no task, and a task asks the store for the
bytes of its own rows only. Arrays that are compressed have to be inflated from their start, so they get one task a file,
which stops after the last row it needs and keeps only what it needs.

A cut is given to :func:`read` (``frames``, ``y``, ``x``), or, with ``pushdown``, comes from the query's own filters on
``frame_id``, ``y`` and ``x``. Spark 4.1 holds one list of tasks for each load, and filters replace it, so a frame that was
loaded with ``pushdown`` stands for one scan: load again for another one, in the same query or after it. Without
``pushdown``, as by default, a frame can be used any number of times.

Options: ``pathGlobFilter`` (``*.npz`` without one), ``arrayKey``, ``bands`` (6), ``pixelsPerTask`` (1048576), ``unitEdn``
(uncertainties of one where a file has none; else they are null). An array of several frames gives the ids
``<name>#<n>``. Pickled arrays are refused.
"""

from __future__ import annotations

import fnmatch
import json
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .npz import KEYS, PIXELS, frame_shape, layouts

#: Pixels in one Arrow batch, and files whose headers are read at a time while planning.
BATCH, AT_ONCE = 50_000, 32


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npz").removesuffix(".npy")


@dataclass(frozen=True)
class Array:
    """An array in a file: its data begin at ``start``, or are inflated from ``member``."""

    member: str
    start: int | None
    skip: int
    shape: tuple[int, ...]
    by_column: bool
    dtype: str

    def frames(self, nf: int) -> tuple[int, int, int]:
        return frame_shape(self.shape, nf)


def header(f) -> tuple[int, tuple[int, ...], bool, np.dtype]:
    """Length of an array's header, its shape, whether columns come first, and its type."""
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError("pickled arrays aren't read")
    return f.tell(), shape, by_column, dtype


def arrays(source) -> dict[str, Array]:
    """The arrays of an open file, by name, from headers alone."""
    if source.read(6) == b"\x93NUMPY":
        source.seek(0)
        at, shape, by_column, dtype = header(source)
        return {"bands": Array("", at, 0, shape, by_column, dtype.str)}
    found = {}
    with zipfile.ZipFile(source) as z:
        for info in z.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with z.open(info) as f:
                try:
                    skip, shape, by_column, dtype = header(f)
                except ValueError:
                    continue
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                source.seek(info.header_offset)
                local = source.read(30)
                start = info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + skip
            found[info.filename.removesuffix(".npy")] = Array(info.filename, start, skip, shape, by_column, dtype.str)
    return found


def chosen(found: dict[str, Array], key: str | None, nf: int) -> tuple[Array, Array | None]:
    """Counts and uncertainties: ``dn`` and ``edn`` where a file has them, else the key or the first known one, else the first arrays."""
    if key:
        return found[key], None
    if "dn" in found:
        return found["dn"], found.get("edn")
    for k in KEYS:
        if k in found:
            return found[k], None
    some = [a for a in found.values() if len(a.shape) >= 2]
    if not some:
        raise ValueError("no array of rank 2 or more")
    same = len(some) > 1 and some[1].shape in (some[0].shape, (1, *some[0].shape[1:]))
    return some[0], some[1] if same else None


class Rows:
    """Reads ranges of rows of an array from an open file, going forward."""

    def __init__(self, source, array: Array, nf: int):
        self.source, self.a, self.nf = source, array, nf
        self.kind, self.dtype = layouts(array.shape, nf), np.dtype(array.dtype)
        self.stream, self.at = None, 0
        self.whole = None

    def bytes_at(self, offset: int, n: int) -> bytes:
        if self.a.start is not None:
            self.source.seek(self.a.start + offset)
            return exactly(self.source, n)
        if self.stream is None or offset < self.at:
            self.stream = zipfile.ZipFile(self.source).open(self.a.member)
            exactly(self.stream, self.a.skip)
            self.at = 0
        while self.at < offset:
            self.at += len(exactly(self.stream, min(offset - self.at, 1 << 20)))
        self.at += n
        return exactly(self.stream, n)

    def get(self, frame: int, y0: int, y1: int) -> np.ndarray:
        """Rows y0 to y1 of a frame, bands last."""
        n, height, width = self.a.frames(self.nf)
        size = self.dtype.itemsize
        if self.a.by_column:
            if self.whole is None:
                flat = np.frombuffer(self.bytes_at(0, int(np.prod(self.a.shape)) * size), self.dtype)
                self.whole = flat.reshape(self.a.shape[::-1]).T
            held = self.whole if "F" in self.kind or self.kind == "NC" else self.whole[None]
            if self.kind == "NC":
                return held[y0:y1, None, :]
            return np.moveaxis(held[frame], 0, -1)[y0:y1] if self.kind.endswith("CHW") else held[frame][y0:y1]
        if not self.kind.endswith("CHW"):
            line = width * self.nf
            return np.frombuffer(self.bytes_at((frame * height + y0) * line * size, (y1 - y0) * line * size), self.dtype).reshape(y1 - y0, width, self.nf)
        out = np.empty((y1 - y0, width, self.nf), self.dtype)
        for band in range(self.nf):
            at = ((frame * self.nf + band) * height + y0) * width * size
            out[:, :, band] = np.frombuffer(self.bytes_at(at, (y1 - y0) * width * size), self.dtype).reshape(y1 - y0, width)
        return out


def exactly(f, n: int) -> bytes:
    parts = []
    while n:
        part = f.read(n)
        if not part:
            raise ValueError("an array ends early")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


@dataclass(frozen=True)
class Wanted:
    """What filters leave: frames (None: all), rows and columns from and to."""

    frames: frozenset[str] | None = None
    y: tuple[int, int] = (0, 2**31)
    x: tuple[int, int] = (0, 2**31)

    def within(self, name: str, lo: float, hi: float) -> Wanted:
        a, b = getattr(self, name)
        return replace(self, **{name: (max(a, int(lo)), min(b, int(hi)))})

    def take(self, f: D.Filter) -> tuple[Wanted, bool]:
        """Narrowed by the filter, and whether it has done all that the filter asks."""
        name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
        column = name[0].lower() if len(name) == 1 and name[0] else None
        if isinstance(f, D.IsNotNull) and column in ("frame_id", "y", "x"):
            return self, True
        if column == "frame_id" and isinstance(f, (D.EqualTo, D.In)):
            ids = frozenset([value] if isinstance(f, D.EqualTo) else value)
            return replace(self, frames=ids if self.frames is None else self.frames & ids), True
        if column in ("y", "x") and isinstance(f, D.In):
            numbers = [v for v in value if v is not None]
            return (self.within(column, min(numbers), max(numbers) + 1) if numbers else self.within(column, 0, 0)), False
        bounds = {D.EqualTo: (0, 1), D.GreaterThan: (1, None), D.GreaterThanOrEqual: (0, None), D.LessThan: (None, 0), D.LessThanOrEqual: (None, 1)}
        if column in ("y", "x") and type(f) in bounds and isinstance(value, int):
            lo, hi = bounds[type(f)]
            return self.within(column, 0 if lo is None else value + lo, 2**31 if hi is None else value + hi), True
        return self, False


@dataclass
class Part(D.InputPartition):
    """Rows of frames of a file."""

    path: str
    dn: Array
    edn: Array | None
    frames: list[tuple[int, str]]
    y: tuple[int, int]
    x: tuple[int, int]


class StackReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.folder, self.pattern, self.key = given["path"], given.get("pathglobfilter", "*.npz"), given.get("arraykey")
        self.nf, self.unit = int(given.get("bands", 6)), given.get("unitedn", "false").lower() == "true"
        self.each = int(given.get("pixelspertask", 1 << 20))
        cut = json.loads(given.get("cut", "{}"))
        self.wanted = Wanted(frozenset(cut["frames"]) if cut.get("frames") is not None else None)
        for name in ("y", "x"):
            if cut.get(name):
                self.wanted = self.wanted.within(name, *cut[name])

    def files(self) -> list[str]:
        from pyarrow import fs

        store, root = at(self.folder)
        if store.get_file_info(root).type == fs.FileType.File:
            return [root]
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, self.pattern))

    def parts_of(self, path: str) -> list[Part]:
        with at(self.folder)[0].open_input_file(path) as f:
            dn, edn = chosen(arrays(f), self.key, self.nf)
        n, height, width = dn.frames(self.nf)
        (y0, y1), (x0, x1) = self.wanted.y, self.wanted.x
        y1, x1 = min(y1, height), min(x1, width)
        names = [(i, stem(path) + (f"#{i}" if n > 1 else "")) for i in range(n)]
        names = [x for x in names if self.wanted.frames is None or x[1] in self.wanted.frames]
        if y0 >= y1 or x0 >= x1 or not names:
            return []
        if dn.start is None or dn.by_column or (edn is not None and edn.start is None):
            return [Part(path, dn, edn, names, (y0, y1), (x0, x1))]
        step = max(1, self.each // width)
        return [Part(path, dn, edn, [x], (y, min(y + step, y1)), (x0, x1)) for x in names for y in range(y0, y1, step)]

    def partitions(self) -> list[D.InputPartition]:
        paths = self.files()
        if self.wanted.frames is not None:  # names tell which files can hold them
            stems = {x.rpartition("#")[0] or x for x in self.wanted.frames if x is not None} | {x for x in self.wanted.frames if x is not None}
            paths = [p for p in paths if stem(p) in stems]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [x for parts in pool.map(self.parts_of, paths) for x in parts] or [D.InputPartition(None)]

    def read(self, part: D.InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Part):
            return
        with at(self.folder)[0].open_input_file(part.path) as source:
            dn = Rows(source, part.dn, self.nf)
            errors = self.errors(source, part)
            for frame, name in part.frames:
                (y0, y1), (x0, x1) = part.y, part.x
                inflated = part.dn.start is None
                step = y1 - y0 if inflated else max(1, BATCH // max(1, part.dn.frames(self.nf)[2]))
                for y in range(y0, y1, step):
                    end = min(y + step, y1)
                    values, own = dn.get(frame, y, end)[:, x0:x1], errors(frame, y, end)
                    own = None if own is None else np.broadcast_to(own, (end - y, part.dn.frames(self.nf)[2], self.nf))[:, x0:x1]
                    lines = max(1, BATCH // max(1, x1 - x0))
                    for k in range(0, end - y, lines):
                        yield batch(name, part.path, y + k, x0, values[k : k + lines], None if own is None else own[k : k + lines])

    def errors(self, source, part: Part):
        """Uncertainties of rows of a frame: of the file's own array, its one row, ones, or None."""
        if part.edn is None:
            one = np.ones((1, 1, self.nf)) if self.unit else None
            return lambda frame, y0, y1: one
        if part.edn.shape == part.dn.shape:
            rows = Rows(source, part.edn, self.nf)
            return rows.get
        count = int(np.prod(part.edn.shape))
        raw = Rows(source, part.edn, self.nf).bytes_at(0, count * np.dtype(part.edn.dtype).itemsize)
        one = np.frombuffer(raw, part.edn.dtype).reshape(-1, self.nf)[:1][None]
        return lambda frame, y0, y1: one


class PushingReader(StackReader):
    """Takes the cut from the query's filters too."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            self.wanted, done = self.wanted.take(f)
            if not done:
                yield f


def at(folder: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def batch(name: str, path: str, y0: int, x0: int, values: np.ndarray, errors: np.ndarray | None) -> pa.RecordBatch:
    h, w, nf = values.shape
    n = h * w
    offsets = pa.array(np.arange(0, n * nf + 1, nf, dtype=np.int32))
    lists = lambda a: pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a, np.float64).ravel()))
    y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(max(w, 1)))
    same = lambda v: pa.repeat(pa.scalar(v), n)
    edn = pa.nulls(n, pa.list_(pa.float64())) if errors is None else lists(errors)
    return pa.RecordBatch.from_arrays([same(name), same(path), pa.array(y + np.int32(y0)), pa.array(x + np.int32(x0)), lists(values), edn], names=["frame_id", "path", "y", "x", "dn", "edn"])


class StackSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "stacks"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> StackReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushing else StackReader)(dict(self.options))


def read(spark: SparkSession, folder: str, *, frames: list[str] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None, pushdown: bool = False, **options: object) -> DataFrame:
    """Pixels of the stacks of a folder: of ``frames`` (all without any), rows and columns from the first of ``y`` and ``x`` up to the last, exclusive.

    ``pushdown``: the query's filters cut too, for one scan of this frame; the session's setting that lets them stays on.
    """
    spark.dataSource.register(StackSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cut = json.dumps({"frames": frames, "y": y, "x": x})
    return spark.read.format("stacks").options(cut=cut, pushdown=str(pushdown).lower(), **{k: str(v) for k, v in options.items()}).load(folder)
