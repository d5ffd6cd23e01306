"""Best-fit packing of token sequences, online and in bounded space.

Documents are tokenized where they lie. Only their pieces' lengths are dealt
out, by a hash, and each task packs its share: a fixed number of open sequences
stands in a bitset keyed by free space, a piece goes to the fullest sequence
that still holds it, and when too many are open the fullest closes. Pieces
arrive in blocks of a fixed size, longest first, which brings the online rule
close to best-fit decreasing without holding more than a block. A task's memory
doesn't grow with its rows, and a lost task packs the same way again, as its
rows arrive in the order of their hash.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed each on their own; pieces of one length are placed in the order of their
rows' hashes, and of sequences with the same room the one opened last is taken;
a text of any length becomes pieces of at most the room; an empty table gives
an empty table; other columns than id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import REMEMBERED, encoder, texts_of


class OpenBins:
    """At most ``most`` open bins of ``room``, by their free space."""

    def __init__(self, room: int, most: int):
        self.room, self.most = room, most
        self.free: list[list[int]] = [[] for _ in range(room + 1)]
        self.bits = self.open = self.made = 0

    def _put(self, bin_: int, free: int) -> None:
        self.free[free].append(bin_)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        bin_ = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free = self.made, self.room
            self.made += 1
        if free > length:
            self._put(bin_, free - length)
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.room - free


def pieces(docs: DataFrame, path: str, room: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32. ``remembered``: pieces of text that a worker remembers, which changes time and memory alone."""
    source = docs.select(docs[id_col], docs[text_col])
    end = end_id.to_bytes(4, "little")

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, keep_ids=True, remembered=remembered)
        for part, texts in texts_of(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(own.pieces(texts)):
                ids = b"".join(found) + end
                n = len(ids) // 4
                first = n - (n - 1) // room * room
                for k, a in enumerate([0, *range(first, n, room)]):
                    b = first if k == 0 else a + room
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, room: int, length_col: str = "length", open_bins: int = 4096, block: int = 16384) -> DataFrame:
    """``rows`` with sequence_id and offset, in whose place columns of those names go. Lengths are from 1 to ``room``."""
    rows = rows.drop(*(c for c in rows.columns if c.lower() in ("sequence_id", "offset")))
    at = common.place_of(rows.columns, length_col)
    own = f"{common.free_prefix(rows.columns)}deal"
    deal = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(room, open_bins)

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes = whole.column(at).to_pylist()
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
            placed = [bins.place(sizes[i]) for i in order]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(order, pa.int64())) for c in whole.columns), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*whole.schema.names, "sequence_id", "offset"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= block:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    dealt = rows.withColumn(own, deal).repartition(own).sortWithinPartitions(own).drop(own)
    return dealt.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "sequence_id long", "offset long"]))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0), 2048)
