"""Byte-level BPE: encoding with a rank queue in a hierarchical bitmap, and decoding.

A pre-token's bytes form a doubly linked list. Each adjacent pair that has a
rank waits in the bucket of that rank, and a bitmap in words over the ranks,
under a summary with a bit for each word, tells which buckets are in use: find-first-set on each level gives the lowest rank. A bucket holds list
positions, lowest first; an entry whose pair has changed since is stale and
skipped. So a pre-token of n bytes takes on the order of n steps and pushes,
however long it is, where scanning for the lowest rank takes n squared.

A worker remembers the ids of short pre-tokens it has met, in bounded memory.

Edge cases: null is the empty text, no ids; repeated rows are each encoded; of
equal ranks the first place in the text merges first; a text of any length is
read whole, in memory of a small multiple of its longest pre-token beside its
ids; lone surrogates can't occur in Spark strings; other columns than id and
text aren't read, and decoding gives way to none: a column named like its result
is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .token_counts import texts_of

REMEMBERED, LONGEST = 700_000, 64
NONE = 1 << 62


class ByteBPE:
    """Encoder and decoder for a file of ranks: a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.words = [0] * ((max(self.tokens) >> 8) + 1)
        self.two = [self.ranks.get(bytes(divmod(i, 256))) for i in range(1 << 16)]
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.names = {i: str(i) for i in self.tokens}
        self.memory: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue: ``buckets`` has the waiting positions of each rank in use, lowest first; ``words`` has a bit for
        each such rank, 256 to a word, and ``top`` one for each word that isn't 0. It is empty again at the end, so
        one list of words serves all pre-tokens.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 2))  # of the part that starts at a position; its successor's start
        before = list(range(-1, n))
        waiting = [NONE] * (n + 1)  # the rank of the pair that starts at a position, to tell stale entries
        get, two, words = ranks.get, self.two, self.words
        buckets: dict[int, list[int]] = {}
        top = i = 0
        for pair in zip(piece, piece[1:], strict=False):
            rank = two[pair[0] << 8 | pair[1]]
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
            i += 1
        while top:
            a = (top & -top).bit_length() - 1  # find first set: the word, then the rank in it
            word = words[a]
            low = word & -word
            rank = (a << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[a] = word = word ^ low
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue
            mid = ends[i]
            end = ends[mid]
            ends[i] = end
            before[end] = i
            waiting[mid] = waiting[i] = NONE
            if end < n:
                rank = get(piece[i : ends[end]])
                if rank is not None:
                    waiting[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
            if i:
                i = before[i]
                rank = get(piece[i:end])
                if rank is None:
                    waiting[i] = NONE
                else:
                    waiting[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str) -> list[int]:
        memory, older = self.memory, self.older
        pieces = self.pattern.findall(text)
        parts = list(map(memory.get, pieces))
        for i in common.places(parts):
            piece = pieces[i]
            ids = memory.get(piece)
            if ids is None:
                ids = older.get(piece) or self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= LONGEST:
                    memory[piece] = ids
            parts[i] = ids
        if len(memory) > REMEMBERED:
            self.older, self.memory = memory, {}
        return list(chain.from_iterable(parts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_OWN: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """This worker's codec for the file."""
    common.hold(f"bpe {path}", _OWN.clear)
    if path not in _OWN:
        _OWN[path] = ByteBPE(path)
    return _OWN[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and token_ids, an array, for each row."""
    source = docs.select(docs[id_col], docs[text_col])

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(own.encode, texts), pa.list_(pa.int32()))], names=[id_col, "token_ids"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, token_ids array<int>")


def decode_ids(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids under ``out_col``; null ids give null. An id that the file lacks is an error."""
    names = [f for f in rows.schema if f.name.lower() != out_col.lower()]
    source = rows.select(*(rows[f"`{f.name}`"] for f in names))
    at = common.place_of(source.columns, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), f"`{out_col}` binary"]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, and decoded from the ids, without moving either."""
    source = docs.select(docs[id_col], docs[text_col])

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in texts_of(batches):
            count, said, back = [], [], []
            for text in texts:
                ids = own.encode(text)
                count.append(len(ids))
                said.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
