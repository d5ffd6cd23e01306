"""Token counts by a public tokenizer file.

Texts reach the tokenizer in Arrow batches and only lengths come back. Before
that each text is split at safe boundaries, places that no token of a
byte-level BPE with the usual split pattern can cross: before a single space
that a non-space follows, and around other runs of white space. So a text of
any length becomes short pieces, pieces go to the tokenizer in batches of about
equal bytes, and a piece that a worker has met before isn't encoded again. The
memory of pieces is bounded, in number and in bytes, and only saves time.

The library cuts a text at the strings of special tokens before it looks at
white space, so the text is parted there first and its parts are split on their
own. Files of other kinds (``.model``, or without the byte-level split) are
encoded in whole texts, as are those with special tokens that take in the white
space or look at the words beside them.

Edge cases: null is the empty text, 0 tokens; repeated rows are each counted
(there are no ties to break); a text of any length is cut into pieces, of which
only a run without white space stays whole; an empty table gives an empty table;
columns other than id and text aren't read, so their names can't clash, and an
id column named like a result has the result's column beside it, as it was asked.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from . import common

#: White space as the tokenizer libraries see it (Unicode White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed by the split pattern of byte-level BPE: no match of that crosses a match of this.
SAFE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
WHITE = re.compile(f"[{_WS}\\x00-\\x20]").match
#: Bytes of text in one call of the tokenizer, and in one text of joined pieces, and the longest piece remembered.
CALL_BYTES, LINE_BYTES, LONGEST = 1 << 18, 1 << 14, 48
#: From so many pieces on, or so many letters and bytes of ids for each of them, a worker begins a new memory, with the one before beside it.
#: A dict of more than 699,050 (or 349,525) doubles its table.
REMEMBERED, PIECE_BYTES = 660_000, 40


def by_bytes(texts: Iterable[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` bytes."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder:
    """Encodes whole texts with the file at ``path``. Keeps of a piece its ids, as little-endian unsigned 32-bit numbers, or else only their number."""

    def __init__(self, path: str, keep_ids: bool, remembered: int = REMEMBERED):
        self.keep_ids, self.remembered, self.memory, self.older, self.bytes = keep_ids, remembered, {}, {}, 0
        self.line_break = None
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.call = lambda texts: own.encode(texts, num_threads=1)
            self.safe, self.special = False, []
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.call = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        kind = str(own.pre_tokenizer)
        self.safe = own.normalizer is None and "ByteLevel" in kind and "use_regex=True" in kind and "add_prefix_space=False" in kind
        line = self.call(["\n"])[0]
        if len(line) == 1:
            self.line_break = line[0]
        self.marks = dict(zip(".,;:", self.encode(".,;:"), strict=True))
        added = list(own.get_added_tokens_decoder().values())
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added):
            self.safe = False
        self.special = sorted((x.content for x in added if x.content), key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, texts: Iterable[str]) -> list:
        """What is kept of each text's ids."""
        out = []
        for call in by_bytes(texts):
            for ids in self.call(call):
                out.append(np.asarray(ids, "<u4").tobytes() if self.keep_ids else len(ids))
        return out

    def encode_words(self, words: list[str]) -> list:
        """As encode(), for pieces that end in no white space: lines of one text, as a line break between them is a piece and a token of its own."""
        out = []
        for lines in by_bytes(words, LINE_BYTES):
            ids = np.asarray(self.call(["\n".join(lines)])[0], "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.line_break).tolist(), len(ids)]
            if self.keep_ids:
                raw = ids.tobytes()
                out += [raw[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                out += [b - a - 1 for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(out) != len(words):
            raise RuntimeError("pieces and lines differ")
        return out

    def split(self, text: str) -> list[str]:
        """The text's pieces, and the strings of special tokens as pieces of their own."""
        if self.parts is None or not any(s in text for s in self.special):
            return SAFE.findall(text)
        return [p for i, part in enumerate(self.parts.split(text)) for p in ([part] if i % 2 else SAFE.findall(part))]

    def pieces(self, texts: list[str]) -> list[list]:
        """For each text what is kept of its pieces, in order."""
        if not self.safe:
            return [[x] for x in self.encode(texts)]
        if len(self.memory) > self.remembered or self.bytes > PIECE_BYTES * self.remembered:
            self.older, self.memory, self.bytes = self.memory, {}, 0
        memory, older = self.memory, self.older
        split = list(map(self.split, texts))
        found = [list(map(memory.get, x)) for x in split]
        gaps = [(i, j) for i, x in enumerate(found) for j in common.places(x)]
        new = {split[i][j] for i, j in gaps}
        words, other, marked, moved = set(), [], [], []
        for p in new:
            if p in memory:
                continue
            if (v := older.pop(p, None)) is not None:
                memory[p] = v
                moved.append(p)
            elif len(p) > LONGEST or self.line_break is None or WHITE(p[-1]) or p in self.special:
                other.append(p)
            elif p[-1] in self.marks and p[-2:-1].isalpha() and p[-2] < "\u0250":  # the split pattern parts a letter from a mark
                marked.append(p)
                if (q := p[:-1]) not in memory:
                    if (v := older.pop(q, None)) is not None:
                        memory[q] = v
                        moved.append(q)
                    else:
                        words.add(q)
            else:
                words.add(p)
        words = sorted(words)
        memory.update(zip(words, self.encode_words(words), strict=True))
        memory.update((p, memory[p[:-1]] + self.marks[p[-1]]) for p in marked)
        for held in (words, marked, moved):
            self.bytes += sum(map(len, held)) + (sum(map(len, map(memory.get, held))) if self.keep_ids else 0)
        once = dict(zip(other, self.encode(other), strict=True))
        for i, j in gaps:
            p = split[i][j]
            found[i][j] = once[p] if p in once else memory[p]
        return found


_OWN: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, keep_ids: bool = False, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder, with what it remembers from earlier tasks."""
    key = (path, keep_ids, remembered)
    common.hold(f"tokens {key}", _OWN.clear)
    if key not in _OWN:
        _OWN[key] = Encoder(path, keep_ids, remembered)
    return _OWN[key]


def texts_of(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most about four calls' bytes of text, unless one text has more."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)) if batch.num_rows else np.zeros(0)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= 4 * CALL_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                yield part, common.strings(part.column(at))
                start, size = i + 1, 0


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row. ``path``: the tokenizer's file, which every executor has."""
    source = docs.select(docs[id_col], docs[text_col])

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part, texts in texts_of(batches):
            counts = pa.array([sum(x) for x in own.pieces(texts)], pa.int64())
            size = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, counts, pc.greater(counts, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
