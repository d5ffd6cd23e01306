"""Text scores by a hierarchical Pitman-Yor language model over pairs of words.

Restaurants are contexts, the word before: one for each word, however rare, and
one for the start of a text. Dishes are all words, and the end of a text. Every restaurant's parent is the root, whose parent is the
uniform distribution over the training words and one more for all unseen ones.

A table count is sampled for each dish of each restaurant by Gibbs sweeps. With
an auxiliary gamma variable for each restaurant (``G(z + n) = integral of
x^(z+n-1) e^-x``) its dishes are independent, and c customers of a dish sit at t
tables with probability in proportion to S_d(c, t) a^t, where S are the
generalised Stirling numbers, d is the discount and a the discount times the
auxiliary variable times the dish's probability in the parent. That is drawn at
once, the tables' sizes being summed out; from ``exact`` customers on, a Poisson
number of tables is added for the further ones, as the law tends to. The root's
customers are all restaurants' tables, and its probabilities stand at their
predictive mean. Auxiliary variables, discounts and concentrations are sampled
between rounds, the latter two on a grid. Predictions use table counts averaged
over samples.

Words are 64-bit hashes. Texts become chunks of word numbers once. All pairs'
counts lie in parts by the second word (common words by both), each read and
sampled by one task; the tokens of the texts come to those parts, grouped by
chunk, and only sums by text leave them. What is collected or broadcast has
proven bounds: figures of 1 / ``hot_share`` words, and of the pairs that make up
``hot_pair_share`` of the tokens, whose tokens are scored where they lie, so no
pair that is left is a hot key. Restaurants of rarer words are told by key: each
part sends its share of their customers and tables to dealers by key, whose sums
come back to the parts that ask (also for pairs that are only scored). So where
a restaurant's figures travel hangs on its share, and nothing else does. Equal
figures are told apart by nothing: a word at a bound counts as above it.

Edge cases: a null or empty text is its end alone; rows that repeat a doc_id
are each scored (and each learned from); a null id belongs to the training
rows; without training rows every score is finite; a text of any length is in
one chunk; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Model:
    """hot_share, hot_pair_share: of the training tokens, from which a restaurant's figures are broadcast and a pair is scored where it
    lies; part_tokens, chunk_tokens, chunk_docs: of a part and of a chunk, about (a text is never cut); rounds: of sweeps, with
    auxiliary variables between; burn_in, samples: sweeps of a round; exact: customers up to which table counts are drawn
    exactly; add: the base model's smoothing."""

    hot_share: float = 1e-6
    hot_pair_share: float = 4e-6
    part_tokens: int = 4_000_000
    chunk_tokens: int = 500_000
    chunk_docs: int = 4096
    rounds: int = 2
    burn_in: int = 2
    samples: int = 3
    exact: int = 256
    add: float = 0.1
    seed: int = 20


# -- arrays in rows ------------------------------------------------------------

KINDS = ("u1", "u2", "u4", "i8", "f8")


def small(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the least type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "i8")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, their values parted into planes of equal significance."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [KINDS.index(a.dtype.str[1:]), len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(held: bytes) -> list[np.ndarray]:
    raw = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(n, 2).tolist():
        dtype = np.dtype("<" + KINDS[kind])
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(size))
        at += size * dtype.itemsize
    return out


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


# -- texts as chunks of word numbers --------------------------------------------

_KEYS: dict[bytes, int] = {}


def _key(word: bytes) -> int:
    k = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
    if len(_KEYS) > 300_000:
        _KEYS.clear()
    if len(word) < 64:
        _KEYS[word] = k
    return k


END_WORD = b"\n"  # no word holds it
END = _key(END_WORD)
CHUNK = "chunk long, n_tokens long, n_train long, body binary"


def chunks(texts: DataFrame, how: Model) -> DataFrame:
    """Rows of many texts each (doc_id, training, text): ids, flags (1: training, 2: no id), sizes, the chunk's words by frequency, and word numbers."""
    from pyspark import TaskContext

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("pitman_yor", _KEYS.clear)
        chunk = TaskContext.get().partitionId() << 36
        ids, flags, sizes, codes, own = [], [], [], [], defaultdict(count().__next__)

        def told() -> pa.RecordBatch:
            nonlocal chunk
            found = np.array(codes, np.int64)
            order = np.argsort(-np.bincount(found, minlength=len(own)), kind="stable")
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own))
            keys = np.array([_KEYS.get(w) or _key(w) for w in own], np.int64)[order]
            f, n = np.array(flags, np.uint8), np.array(sizes, np.int64)
            body = packed(np.array(ids, np.int64), f, small(n), keys, small(rank[found]))
            out = batch_of(CHUNK, [chunk], [len(found)], [int(n[f & 1 == 1].sum())], [body])
            chunk += 1
            for x in (ids, flags, sizes, codes, own):
                x.clear()
            own.default_factory = count().__next__
            return out

        for batch in batches:
            for doc, training, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END_WORD)
                ids.append(doc or 0)
                flags.append(bool(training) | (doc is None) << 1)
                sizes.append(len(words))
                codes += map(own.__getitem__, words)
                if len(codes) >= how.chunk_tokens or len(ids) >= how.chunk_docs:
                    yield told()
        if ids:
            yield told()

    return texts.select("doc_id", "training", "text").mapInArrow(run, CHUNK)


PART = "part int, body binary"


def sent(part: np.ndarray, parts: int, make) -> Iterator[pa.RecordBatch]:
    """For each part that ``part`` (sorted) has: its number, and what ``make`` packs of its slice."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cuts)).tolist()
    for k in range(0, len(some), 64):
        yield some[k : k + 64], [make(int(cuts[p]), int(cuts[p + 1])) for p in some[k : k + 64]]


def word_counts(texts: DataFrame, parts: int, least: float) -> DataFrame:
    """kind, key, n: the training words that occur ``least`` times or more (kind 0), and how many there are at all (kind 1)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            held.clear()
            part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, n = keys[order], n[order]
            for to, bodies in sent(part[order], parts, lambda a, b: packed(keys[a:b], small(n[a:b]))):
                yield batch_of(PART, to, bodies)

        for batch in batches:
            for body in batch.column(0).to_pylist():
                _, flags, sizes, keys, codes = unpacked(body)
                n = np.bincount(codes[np.repeat(flags & 1 == 1, sizes)], minlength=len(keys))
                held.append((keys[n > 0], n[n > 0]))
            if sum(len(k) for k, _ in held) > 2_000_000:
                yield from told()
        if held:
            yield from told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kinds = None, [], 0

        def told() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)
            often = n >= least
            m = int(often.sum())
            return batch_of("kind int, key long, n long", [0] * m + [1], [*keys[often].tolist(), 0], [*n[often].tolist(), len(keys)])

        for batch in batches:
            for part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at and held:
                    yield told()
                    held = []
                at = part
                held.append(tuple(unpacked(body)))
        if held:
            yield told()

    rows = texts.select("body").mapInArrow(spread, PART)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "kind int, key long, n long")


@dataclass
class Lexicon:
    """Words whose restaurants are broadcast, by key, and how often each occurs; which of them are so common that their pairs are dealt out by both words."""

    keys: np.ndarray
    counts: np.ndarray
    wide: np.ndarray
    parts: int

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place here, and whether it is here at all."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def rooms(self, keys: np.ndarray) -> np.ndarray:
        """The restaurant of each word as a context; 0 is the start of a text, ``FAR`` one that is told by its key."""
        at, here = self.find(keys)
        return np.where(here, at + 2, FAR)

    def part_of(self, keys: np.ndarray, rooms: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The part of each pair, of whose context this is the restaurant and the key."""
        at, here = self.find(keys)
        both = here & self.wide[at] if len(self.keys) else here
        own = np.where(rooms == FAR, contexts.view(np.uint64), rooms.astype(np.uint64))
        x = keys.view(np.uint64) ^ np.where(both, (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        x = np.where(both, (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), x)
        return (x % np.uint64(self.parts)).astype(np.int64)


#: In a part, restaurants that are told by key are numbered from len(Lexicon.keys) + 2 on.
FAR = 1
ROOM_BITS, DOC_BITS = 32, 12


def pairs_of(sizes: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pair of each token of a chunk: its number times the numbers that there are, and the one before (0 at a text's start)."""
    if (len(keys) + 1) ** 2 >> 63 - DOC_BITS:
        raise ValueError("more than 47 million words in a chunk")
    out = codes * (len(keys) + 1)
    out[1:] += codes[:-1] + 1
    starts = np.cumsum(sizes) - sizes
    out[starts] = codes[starts] * (len(keys) + 1)
    return out


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and how long the run of each is."""
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[starts], np.diff(np.r_[starts, len(sorted_)])


def count_pairs(texts: DataFrame, words: Lexicon) -> DataFrame:
    """A row for each part: its words, how many restaurants each is in, those restaurants, the customers, and the keys of the
    restaurants that are told by key. Of these, pairs that are only scored are in it too, without customers."""
    held_words = texts.sparkSession.sparkContext.broadcast(words)
    parts = words.parts
    rooms_ = len(words.keys) + 2

    def merged(held: list[tuple]) -> tuple[np.ndarray, ...]:
        """Pairs of several tables (keys, how many pairs each has, restaurants, keys of the far ones, customers) as one: keys, each pair's word, restaurant and customers, and far keys."""
        keys, at = np.unique(np.concatenate([k for k, *_ in held]), return_inverse=True)
        word = np.repeat(at, np.concatenate([r for _, r, *_ in held]).astype(np.int64))
        room = np.concatenate([x for _, _, x, _, _ in held]).astype(np.int64)
        n = np.concatenate([x for *_, x in held]).astype(np.int64)
        far, at = np.unique(np.concatenate([x for _, _, _, x, _ in held]), return_inverse=True)
        held.clear()
        room[room == FAR] = rooms_ + at
        cell = word << ROOM_BITS | room
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        cell, n = cell[starts], np.add.reduceat(n, starts)
        return keys, cell >> ROOM_BITS, cell & (1 << ROOM_BITS) - 1, n, far

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = held_words.value, []

        def told() -> Iterator[pa.RecordBatch]:
            keys, word, room, n, far = merged(held)
            context = np.r_[np.zeros(rooms_, np.int64), far][room]
            room = np.where(room >= rooms_, FAR, room)
            part = words.part_of(keys[word], room, context)
            order = np.argsort(part, kind="stable")
            word, room, n, part, context = word[order], room[order], n[order], part[order], context[order]

            def make(a: int, b: int) -> bytes:
                own, k = runs(word[a:b])
                return packed(keys[own], small(k), small(room[a:b]), context[a:b][room[a:b] == FAR], small(n[a:b]))

            for to, bodies in sent(part, parts, make):
                yield batch_of(PART, to, bodies)

        for batch in batches:
            for body in batch.column(0).to_pylist():
                _, flags, sizes, keys, codes = unpacked(body)
                sizes = sizes.astype(np.int64)
                codes = codes.astype(np.int64)
                pair = pairs_of(sizes, keys, codes)
                rooms, context = np.r_[0, words.rooms(keys)], np.r_[0, keys]
                use = np.repeat(flags & 1 == 1, sizes)
                some = use if use.all() else use | (rooms[pair % (len(keys) + 1)] == FAR)
                pair, times = runs(np.sort((pair << 1 | use)[some]))
                if not len(pair):
                    continue
                n = times * (pair & 1)
                code, before = np.divmod(pair >> 1, len(keys) + 1)
                own, k = runs(code)
                room = rooms[before]
                held.append((keys[own], k, room, context[before][room == FAR], n))
                if sum(len(x) for *_, x in held) > 750_000:
                    yield from told()
        if held:
            yield from told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> pa.RecordBatch:
            keys, word, room, n, far = merged(held)
            _, k = runs(word)
            return batch_of(PART, [at], [packed(keys, small(k), small(room), small(n), far)])

        for batch in batches:
            for part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at and held:
                    yield told()
                at = part
                held.append(tuple(unpacked(body)))
        if held:
            yield told()

    rows = texts.select("body").mapInArrow(spread, PART)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(merge, PART)


# -- seating -------------------------------------------------------------------

_STIRLING: dict[tuple[float, int], np.ndarray] = {}


def stirling(d: float, most: int) -> np.ndarray:
    """log S_d(c, t) for all c and t up to ``most``: the weight of the ways in which c customers sit at t tables."""
    if (d, most) not in _STIRLING:
        if len(_STIRLING) > 3:
            _STIRLING.clear()
        out = np.full((most + 1, most + 1), -np.inf)
        out[0, 0] = 0.0
        t = np.arange(most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(most):
                join = out[c] + np.log(np.maximum(c - d * t, 0.0))
                out[c + 1] = np.logaddexp(join, np.r_[-np.inf, out[c, :-1]])
        _STIRLING[d, most] = out
    return _STIRLING[d, most]


class Seats:
    """Draws table counts for dishes of so many customers, in the same order each time."""

    def __init__(self, customers: np.ndarray, most: int):
        self.customers, self.most = customers, most
        self.multi = np.flatnonzero(customers > 1)
        c = np.minimum(customers[self.multi], most)
        self.order = np.argsort(c, kind="stable")
        self.values, self.lengths = runs(c[self.order])

    def draw(self, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
        """Table counts; ``weight`` is a new table's, by dish."""
        tables = np.minimum(self.customers, 1)
        table, at = stirling(d, self.most), 0
        for c, n in zip(self.values.tolist(), self.lengths.tolist(), strict=True):
            step = max(1, 1_000_000 // c)
            for a in range(at, at + n, step):
                where = self.multi[self.order[a : min(a + step, at + n)]]
                own = np.maximum(weight[where], 1e-300)
                p = table[c, 1 : c + 1] + np.log(own)[:, None] * np.arange(1, c + 1)
                p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
                t = 1 + (p < rng.random(len(where))[:, None] * p[:, -1:]).sum(axis=1)
                if c == self.most:  # the further customers' tables
                    mean = 1 + (1 - p[:, :-1] / p[:, -1:]).sum(axis=1)
                    most = own / d
                    left = np.clip(1 - (mean - 1) / most, 0, 1)
                    t = t + rng.poisson(most * left * (1 - (self.most / self.customers[where]) ** d))
                tables[where] = t
            at += n
        return tables


@dataclass
class State:
    """What a round starts from: discounts and concentrations of restaurants and of the root, words, auxiliary variables of each
    restaurant and the root, the root's customers and tables, and those of the common words."""

    words: int
    x: np.ndarray
    x0: float
    customers: float
    tables: float
    wide_keys: np.ndarray
    wide_customers: np.ndarray
    wide_tables: np.ndarray
    d: float = 0.7
    theta: float = 1.0
    d0: float = 0.5
    theta0: float = 1.0

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's predictive probabilities of words with so many customers and tables."""
        rest = (self.theta0 + self.d0 * self.tables) / (self.words + 1)
        return (customers - self.d0 * tables + rest) / (self.theta0 + self.customers)


class Part:
    """A part's pairs."""

    def __init__(self, number: int, body: bytes):
        self.number = number
        self.keys, k, rooms, n, self.far = unpacked(body)
        self.rooms, self.customers = rooms.astype(np.int64), n.astype(np.int64)
        self.word = np.repeat(np.arange(len(self.keys)), k)

    def common(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        """Places of the part's words that are dealt out by both words, and theirs in the state."""
        if not len(state.wide_keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(state.wide_keys, self.keys), len(state.wide_keys) - 1)
        here = np.flatnonzero(state.wide_keys[at] == self.keys)
        return here, at[here]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.keys))

    def round(self, state: State, how: Model, number: int, far: Far | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean tables of each pair, mean customers and tables of each word in the root, and the last sample's tables of pairs and words."""
        rng = np.random.default_rng([how.seed, number, self.number])
        here, there = self.common(state)
        seats = Seats(self.customers, how.exact)
        x = np.r_[state.x, far.auxiliary(state, how, number)] if far else state.x
        t = np.minimum(self.customers, 1)
        m = self.sums(t)
        s = np.minimum(m, 1)
        total, total_m, total_s = np.zeros(len(t)), np.zeros(len(m)), np.zeros(len(m))
        for sweep in range(how.burn_in + how.samples):
            base = state.root(m, s)
            base[here] = state.root(state.wide_customers[there], state.wide_tables[there])
            t = seats.draw(state.d * x[self.rooms] * base[self.word], state.d, rng)
            m = self.sums(t).astype(np.int64)
            s = Seats(m, how.exact).draw(np.full(len(m), state.d0 * state.x0 / (state.words + 1)), state.d0, rng)
            if sweep >= how.burn_in:
                total, total_m, total_s = total + t, total_m + m, total_s + s
        n = how.samples
        return total / n, total_m / n, total_s / n, t, s


# -- restaurants told by key -----------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key, the same wherever it is drawn."""
    start = mixed(np.array([salt % (1 << 64)], np.uint64))
    return ((mixed(keys.view(np.uint64) ^ start) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def gammas(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """A gamma variable for each key, the same wherever it is drawn (Marsaglia and Tsang's rejection; shapes of 1 and more)."""
    d = shape - 1 / 3
    out, left = np.empty(len(keys)), np.arange(len(keys))
    for k in count():
        if not len(left):
            return out
        u, v, w = (uniforms(keys[left], (salt << 16) + 3 * k + j) for j in range(3))
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)
        b = (1 + z / np.sqrt(9 * d[left])) ** 3
        good = np.log(w) < 0.5 * z * z + d[left] * (1 - b + np.log(np.maximum(b, 1e-300)))
        good &= b > 0
        out[left[good]] = d[left[good]] * b[good]
        left = left[~good]


def dealt(far: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by dealer, and where each dealer's begin and end."""
    dealer = (far.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(dealer, kind="stable")
    return order, np.searchsorted(dealer[order], np.arange(parts + 1))


class Far:
    """Customers and mean tables of a part's restaurants that are told by key, as the dealers say."""

    def __init__(self, keys: np.ndarray, parts: int):
        self.keys = keys
        self.order, self.cuts = dealt(keys, parts)
        self.guests, self.tables = np.zeros(len(keys)), np.zeros(len(keys))

    def hear(self, dealer: int, body: bytes) -> None:
        where = self.order[self.cuts[dealer] : self.cuts[dealer + 1]]
        guests, tables, scale = unpacked(body)
        self.guests[where], self.tables[where] = guests, tables / scale[0]

    def auxiliary(self, state: State, how: Model, number: int) -> np.ndarray:
        """The auxiliary variables before a round; those of restaurants without customers count nowhere."""
        return gammas(np.maximum(state.theta / state.d + self.tables, 1), self.keys, (how.seed << 16) + number)


ANSWERS = "part int, kind int, id long, value double, body binary"


def deal(asked: DataFrame, parts: int, laws: bool) -> DataFrame:
    """The dealers' answers (kind 1; id: the dealer) to what parts ask (id: the dealer; key: the part), and what the restaurants say of each law (kind 2), where that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> pa.RecordBatch:
            bodies = [unpacked(body) for _, body in held]
            keys, where = np.unique(np.concatenate([x[0] for x in bodies]), return_inverse=True)
            guests, tables = (np.bincount(where, np.concatenate([x[k] for x in bodies]), len(keys)).astype(np.int64) for k in (1, 2))
            scale = bodies[0][3]
            ends = np.cumsum([0, *(len(x[0]) for x in bodies)]).tolist()
            out = [packed(small(guests[where[a:b]]), small(tables[where[a:b]]), scale) for a, b in zip(ends, ends[1:], strict=False)]
            some = guests > 0
            logs = law_logs(guests[some], np.round(tables[some] / scale[0])) if laws else np.zeros(0)
            n, m = len(out), len(logs)
            return batch_of(ANSWERS, [*(p for p, _ in held), *[-1] * m], [1] * n + [2] * m, [at] * n + list(range(m)), np.r_[np.zeros(n), logs], out + [None] * m)

        for batch in batches:
            for dealer, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dealer != at and held:
                    yield told()
                    held = []
                at = dealer
                held.append((part, body))
        if held:
            yield told()

    rows = asked.select(F.col("id").cast("int").alias("id"), F.col("key").cast("int").alias("key"), "body")
    return rows.repartitionById(parts, F.col("id")).sortWithinPartitions("id").mapInArrow(run, ANSWERS)


FOUND = "kind int, id long, key long, n long, value double, body binary"
#: Kinds of figures: by restaurant customers and tables, by common word tables, of the root customers and tables (without the
#: common words'), how often c customers have t tables in restaurants and in the root, the pairs that are scored where they lie
#: (two kinds), and what a part asks a dealer.
GUESTS, TABLES, WIDE, ROOT, ROOT_TABLES, LAWS, ROOT_LAWS, HOT = range(8)
ASKED = HOT + 2


def figures(cells: DataFrame, answers: DataFrame | None, parts: int, state: State, how: Model, number: int | None, least: float = math.inf) -> DataFrame:
    """The figures of a round, or with every dish at one table where there is no number; hot pairs from ``least`` customers on."""
    held = cells.sparkSession.sparkContext.broadcast(state)
    n_rooms = len(state.x)

    def one(part: Part, far: Far) -> Iterator[pa.RecordBatch]:
        state = held.value
        here, there = part.common(state)
        if number is None:
            tables = np.minimum(part.customers, 1).astype(float)
            customers = part.sums(tables)
            root_tables = np.minimum(customers, 1)
        else:
            tables, customers, root_tables, last, last_root = part.round(state, how, number, far)
        own = np.ones(len(part.keys), bool)
        own[here] = False
        rows = []

        def add(kind: int, ids: np.ndarray, values: np.ndarray, keys: np.ndarray | None = None, ns: np.ndarray | None = None) -> None:
            none = np.zeros(len(ids), np.int64)
            rows.append((np.full(len(ids), kind), ids, none if keys is None else keys, none if ns is None else ns, np.asarray(values, float)))

        scale, sums = np.array([1 if number is None else how.samples]), []
        for kind, values in ((GUESTS, part.customers), (TABLES, tables)):
            sums.append(np.bincount(part.rooms, values, n_rooms + len(part.far)))
            some = np.flatnonzero(sums[-1][:n_rooms])
            if kind == TABLES or number is None:  # customers stay
                add(kind, some, sums[-1][some])
        add(WIDE, there, customers[here])
        add(ROOT, np.zeros(1, np.int64), [tables.sum()])
        add(ROOT_TABLES, np.zeros(1, np.int64), [root_tables[own].sum()])
        if number is not None:
            for kind, c, t in ((LAWS, part.customers, last), (ROOT_LAWS, part.sums(last).astype(np.int64)[own], last_root[own])):
                small_ = (c > 0) & (c <= how.exact)
                law, times = runs(np.sort(c[small_] << 20 | t[small_]))
                add(kind, law, times)
            hot = np.flatnonzero(part.customers >= least)
            root = customers - state.d0 * root_tables
            root[here] = np.nan
            add(HOT, part.rooms[hot], tables[hot], part.keys[part.word[hot]], part.customers[hot])
            add(HOT + 1, part.rooms[hot], root[part.word[hot]], part.keys[part.word[hot]])
        columns = [np.concatenate([x[k] for x in rows]) for k in range(5)]
        yield batch_of(FOUND, *columns, pa.nulls(len(columns[0]), pa.binary()))
        guests, tables = sums[0][n_rooms:].astype(np.int64), np.round(sums[1][n_rooms:] * scale[0]).astype(np.int64)
        for dealer in np.flatnonzero(np.diff(far.cuts)).tolist():
            where = far.order[far.cuts[dealer] : far.cuts[dealer + 1]]
            body = packed(part.far[where], small(guests[where]), small(tables[where]), scale)
            yield batch_of(FOUND, [ASKED], [dealer], [part.number], [0], [0.0], [body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, far = None, None
        for batch in batches:
            for n, kind, dealer, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if part:
                        yield from one(part, far)
                    part = Part(n, body)
                    far = Far(part.far, parts)
                else:
                    far.hear(dealer, body)
        if part:
            yield from one(part, far)

    rows = cells.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("id"), "body")
    if answers is not None:
        said = answers.filter("kind = 1").select("part", "kind", "id", "body")
        rows = rows.unionByName(said).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    return rows.mapInArrow(run, FOUND)


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y, shift = np.maximum(x, 1e-300), np.zeros_like(x)
    for _ in range(16):
        less = y < 16
        shift -= np.where(less, np.log(y), 0.0)
        y = np.where(less, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


DISCOUNTS, CONCENTRATIONS = tuple(round(0.05 * k, 2) for k in range(1, 20)), (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)


def law_logs(guests: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What customers and tables of restaurants say of each discount and concentration of the grid, but for the dishes' seats."""
    if not len(guests):
        return np.zeros(len(DISCOUNTS) * len(CONCENTRATIONS))
    (n, n_times), (t, t_times) = np.unique(guests, return_counts=True), np.unique(tables, return_counts=True)
    logs = []
    for d in DISCOUNTS:
        for theta in CONCENTRATIONS:
            new = t * math.log(d) + log_gamma(theta / d + t) - log_gamma(np.full(1, theta / d))
            seated = log_gamma(theta + n) - log_gamma(np.full(1, theta))
            logs.append(float((new * t_times).sum() - (seated * n_times).sum()))
    return np.array(logs)


def sample_law(logs: np.ndarray, laws: np.ndarray, times: np.ndarray, how: Model, rng: np.random.Generator) -> tuple[float, float]:
    """A discount and a concentration from a grid, given what restaurants say of each, and how often (times) c customers have t tables (laws: c << 20 | t)."""
    c, u = laws >> 20, laws & (1 << 20) - 1
    seats = [float((stirling(d, how.exact)[c, u] * times).sum()) for d in DISCOUNTS]
    logs = logs + np.repeat(seats, len(CONCENTRATIONS))
    p = np.exp(logs - logs.max())
    k = int(rng.choice(len(p), p=p / p.sum()))
    return DISCOUNTS[k // len(CONCENTRATIONS)], CONCENTRATIONS[k % len(CONCENTRATIONS)]


@dataclass
class Learned:
    """What scoring needs: the state of the last round, the restaurants' customers and mean tables, the averaged root, and the hot
    pairs' logarithms; the dealers' answers before and after that round stay tables."""

    state: State
    after: State
    guests: np.ndarray
    tables: np.ndarray
    hot: np.ndarray
    hot_say: np.ndarray
    answers: tuple[DataFrame, DataFrame] | None = None


def pair_hash(keys: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64) + rooms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).view(np.int64)


def arrays(rows: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, on the driver."""
    return [c.to_numpy() for c in rows.toArrow().columns]


def learn(cells: DataFrame, words: Lexicon, n_words: int, n: int, how: Model) -> Learned:
    """Rounds of sweeps over the parts, with the figures that tie parts together sampled here in between."""
    rng = np.random.default_rng(how.seed)
    wide = words.keys[words.wide]
    n_rooms = len(words.keys) + 2
    state = State(n_words, np.ones(n_rooms), 1.0, 0.0, 0.0, wide, np.zeros(len(wide)), np.zeros(len(wide)))

    def gathered(number: int | None, answers: DataFrame | None, least: float = math.inf) -> tuple[dict[int, object], DataFrame]:
        rows, path = common.written_at(figures(cells, answers, words.parts, state, how, number, least), "figures")
        kinds, ids, values = arrays(rows.filter(F.col("kind") < HOT).groupBy("kind", "id").agg(F.sum("value").alias("value")))
        out: dict[int, object] = {k: (ids[kinds == k], values[kinds == k]) for k in range(HOT)}
        hot = rows.filter(F.col("kind").isin(HOT, HOT + 1)).drop("body")
        out[HOT] = arrays(hot.orderBy("key", "id", "kind")) if least < math.inf else None
        said = common.written(deal(rows.filter(F.col("kind") == ASKED), words.parts, number is not None and least == math.inf), "answers")
        common.forget(cells.sparkSession, path)
        common.sweep(cells.sparkSession)
        return out, said

    def dense(found: dict, kind: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        ids, values = found[kind]
        out[ids] = values
        return out

    def after(found: dict, start: State) -> tuple[State, np.ndarray]:
        tables, customers = dense(found, TABLES, n_rooms), dense(found, WIDE, len(wide))
        seated = Seats(np.round(customers).astype(np.int64), how.exact).draw(np.full(len(wide), start.d0 * start.x0 / (n_words + 1)), start.d0, rng).astype(float)
        return replace(start, customers=dense(found, ROOT, 1)[0], tables=dense(found, ROOT_TABLES, 1)[0] + seated.sum(), wide_customers=customers, wide_tables=seated), tables

    found, answers = gathered(None, None)
    guests = dense(found, GUESTS, n_rooms)
    state, tables = after(found, state)
    for number in range(how.rounds):
        state = replace(state, x=rng.gamma(state.theta / state.d + tables), x0=float(rng.gamma(state.theta0 / state.d0 + state.tables)))
        last = number + 1 == how.rounds
        start, before = state, answers
        found, answers = gathered(number, before, max(2.0, max(how.hot_pair_share, how.hot_share) * n) if last else math.inf)
        state, tables = after(found, state)
        if not last and n:
            some = guests > 0
            logs = law_logs(guests[some], np.round(tables[some]))
            ids, more = arrays(answers.filter("kind = 2").groupBy("id").agg(F.sum("value").alias("value")))
            logs[ids] += more
            d, theta = sample_law(logs, *found[LAWS], how, rng)
            d0, theta0 = sample_law(law_logs(np.array([state.customers]), np.round([state.tables])), *found[ROOT_LAWS], how, rng)
            state = replace(state, d=d, theta=theta, d0=d0, theta0=theta0)
    kinds, room, key, n_pair, value = found[HOT]
    first = kinds == HOT  # a pair's two rows follow each other
    root, room, key, n_pair, value = value[~first], room[first], key[first], n_pair[first], value[first]
    base = state.root(np.nan_to_num(root), np.zeros(len(root)))
    if len(wide):
        at = np.minimum(np.searchsorted(wide, key), len(wide) - 1)
        base = np.where(wide[at] == key, state.root(state.wide_customers[at], state.wide_tables[at]), base)
    say = np.log10((n_pair - state.d * value + (state.theta + state.d * tables[room]) * base) / (state.theta + guests[room]))
    hashes = pair_hash(key, room)
    order = np.argsort(hashes)
    return Learned(start, state, guests, tables, hashes[order], say[order], (before, answers))


# -- scores --------------------------------------------------------------------

TOLD = "part int, kind int, chunk long, body binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_chunks(texts: DataFrame, cells: DataFrame, words: Lexicon, learned: Learned, n: int, how: Model) -> DataFrame:
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((words, replace(learned, answers=None)))
    parts = words.parts
    v = learned.state.words
    z = n + how.add * (v + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, learned = held.value
        for batch in batches:
            for chunk, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, flags, sizes, keys, codes = unpacked(body)
                sizes, codes = sizes.astype(np.int64), codes.astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                entry, times = runs(np.sort(pairs_of(sizes, keys, codes) << DOC_BITS | doc))
                doc, cell = entry & (1 << DOC_BITS) - 1, entry >> DOC_BITS
                cell, entries = runs(cell)
                code, before = np.divmod(cell, len(keys) + 1)
                room, context = np.r_[0, words.rooms(keys)][before], np.r_[0, keys][before]
                say, base, known = (np.zeros(len(sizes)) for _ in range(3))
                if len(learned.hot) and len(words.keys):
                    own = pair_hash(keys[code], room)
                    at = np.minimum(np.searchsorted(learned.hot, own), len(learned.hot) - 1)
                    here = learned.hot[at] == own
                    if here.any():
                        # a hot pair's word occurs as often as the pair at least, so it is in the lexicon
                        place, listed = words.find(keys[code])
                        here &= listed
                        each = np.repeat(here, entries)
                        d, k = doc[each], times[each]
                        m = len(sizes)
                        say = np.bincount(d, k * np.repeat(learned.hot_say[at], entries)[each], m)
                        logs = np.log10((words.counts + how.add) / z)
                        base = np.bincount(d, k * np.repeat(logs[place], entries)[each], m)
                        known = np.bincount(d, k, m).astype(float)
                        doc, times = doc[~each], times[~each]
                        code, room, context, entries = code[~here], room[~here], context[~here], entries[~here]
                yield batch_of(TOLD, [chunk % parts], [-1], [chunk], [packed(ids, flags, small(sizes), say, base, known)])
                part = words.part_of(keys[code], room, context)
                order = np.argsort(part, kind="stable")
                starts = np.cumsum(entries) - entries
                part, code, room, context, entries, starts = part[order], code[order], room[order], context[order], entries[order], starts[order]
                offsets = np.cumsum(entries) - entries
                pick = np.repeat(starts - offsets, entries) + np.arange(len(doc))
                doc, times = doc[pick], times[pick]
                ends = np.r_[offsets, len(doc)]

                def make(a: int, b: int) -> bytes:
                    own, k = runs(code[a:b])
                    e, f = int(ends[a]), int(ends[b])
                    return packed(keys[own], small(k), small(room[a:b]), context[a:b][room[a:b] == FAR], small(entries[a:b]), small(doc[e:f]), small(times[e:f] - 1))

                for to, bodies in sent(part, parts, make):
                    yield batch_of(TOLD, to, [3] * len(to), [chunk] * len(to), bodies)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, learned = held.value
        start, state = learned.state, learned.after
        number, part, p, far = None, None, None, []

        def known() -> tuple:
            none = np.zeros(0, np.int64)
            if p is None:
                return none, none, none, np.zeros(0), np.zeros(0), none, none, learned.guests, learned.tables
            tables, customers, root_tables, _, _ = p.round(start, how, how.rounds - 1, far[0])
            base, counts = state.root(customers, root_tables), p.sums(p.customers).astype(np.int64)
            here, there = p.common(state)
            base[here] = state.root(state.wide_customers[there], state.wide_tables[there])
            at, listed = words.find(p.keys[here])
            counts[here] = words.counts[at]
            return p.keys, p.word << ROOM_BITS | p.rooms, p.customers, tables, base, counts, p.far, np.r_[learned.guests, far[1].guests], np.r_[learned.tables, far[1].tables]

        unseen = state.root(np.zeros(1), np.zeros(1))[0]
        for batch in batches:
            for own, kind, chunk, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == -1:
                    yield batch_of("chunk long, kind int, body binary", [chunk], [0], [body])
                    continue
                if own != number:
                    number, part, p = own, None, None
                if kind == 0:
                    p = Part(own, body)
                    far = [Far(p.far, parts), Far(p.far, parts)]
                    continue
                if kind < 3:
                    far[kind - 1].hear(chunk, body)
                    continue
                part = part or known()
                p_keys, p_cells, p_customers, p_tables, p_base, p_counts, p_far, p_guests, p_room_tables = part
                keys, k, room, context, entries, doc, times = unpacked(body)
                room = room.astype(np.int64)
                if len(context):  # all of them are among the part's, be it without customers
                    room[room == FAR] = len(learned.guests) + np.searchsorted(p_far, context)
                word, c, t, base, n_word = np.full(len(keys), -1), np.zeros(len(room)), np.zeros(len(room)), np.full(len(keys), unseen), np.zeros(len(keys))
                if len(p_keys):
                    at = np.minimum(np.searchsorted(p_keys, keys), len(p_keys) - 1)
                    here = p_keys[at] == keys
                    word[here], base[here], n_word[here] = at[here], p_base[at[here]], p_counts[at[here]]
                word, base, n_word = (np.repeat(x, k) for x in (word, base, n_word))
                if len(p_cells):
                    cell = word << ROOM_BITS | room
                    at = np.minimum(np.searchsorted(p_cells, cell), len(p_cells) - 1)
                    here = (word >= 0) & (p_cells[at] == cell)
                    c[here], t[here] = p_customers[at[here]], p_tables[at[here]]
                guests, tables = p_guests[room], p_room_tables[room]
                say = np.log10((c - state.d * t + (state.theta + state.d * tables) * base) / (state.theta + guests))
                logs = np.log10((n_word + how.add) / z)
                k2, m = times.astype(float) + 1, int(doc.max()) + 1 if len(doc) else 0
                sums = [np.bincount(doc, k2 * np.repeat(x, entries), m) for x in (say, logs, (n_word > 0).astype(float))]
                some = np.flatnonzero(np.bincount(doc, minlength=m))
                yield batch_of("chunk long, kind int, body binary", [chunk], [1], [packed(small(some), sums[0][some], sums[1][some], small(sums[2][some]))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None

        def told() -> pa.RecordBatch:
            ids, flags, sizes, say, base, known = head
            return batch_of(SCORES, pa.array(ids, mask=flags >> 1 == 1), flags & 1 == 0, sizes.astype(np.int64), known.astype(np.int64), base, say)

        for batch in batches:
            for chunk, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if head:
                        yield told()
                    at, head = chunk, [x.copy() for x in unpacked(body)]
                    continue
                if chunk != at:
                    raise RuntimeError("sums without their texts")
                some, say, base, known = unpacked(body)
                for k, x in ((3, say), (4, base), (5, known)):
                    head[k][some] += x
        if head:
            yield told()

    rows = texts.select("chunk", "body").mapInArrow(spread, TOLD)
    counted = cells.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "body")
    for kind, answers in enumerate(learned.answers, 1):
        counted = counted.unionByName(answers.filter("kind = 1").select("part", F.lit(kind).alias("kind"), F.col("id").alias("chunk"), "body"))
    met = counted.unionByName(rows).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(meet, "chunk long, kind int, body binary")
    return met.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, SCORES)


def score_texts(docs: DataFrame, training, how: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. ``training``: a column that is true for rows to learn from."""
    if how.chunk_docs > 1 << DOC_BITS:
        raise ValueError("chunks of at most 4096 texts")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(training, F.lit(True)).alias("training"), F.col(text_col).alias("text"))
    texts = common.written(chunks(source, how), "chunks")
    total, n = texts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts = max(1, -(-total // how.part_tokens))
    kinds, keys, counts = arrays(word_counts(texts, parts, max(how.hot_share * n, 1)).groupBy("kind", "key").agg(F.sum("n").alias("n")).orderBy("key"))
    n_words = int(counts[kinds == 1].sum())
    keys, counts = keys[kinds == 0], counts[kinds == 0]
    words = Lexicon(keys, counts, counts >= max(n / (8 * parts), how.hot_share * n), parts)
    cells = common.written(count_pairs(texts, words), "pairs")
    common.sweep(docs.sparkSession)
    learned = learn(cells, words, n_words, n, how)
    return score_chunks(texts, cells, words, learned, n, how).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
