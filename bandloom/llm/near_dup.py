"""Near-duplicates by MinHash with sequential Bayesian verification.

Equal shingle sets become one node at once. Nodes whose signatures agree in a
band of hashes are candidates, in buckets. Two rounds find every link that
matters for the components, without all pairs of a bucket:

1. In each bucket the smallest node is compared with the others, which links
   most of a group in as many comparisons as it has members.
2. Buckets that still hold more than one component are compared across
   components only, in blocks of bounded size.

Both rounds first compare signatures alone: a batch of hashes at a time, and a
pair is let go when the posterior probability that its similarity reaches the
bound, given the matches so far and a uniform prior, falls below ``miss``. Texts
are fetched only for what survives, in blocks of bounded bytes, and verified
exactly on the full shingle sets. Components come from hash-to-min label
propagation with pointer jumping. Joins on a bucket's or a group's key have
plain exchanges, so adaptive plans split a key with many rows.

At a similarity of exactly 0.85 a pair shares none of 20 bands of 5 hashes with
probability 8e-6, at 0.8 none of 30 with 7e-6, and above with less.

Edge cases: documents without words (or null) have an empty set, no links and
their own id as component; rows that repeat a doc_id are one node for each
distinct set and share the smallest id; rows without an id take the component of
rows with an equal set that have one, and otherwise have none and are kept; ties
in similarity don't matter, as components don't depend on which links are found
first; a text of any length is one row, and a task holds one such text beside
its block; an empty table gives an empty table; columns other than id and text
are never looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle; at_least: the similarity of linked documents, in hundredths; bands and rows: of the
    signature; batch: hashes compared at once; miss: the posterior probability below which a pair is let go;
    block: rows of a bucket on each side of one comparison of signatures; block_bytes: text on the held side of one
    exact comparison; fan: partners of a node verified in one task."""

    words: int = 5
    at_least: int = 80
    bands: int = 30
    rows: int = 5
    batch: int = 20
    miss: float = 1e-6
    block: int = 512
    block_bytes: int = 8 << 20
    fan: int = 256

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """For each batch end n: the fewest matches of n at which the posterior of the similarity still reaches the bound."""
        t, out = self.at_least / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            below, m = 0.0, 0
            while m <= n:
                below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)  # Beta(m + 1, n - m + 1) above t
                if below >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out


_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hold() -> None:
    """Not in the tasks' own functions, as what those name of this module is copied with them, and so would be the words."""
    common.hold("near_dup", _WORDS.clear)


def _word_hash(word: bytes) -> int:
    h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    if len(word) < 64:
        _WORDS[word] = h
    return h


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; with fewer words than a shingle has, one of them all."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    get = _WORDS.get
    h = np.fromiter((get(w) or _word_hash(w) for w in found), np.uint64, n)
    k = min(words, n)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s = _mix(s * _MULTIPLY[0] + h[i : n - k + 1 + i])
    return np.unique(_mix(s + np.uint64(k)))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MULTIPLY[1])
    return x[:n].astype(np.uint32), x[n:].astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n minima of hashes of the set, 32 bits each."""
    xor, times = _seeds(n)
    h = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(out, ((h[a : a + 2048, None] ^ xor) * times).min(axis=0), out=out)
    return out


SIGNED = "text_hash long, n_shingles long, n_bytes long, digest binary, signature binary, keys array<long>"


def sign(docs: DataFrame, rule: NearDup, id_col: str, text_col: str) -> DataFrame:
    """doc_id, its text's hash and bytes, the size and digest of its set, its signature (16 bits of each hash) and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        for batch in batches:
            n, size, digest, sig = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, rule.words)
                n.append(len(s))
                size.append(len((text or "").encode("utf-8", "surrogatepass")))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, rule.hashes))
            if not n:
                continue
            whole = np.stack(sig)
            low = (whole & np.uint32(0xFFFF)).astype(np.uint16)
            keys = np.zeros((len(n), rule.bands), np.uint64) + np.arange(1, rule.bands + 1, dtype=np.uint64)
            for i in range(rule.rows):
                keys = _mix(keys * _MULTIPLY[0] + whole[:, i :: rule.rows].astype(np.uint64))
            values = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, rule.bands, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), lists],
                names=["doc_id", *(x.split()[0] for x in SIGNED.split(", "))],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {SIGNED}")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that it reaches, for every node of the edges u, v."""
    both = checkpointed_pairs(edges)
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels = common.checkpointed(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("least"))
        new = labels.join(near, "node").select("node", F.least("component", "least").alias("hop"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("hop"), F.col("component").alias("far"))
        new = common.checkpointed(new.join(jump, "hop", "left").select("node", F.coalesce(F.least("hop", "far"), "hop").alias("component"), "was"))
        changed = new.filter("component <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels


def checkpointed_pairs(edges: DataFrame) -> DataFrame:
    return common.checkpointed(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())


def _grouped(pairs: DataFrame, table: DataFrame, columns: list[str], rule: NearDup) -> DataFrame:
    """u, fan, v and ``columns``: a row for u itself (v null), then its partners, where each task has ``fan`` of those at most."""
    fans = pairs.groupBy("u").agg(F.ceil(F.count("*") / rule.fan).alias("fans"))
    right = pairs.join(fans, "u").withColumn("fan", F.pmod(F.xxhash64("v"), "fans"))
    right = right.join(table, right["v"] == table["node"]).select("u", "fan", "v", *columns)
    left = fans.join(table, fans["u"] == table["node"]).select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)).alias("fan"), F.lit(None).cast("long").alias("v"), *columns)
    return left.unionByName(right).repartition("u", "fan").sortWithinPartitions("u", "fan", F.col("v").asc_nulls_first())


def _pairs(out: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(out), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[a : a + 100_000], strict=True)], names=["u", "v"])


def likely(pairs: DataFrame, nodes: DataFrame, rule: NearDup) -> DataFrame:
    """The pairs (u, v) that pass the Bayesian test on their signatures."""
    tests, bound = rule.least_matches(), rule.at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for u, fan, v, n, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(sig, np.uint16)
                if (u, fan) != at:
                    at, held = (u, fan), []
                if v is None:
                    held.append((n, own))
                elif any(100 * min(n, m) >= bound * max(n, m) and _passes(own, other, tests) for m, other in held):
                    out.append((u, v))
            yield from _pairs(out)

    return _grouped(pairs, nodes, ["n_shingles", "signature"], rule).mapInArrow(run, "u long, v long")


def _passes(a: np.ndarray, b: np.ndarray, tests: list[tuple[int, int]]) -> bool:
    matches = done = 0
    for k, least in tests:
        matches += int(np.count_nonzero(a[done:k] == b[done:k]))
        if matches < least:
            return False
        done = k
    return True


def verified(pairs: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """The pairs (u, v) that are linked by their full sets."""
    words, bound = rule.words, rule.at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        at, held = None, []
        for batch in batches:
            out = []
            for u, fan, v, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, words)
                if (u, fan) != at:
                    at, held = (u, fan), []
                if v is None:
                    held.append(s)
                elif any(_linked(s, t, bound) for t in held):
                    out.append((u, v))
            yield from _pairs(out)

    return _grouped(pairs, texts, ["text"], rule).mapInArrow(run, "u long, v long")


def _linked(s: np.ndarray, t: np.ndarray, bound: int) -> bool:
    if 100 * min(len(s), len(t)) < bound * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= bound * (len(s) + len(t) - shared)


class Block:
    """The held side of a comparison: rows of band, node, component, set size, signature, keys and (for the exact test) text."""

    def __init__(self, rows: list[tuple], rule: NearDup):
        self.rows, self.rule, self.tests = rows, rule, rule.least_matches()
        self.band = rows[0][0]
        self.kind, self.n = (np.array([x[k] for x in rows], np.int64) for k in (2, 3))
        self.sigs = np.stack([np.frombuffer(x[4], np.uint16) for x in rows])
        self.keys = np.array([x[5][: self.band] for x in rows], np.int64) if self.band else None
        self.sets: dict[int, np.ndarray] = {}
        self.joined: dict[int, int] = {}

    def near(self, component: int, n: int, sig: bytes, keys: list[int]) -> np.ndarray:
        """Places of rows of other components that pass the Bayesian test, the most alike first, unless an earlier band that both share answers for them."""
        bound = self.rule.at_least
        live = np.flatnonzero((self.kind != component) & (100 * np.minimum(self.n, n) >= bound * np.maximum(self.n, n)))
        own, done, matches = np.frombuffer(sig, np.uint16), 0, np.zeros(len(live), np.int64)
        for k, least in self.tests:
            if not len(live):
                return live
            matches = matches + np.count_nonzero(self.sigs[live, done:k] == own[done:k], axis=1)
            stay = matches >= least
            live, matches, done = live[stay], matches[stay], k
        if self.band and len(live):
            new = ~(self.keys[live] == np.array(keys[: self.band], np.int64)).any(axis=1)
            live, matches = live[new], matches[new]
        return live[np.argsort(-matches, kind="stable")]

    def root(self, c: int) -> int:
        while c in self.joined:
            c = self.joined[c]
        return c

    def links(self, row: tuple) -> list[tuple[int, int]]:
        """The row's exact links, but for components that links of this block have joined before."""
        _, v, c, n, sig, keys, text = row
        s, out, words = None, [], self.rule.words
        for i in self.near(c, n, sig, keys).tolist():
            x, y = self.root(int(self.kind[i])), self.root(c)
            if x == y:
                continue
            s = shingles(text, words) if s is None else s
            if i not in self.sets:
                self.sets[i] = shingles(self.rows[i][6], words)
            if _linked(s, self.sets[i], self.rule.at_least):
                self.joined[max(x, y)] = min(x, y)
                out.append((v, self.rows[i][1]))
        return out


ROW = ["band", "node", "component", "n_shingles", "signature", "keys"]


def across(buckets: DataFrame, candidates: DataFrame, rule: NearDup) -> DataFrame:
    """Links (u, v) between different components within a bucket, enough of them to join what belongs together.

    ``buckets``: key, band, node, component; ``candidates``: node, n_shingles, n_bytes, signature, keys, text. A bucket's
    rows stand on the left in blocks, those outside its largest component on the right in blocks; every block of one
    side meets every block of the other in a task of its own, first by signatures alone. Of those blocks only the rows
    that have a likely partner go on, with their texts, in blocks of bounded bytes.
    """
    block = rule.block
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    sizes = buckets.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    largest = largest.filter("kinds > 1").select("key", F.col("most.component").alias("largest"), F.ceil(F.col("all") / block).alias("lefts"), F.ceil((F.col("all") - F.col("most.n")) / block).alias("rights"))
    mixed = buckets.join(largest, "key").join(candidates.select("node", "n_shingles", "signature", "keys"), "node")
    left = mixed.select("key", place("lefts").alias("i"), span("rights").alias("j"), F.lit(0).alias("side"), *ROW)
    right = mixed.filter("component <> largest").select("key", span("lefts").alias("i"), place("rights").alias("j"), F.lit(1).alias("side"), *ROW)
    rows = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def meet(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Block, tuple]]:
        """For each row on the right its block's key, the rows on the left, and the row."""
        at, held, own = None, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != at:
                    at, held, own = row[:n_keys], [], None
                if not row[n_keys]:
                    held.append(row[n_keys + 1 :])
                elif held:
                    own = own or Block(held, rule)
                    yield at, own, row[n_keys + 1 :]

    def by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, lefts, out = None, None, set(), []

        def told(most: int) -> Iterator[pa.RecordBatch]:
            if len(out) > most:
                columns = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 2 + (pa.int64(),) * 2, strict=True)], names=["key", "i", "j", "side", "band", "node", "component"])

        def closed() -> None:
            out.extend((*at, 0, *last.rows[i][:3]) for i in sorted(lefts))
            lefts.clear()

        for key, own, row in meet(batches, 3):
            if key != at:
                if lefts:
                    closed()
                at, last = key, own
            near = own.near(*row[2:6])
            if len(near):
                lefts.update(near.tolist())
                out.append((*key, 1, *row[:3]))
            yield from told(50_000)
        if lefts:
            closed()
        yield from told(0)

    found = common.checkpointed(rows.mapInArrow(by_signature, "key long, i long, j long, side int, band int, node long, component long"))

    sized = found.filter("side = 0").join(candidates.select("node", "n_bytes"), "node").groupBy("key", "i", "j").agg(F.ceil((F.sum("n_bytes") + 1) / rule.block_bytes).alias("subs"))
    found = found.join(sized, ["key", "i", "j"])
    found = found.withColumn("k", F.explode(F.when(F.col("side") == 0, F.array(place("subs"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))))
    pairs = found.join(candidates.select("node", "n_shingles", "signature", "keys", "text"), "node").select("key", "i", "j", "k", "side", *ROW, "text")
    pairs = pairs.repartition("key", "i", "j", "k").sortWithinPartitions("key", "i", "j", "k", "side", "node")

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        out: list[tuple[int, int]] = []
        for _, own, row in meet(batches, 4):
            out += own.links(row)
            if len(out) > 50_000:
                yield from _pairs(out)
                out = []
        yield from _pairs(out)

    return pairs.mapInArrow(by_text, "u long, v long")


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    signed = common.written(sign(docs, rule, id_col, text_col), "signed")
    named = common.written(signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    own = signed.select(F.col("doc_id").alias("node"), *(x.split()[0] for x in SIGNED.split(", "))).join(named.filter("node is not null"), ["node", "digest"])
    nodes = common.written(own.dropDuplicates(["node", "digest"]).drop("digest"), "node-signatures")

    banded = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").drop("last")
    buckets = common.checkpointed(banded.join(pivots, "key"))
    light = nodes.join(buckets.select("node").distinct(), "node")
    source = _source(docs, id_col, text_col).withColumnRenamed("doc_id", "node")
    candidates = common.written(light.join(source, ["node", "text_hash"]).dropDuplicates(["node", "text_hash"]).drop("text_hash"), "candidates")

    stars = buckets.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    stars = common.checkpointed(likely(stars, candidates.select("node", "n_shingles", "signature"), rule))
    first = components(common.checkpointed(verified(stars, candidates.select("node", "text"), rule)))
    labelled = buckets.join(first, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    more = across(labelled, candidates, rule)
    more = common.checkpointed(more.unionByName(first.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))))
    final = components(more).filter("node <> component")

    rows = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").join(final, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stands for its group.

    Different texts under one id are compared each by itself, as are texts without an id, of which equal ones are
    one document. Of rows that repeat an id one stays: among those that aren't copies of another document the one
    whose text has the least digest goes first, as it goes by the id; other texts of repeated ids, and those
    without an id, stand behind all ids below 2 ** 62. A text that only such a row has goes where it isn't chosen.
    """
    p = common.free_prefix(docs.columns)
    id_, least, last, node_, kept_, chosen_ = (f"{p}{x}" for x in ("id", "least", "last", "node", "kept", "chosen"))
    own, digest = F.col(f"`{id_col}`").cast("long"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    told = docs.select(own.alias(id_), digest.alias("digest")).filter(F.col(id_).isNotNull())
    repeats = told.groupBy(id_).agg(F.min("digest").alias(least), F.max("digest").alias(last)).filter(F.col(least) < F.col(last)).drop(last)
    behind = F.xxhash64(own, digest).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    node = F.when(own.isNull() | (F.col(least) != digest), behind).otherwise(own)
    rows = docs.join(common.written(repeats, "repeats"), own == F.col(id_), "left").withColumn(node_, node).drop(id_, least)
    kept = near_duplicates(rows, rule, node_, text_col).filter("kept").select(F.col("doc_id").alias(kept_))
    nodes = rows.select(F.coalesce(own, F.col(node_)).alias(id_), node_).join(kept, F.col(node_) == F.col(kept_), "left_semi")
    chosen = nodes.groupBy(id_).agg(F.min(node_).alias(chosen_))
    stay = rows.join(chosen, F.col(node_) == F.col(chosen_), "left_semi")
    return stay.dropDuplicates([node_]).drop(node_)


#: The contract's links: three words and 0.85.
CONTRACT = NearDup(words=3, at_least=85, bands=20)


SQL = r"""
WITH RECURSIVE wd AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS s FROM wd, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(i) WHERE len(ws) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN sz sa ON sa.doc_id = a JOIN sz sb ON sb.doc_id = b WHERE 100 * m >= 85 * (sa.n + sb.n - m)),
rc(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT rc.doc_id, ln.b FROM rc JOIN ln ON ln.a = rc.r),
cp AS (SELECT doc_id, min(r) AS component_id FROM rc GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM cp LEFT JOIN sz USING (doc_id)
"""


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), CONTRACT)
