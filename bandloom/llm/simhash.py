"""Document fingerprints by SimHash, in DataFrame functions only.

A text's terms are its pairs of neighbouring words in lower case, the last word
alone closing them. Each occurrence hashes to 128 bits, weighs by its length
(short, common pairs weigh least) and votes on every bit; a fingerprint has the
bits that more than half of the weight has set. Votes are packed two to a long,
31 bits each, so 64 sums hold them for any text that Spark can hold, and they
are summed where the text lies before anything is shuffled.

Near fingerprints are found in permuted block tables: the bits are cut into
``radius + 2`` blocks, so fingerprints within the radius agree on two blocks at
least, and each pair of blocks keys a table. Equal fingerprints are one row of a
table, whatever the number of their documents.

Edge cases: a null or empty text has no terms, the fingerprint of zeros, and a
likeness of 1 to another such; equal texts have equal fingerprints; rows that
repeat a doc_id stand side by side in the order of their texts; null ids stand
last; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, HALVES = 128, (0, 1)
LANES = 0x0000000100000001
LOW, ALL = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[^{common.ASCII_SPACE[1:-1]}]+"), F.lit(0))


def terms(found: Column) -> Column:
    """Structs of each word and the next; the last has none."""
    return F.arrays_zip(found.alias("a"), F.slice(found, 2, F.greatest(F.size(found), F.lit(1))).alias("b"))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the fingerprint's halves f0 and f1, longs, for each distinct value of the keys; ``text`` is one for each."""
    split = rows.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("__words")).select(*keys, F.explode_outer(terms(F.col("__words"))).alias("__t"))
    a, b = F.col("__t")["a"], F.col("__t")["b"]
    weight = F.least(F.greatest(F.length(a) + F.coalesce(F.length(b), F.lit(0)) - 3, F.lit(1)), F.lit(8)).cast("long")
    votes = split.select(*keys, F.xxhash64(a, b).alias("__h0"), F.xxhash64(b, a, F.lit(1)).alias("__h1"), F.when(a.isNotNull(), weight).alias("__w"))
    lanes = [F.sum(F.shiftrightunsigned(f"__h{k}", j).bitwiseAND(F.lit(LANES)) * F.col("__w")).alias(f"__{k}_{j}") for k in HALVES for j in range(32)]
    sums = votes.groupBy(*keys).agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__all"), *lanes)
    out = []
    for k in HALVES:
        print_ = F.lit(0).cast("long")
        for j in range(32):
            both = F.coalesce(F.col(f"__{k}_{j}"), F.lit(0))
            for votes_, bit in ((both.bitwiseAND(F.lit(LOW)), j), (F.shiftrightunsigned(both, 32), j + 32)):
                print_ = print_.bitwiseOR(F.when(votes_ * 2 > F.col("__all"), _signed(1 << bit)).otherwise(F.lit(0).cast("long")))
        out.append(print_.alias(f"f{k}"))
    return sums.select(*keys, *out)


def as_hex(f0: Column, f1: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bits that differ."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def block_tables(radius: int) -> list[tuple[int, int]]:
    """The masks of f0 and f1 of each table: two of ``radius + 2`` blocks."""
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << k for k in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [((masks[i] | masks[j]) & ALL, (masks[i] | masks[j]) >> 64) for i, j in combinations(range(blocks), 2)]


def search(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """a0, a1, b0, b1, distance: each different fingerprint (f0, f1) of ``queries`` with each of ``prints`` that differs in at most ``radius`` bits, itself included.

    Fingerprints meet in the tables of the blocks that they agree on; a pair counts in the first of these only, so no
    pair comes twice and none is shuffled again.
    """
    tables = block_tables(radius)
    at = lambda name: F.inline(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"{name}0").bitwiseAND(_signed(m0)).alias("k0"), F.col(f"{name}1").bitwiseAND(_signed(m1)).alias("k1")) for t, (m0, m1) in enumerate(tables))))
    own, other = (x.select(F.col("f0").alias(f"{n}0"), F.col("f1").alias(f"{n}1")).dropna().distinct().select(f"{n}0", f"{n}1", at(n)) for x, n in ((queries, "a"), (prints, "b")))
    pairs = own.join(other, ["t", "k0", "k1"])
    pairs = pairs.withColumn("distance", distance((F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")))).filter(F.col("distance") <= radius)
    x0, x1 = F.col("a0").bitwiseXOR(F.col("b0")), F.col("a1").bitwiseXOR(F.col("b1"))
    agree = [(x0.bitwiseAND(_signed(m0)) == 0) & (x1.bitwiseAND(_signed(m1)) == 0) for m0, m1 in tables]
    first = F.coalesce(*(F.when(y, F.lit(t)) for t, y in enumerate(agree)))
    return pairs.filter(first == F.col("t")).select("a0", "a1", "b0", "b1", "distance")


def within(prints: DataFrame, radius: int = 6) -> DataFrame:
    """a0, a1, b0, b1, distance: all pairs of different fingerprints (f0, f1) that differ in at most ``radius`` bits, each once.

    Equal fingerprints are one row here; join back on the fingerprint to reach all that have it.
    """
    return search(prints, prints, radius).filter("a0 < b0 OR (a0 = b0 AND a1 < b1)")


#: Buckets for each shuffle partition, and buckets at most.
SHARE, MOST_BUCKETS = 4, 8192


def bucket_cuts(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that cut the rows into about ``SHARE`` times the session's shuffle partitions equal parts, however they lie.

    Spark's range partitioning of the ids alone finds them, from a sample of bounded size; the driver sees the least id
    of each part. They only say which task orders which rows, and are worked out once.
    """
    n = min(MOST_BUCKETS, SHARE * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).repartitionByRange(n, id_col)
    least = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min(id_col).alias("least")).collect()
    return sorted({x["least"] for x in least})[1:]


def bucket_of(id_: Column, cuts: list[int]) -> Column:
    """A number that rises with the id; null ids stand lowest."""
    inside = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= id_)) if cuts else F.lit(0)
    return F.when(id_.isNull(), F.lit(0)).otherwise(inside + 1).cast("long")


def chained(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, place, doc_id, text of each row, and next_bucket, next_place, next_text of the one after it by descending id.

    Rows are ordered within buckets of about equal size, in windows that spill. The first text of a bucket stands once
    more at the end of the bucket before it. Buckets are dealt out by range, which evens out the tasks, and serves all
    that is grouped by bucket later. The driver sees one id for each bucket, of which there are ``MOST_BUCKETS`` at most.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("bucket", bucket_of(F.col("doc_id"), bucket_cuts(source, "doc_id")))
    firsts = sorted(((r["bucket"], r["first"]) for r in source.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()), reverse=True)
    after = [(a[0], *b) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    after = F.broadcast(spark.createDataFrame(after, "before long, later_bucket long, first long"))
    same = (F.col("bucket") == F.col("later_bucket")) & F.col("doc_id").eqNullSafe(F.col("first"))
    heads = source.join(after, same).groupBy(F.col("before").alias("bucket"), "later_bucket").agg(F.max("text").alias("text"))
    both = source.unionByName(heads, allowMissingColumns=True).repartitionByRange("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("later_bucket").asc_nulls_first(), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    lead = lambda c, name: F.lead(c).over(order).alias(name)
    rows = both.select("*", F.row_number().over(order).alias("place"), lead("text", "next_text"), lead("later_bucket", "next_bucket")).filter("later_bucket is null")
    return rows.select(
        "bucket", "place", "doc_id", "text",
        F.coalesce("next_bucket", "bucket").alias("next_bucket"),
        F.when(F.col("next_bucket").isNull(), F.col("place") + 1).otherwise(F.lit(1)).alias("next_place"),
        "next_text",
    )


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: for ids divisible by 20, how many other fingerprints of all documents differ in at most 3 bits."""
    docs = common.table(spark, sf_dir, "documents")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    place = lambda name: (F.col(f"{name}bucket") * F.lit(1 << 33) + F.col(f"{name}place")).alias(f"{name}key")
    rows = chained(docs, "doc_id", "text").select(
        "bucket", place(""), place("next_"), "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"),
    )
    keys = ["bucket", "key", "next_key", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    both = rows.select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))))
    prints = fingerprints(both, [*keys, "which"])
    of = lambda k, which: F.max(F.when(F.col("which") == which, F.col(f"f{k}")))
    prints = prints.groupBy(*keys).agg(*(of(k, which).alias(f"{name}{k}") for which, name in enumerate(("own", "edited")) for k in HALVES))
    prints = common.checkpointed(prints)
    later = prints.select(F.col("key").alias("next_key"), F.col("own0").alias("later0"), F.col("own1").alias("later1"))
    halves = lambda name: tuple(F.col(f"{name}{k}") for k in HALVES)
    like = lambda a, b: (1 - distance(halves(a), halves(b)) / F.lit(float(BITS))).cast("double")
    asked = F.col("doc_id") % 20 == 0
    own = prints.select("doc_id", F.col("own0").alias("f0"), F.col("own1").alias("f1"))
    near = search(own.filter(asked), own, 3).groupBy(F.col("a0").alias("own0"), F.col("a1").alias("own1")).agg((F.count("*") - 1).alias("n_near"))
    return prints.join(later, "next_key").join(near, ["own0", "own1"], "left").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_hex(*halves("own")).alias("fingerprint"), as_hex(*halves("edited")).alias("edited_fingerprint"),
        like("own", "edited").alias("near_edited"), like("own", "later").alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"),
    )
