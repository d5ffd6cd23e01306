"""The training-data operators on odd input: white space, special strings, very long values, clashing names."""

import collections
import hashlib
import random

import public_tokenizers
import pytest

from bandloom.llm import html_text, near_dup, packing, quality_rules, queries, secret_scan, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF, 0x180E)]
ATOMS = SPACES * 2 + ["\n", "\n", " ", " ", "a", "the", "don't", "'s", "'ll", ".", ",", "!", "?;:", "123", "é", "日本", "🙂", "\x00", "<|endoftext|>", "<|endoftext|", "x" * 60, "Ünï", "́", "‍", "ſ"]


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_are_the_librarys_ids(seed):
    import numpy as np
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    rng = random.Random(seed)
    counts, ids = token_counts.Encoder(PATH, False), token_counts.Encoder(PATH, True)
    for _ in range(100):
        texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(40))) for _ in range(20)]
        expected = [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
        assert [sum(x) for x in counts.pieces(texts)] == list(map(len, expected))
        assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in ids.pieces(texts)] == expected


def test_no_break_spaces_between_words():
    """A no-break space joins the line break before it in one token, so such a piece can't share a line of pieces."""
    texts = ["mot ! autre ? a b", "a\n　b\n\u0085c", " ", "\n "]
    own = token_counts.Encoder(PATH, False)
    assert [sum(x) for x in own.pieces(texts)] == [len(x) for x in own.call(texts)]


def test_batches_are_of_bytes():
    texts = ["é" * 300, "a" * 300] * 4
    assert [len(x) for x in token_counts.by_bytes(texts, 600)] == [1, 2, 2, 2, 1]


@pytest.mark.parametrize("unit", ["", "猫犬" * 12])
def test_remembered_pieces_are_bounded_in_number_and_bytes(unit):
    import sys

    own = token_counts.Encoder(PATH, True)
    own.encode_words = lambda words: [(w * (4 if unit else 1)).encode("utf-16-le") for w in words]
    most = 0
    for at in range(0, 1_700_000 if not unit else 500_000, 20_000):
        own.pieces([" ".join(f"{unit}{i:08x}" for i in range(at, at + 20_000))])
        held = (own.memory, own.older)
        if at % 100_000 == 0:
            most = max(most, sum(sys.getsizeof(x) + sum(map(sys.getsizeof, x)) + sum(map(sys.getsizeof, x.values())) for x in held))
    assert most < 200_000_000


def test_few_remembered_pieces_give_the_same_ids():
    rng = random.Random(3)
    own, small = token_counts.Encoder(PATH, True), token_counts.Encoder(PATH, True, 20)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + rng.choice(["", ".", ",", "é;"]) for _ in range(30)) for _ in range(3)]
        assert [b"".join(x) for x in small.pieces(texts)] == [b"".join(x) for x in own.pieces(texts)]
    assert len(own.memory) > len(small.memory) and not set(small.memory) & set(small.older)


def test_texts_go_in_slices_of_a_megabyte():
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array(range(100)), "text": ["a" * 100_000] * 100})
    parts = list(token_counts.texts_of(iter([batch])))
    assert sum(len(texts) for _, texts in parts) == 100 and max(sum(map(len, texts)) for _, texts in parts) <= 1_200_000


def test_workers_forget_what_other_stages_had_them_remember(spark):
    docs = spark.range(8, numPartitions=8).selectExpr("id AS doc_id", "concat('pwd: x9Kq2vLw7t', id, ' some words of text ', id) AS text")

    def held(batches):
        import time

        time.sleep(0.3)
        for batch in batches:
            yield batch.from_pydict({"words": [len(near_dup._WORDS)], "ranks": [len(secret_scan._RANKS)], "encoders": [len(token_counts._OWN)]})

    def state():
        return spark.range(4, numPartitions=4).mapInArrow(held, "words long, ranks long, encoders long").collect()

    near_dup.sign(docs, near_dup.NearDup(), "doc_id", "text").collect()
    assert any(r.words for r in state())
    secret_scan.redact(docs).collect()
    rows = state()
    assert any(r.ranks for r in rows) and not any(r.ranks and r.words for r in rows)
    packing.pieces(docs, PATH, 64, 0).collect()
    rows = state()
    assert any(r.encoders for r in rows) and not any(r.encoders and (r.words or r.ranks) for r in rows)


def test_memory_does_not_grow_with_a_value():
    import random as rnd
    import tracemalloc

    model = secret_scan.GuessModel()
    secret_scan.ranks(model)
    value = "".join(rnd.Random(1).choices("abcdefgh", k=1_000_000))
    tracemalloc.start()
    assert secret_scan.cost(value, model, model.threshold) >= model.threshold
    assert secret_scan.cost("password" * 2_000, model, model.threshold) < model.threshold
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


CLASHES = ["kept", "component_id", "sequence_id", "offset", "__deal", "__kept_id", "__id", "__node", "__chosen", "piece", "start", "length", "n_tokens", "key", "u", "v", "node", "digest", "text_hash", "band", "main_text", "Sequence_ID2"]


def clashing(spark, texts):
    """documents with further columns that have the names of the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(CLASHES))) for i, t in enumerate(texts)], schema)


def test_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(80)) + "." for _ in range(6)]
    texts = [*prose, prose[0], prose[1] + " end pwd: x9Kq2vLw7tZ.", None, ""]
    docs = clashing(spark, texts)
    for made in (quality_rules.clean(docs), near_dup.keep_one(docs), secret_scan.redact(docs)):
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[c] == i for r in rows for i, c in enumerate(CLASHES))
    assert {r["doc_id"] for r in near_dup.keep_one(docs).collect()} == {0, 1, 2, 3, 4, 5, 8, 9}
    packed = packing.pack(docs.select("*", (docs["n_chars"] % 50 + 1).alias("size")), 64, "size")
    assert packed.columns[-2:] == ["sequence_id", "offset"] and packed.columns.count("offset") == 1 and packed.count() == len(texts)
    pages = docs.withColumnRenamed("text", "html")
    assert "main_text" in html_text.extract(pages).columns and html_text.extract(pages).count() == len(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op1_quality_rules", "op2_token_counts", "op3_best_fit_packing", "op6_minhash_near_dedup", "op7_byte_level_bpe", "op8_secret_scans", "op9_document_fingerprints", "op10_lm_scoring"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["doc_id"] for r in rows} == set(range(len(texts))), name


def test_queries_against_the_libraries(spark, tmp_path):
    """The queries' own columns, on odd texts, against the libraries and counting by hand."""
    import base64
    import zlib

    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = [None, "", " ", *("".join(rng.choice(ATOMS) for _ in range(rng.randrange(60))) for _ in range(40)), "word " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    own = Tokenizer.from_file(PATH)
    ids = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = run("op2_token_counts")
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in counts.items()} == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 1024) for i, t in enumerate(texts)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in run("op7_byte_level_bpe").items():
        expected = other.encode_ordinary(texts[i] or "")
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    rows = queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect()
    places = collections.defaultdict(list)
    for i in ids:
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        whole = [*ids[i], 0]
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and sum(n for _, _, n, _ in pieces) == len(whole)
        for _, a, n, crc in pieces:
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in whole[a : a + n])) and 0 < n <= 2048
        assert len(whole) > 2048 or len(pieces) == 1
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    near = run("op6_minhash_near_dedup")
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        n = len({tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))}) if words else 0
        assert near[i]["n_shingles"] == n and near[i]["kept"] == (near[i]["component_id"] == i)
    measured = run("op1_quality_rules")
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert measured[i]["n_words"] == len(words) and measured[i]["word_chars"] == sum(len(w.decode()) for w in words)
        assert measured[i]["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")


def test_urls_by_the_query(spark, tmp_path):
    urls = ["http://a.Example.COM/en/x?q#f", "https://www.example.com/en/", "ftp://b.net/es/1", "http://b.net/es", "x", None, "://h", "http://net/fr/", "http://xnet/fr/"]
    spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.QUERIES["op5_url_filters"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("a.example.com", "/en/x", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 2: ("b.net", "/es/1", "net/es/", "block"),
        3: ("b.net", "/es", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h", "", None, "allow"), 7: ("net", "/fr/", "net/fr/", "block"), 8: ("xnet", "/fr/", None, "allow"),
    }


def test_null_ids_of_near_duplicates(spark):
    rows = [(None, "a b c d"), (2, "a b c d"), (None, "x y z"), (None, "x y z"), (None, None), (4, "q")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.CONTRACT).collect()
    assert sorted(((r["doc_id"] or 0), (r["component_id"] or 0), r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 2, False), (2, 2, True), (4, 4, True)]
