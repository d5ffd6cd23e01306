"""Secret scans: fixed patterns, and guess costs for values in credential contexts.

Three patterns give the base spans. Beyond them, a value that stands where a
credential would (``pwd: ...``, ``auth_key=...``, ``Bearer ...``; a listed word
or ``key`` may be one part of a longer name) is a secret if
it would take many guesses: the value is cut into words, dates, repeats,
keyboard walks, runs of the alphabet and brute-force spans, and the cheapest
cut, found by dynamic programming, is its cost in powers of ten. So
``pwd=password123`` stays and ``pwd=x9Kq2vLw7t`` goes. Only a value that lies
within another span as a whole isn't looked at: where a pattern stops inside of
it, the whole value gets a span beside the pattern's. An address (``https://``)
is no value.

Words come from the vocabularies of public tokenizers, whose order follows how
often a piece occurs in several languages, and from the words that people choose
most. A brute-force span costs as much as its length in characters of the
classes that it uses. The costs are worked out along the value, with only those
in reach of a segment that is still open, and it ends where no cut can stay
below the bound, so memory doesn't grow with the value.

A document is scanned alone, in one narrow pass over its whole text.

Edge cases: a null or empty text has no spans; repeated rows are each scanned;
spans that start together stand in the order of their kinds; very long values
cost time in proportion to their length at most; columns other than the text
(and ``n_chars``) pass through :func:`redact` untouched, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex", "guess")


def _either(word: str) -> str:
    """ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(f"""({"|".join(_either(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("[0-9a-f]{32}")
ASSIGN_KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words that name a credential at the end of any name, and those that do so only as a part of their own.
ENDS = "|".join(_either(w) for w in ("passphrase", "passcode", "password", "passwd", "pwd", "secret", "credentials", "credential", "api_key", "apikey", "api-key", "access_key", "private_key"))
PARTS = "|".join([ENDS, *(_either(w) for w in ("pass", "token", "auth", "client_id", "login"))])
#: A name and a separator, whatever the name.
NAMED = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?[ \t]*+(?:=>|[:=])[ \t]*+["']?""")
#: Names of credentials: they end in a listed word, or have one, or ``key``, as a part.
CREDENTIAL = re.compile(
    f"""(?:{ENDS})$|(?:^|[0-9_-]|(?<=[a-z])(?=[A-Z]))(?:{PARTS})(?:$|[0-9_-]|(?<=[a-z])(?=[A-Z]))"""
    f"""|[0-9_-]{_either("key")}(?:$|[0-9_-])|(?<=[a-z0-9])Key(?:$|[0-9_-]|(?=[A-Z]))"""
)
VALUE = re.compile(r"""[^\s"'<>,;(){}\[\]]+""")
#: What stands between an opening quote and its partner on the same line, with escaped quotes.
QUOTED = {q: re.compile(rf"((?:[^{q}\\\n]|\\[^\n])+){q}") for q in "\"'"}
BEARER = re.compile(f"(?:{_either('bearer')}|{_either('basic')}) ([A-Za-z0-9+/_.=~-]{{16,}})")
CONTEXT_KEYS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key", b"client", b"login", b"bearer", b"basic")

#: Words that people choose, the most chosen first.
WORDS = tuple(
    """password qwerty dragon monkey letmein master shadow sunshine princess football baseball welcome login admin
    iloveyou hello freedom whatever trustno superman batman starwars summer winter spring autumn secret test guest
    root user pass love money flower cookie chocolate ginger pepper charlie michael jordan thomas daniel george
    jennifer jessica ashley hunter killer soccer hockey ranger tigger buster harley maggie computer internet
    samsung google apple orange banana purple silver golden diamond phoenix thunder cheese coffee pizza london
    paris berlin madrid monday friday sunday january march april june july august october november december
    the and you are for with this that from have changeme default example temp demo access server database
    system public private token api key none null true false undefined string value your here placeholder""".split()
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@83610!57$2", "aabegioistsz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")


@dataclass(frozen=True)
class GuessModel:
    """The cost model. ``threshold``: powers of ten of guesses from which a value is a secret. At 11.5 some 99 of 100
    random strings of ten letters and digits are, and no word of the vocabularies and few pairs of words.

    ``least``: the shortest value that is looked at; ``phrase``: how many words a quoted value with blanks has at most, as
    more are prose, of which only the first is looked at; ``join``: powers of ten for each further segment of a cut; ``words``: words that people choose, best known first;
    ``files``: vocabularies of tokenizers, commonest pieces first, which every executor has; ``unit``: the longest unit
    of a repeat.
    """

    threshold: float = 11.5
    least: int = 6
    phrase: int = 8
    join: float = 0.3
    words: tuple[str, ...] = WORDS
    files: tuple[str, ...] = (public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    unit: int = 32


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            for yy in (y - 1, y, y + 1):
                for xx in (x - 1, x, x + 1):
                    if 0 <= yy < len(ROWS) and 0 <= xx < len(ROWS[yy]) and (yy, xx) != (y, x):
                        near.setdefault(c, set()).add(ROWS[yy][xx])
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()
#: Characters of a class, and how many it has: small and capital letters, digits, other ASCII, other letters and signs.
CLASSES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[\\x00-\\x7f]"), 33), (re.compile("", re.S), 160))
#: log10 of the characters that each set of classes has.
ALPHABET = [math.log10(max(2, sum(n for i, (_, n) in enumerate(CLASSES) if m >> i & 1))) for m in range(1 << len(CLASSES))]
_RANKS: dict[tuple, tuple[dict[str, int], int]] = {}


def vocabulary(path: str) -> list[str]:
    """The words and pieces of three letters or more in a tokenizer's file, in the file's order, in small letters."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            held = json.load(f)["model"]["vocab"]
            pieces = [x.removesuffix("</w>") for x in sorted(held, key=held.get)]
        else:
            pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip()]
    words = (x.strip().lower() for x in pieces)
    return list(dict.fromkeys(x for x in words if len(x) > 2 and x.isalpha()))


def _hold() -> None:
    """Not in the tasks' own functions, as what those name of this module is copied with them, and so would be the ranks."""
    common.hold("secret_scan", _RANKS.clear)


def ranks(model: GuessModel) -> tuple[dict[str, int], int]:
    """Each word's best rank, 0 for what words begin with (three letters or more), and the longest word's length; read once by a worker."""
    key = (model.words, model.files)
    if key not in _RANKS:
        found: dict[str, int] = {}
        for words in (model.words, *map(vocabulary, model.files)):
            for i, w in enumerate(words, 1):
                found[w] = min(i, found.get(w, i))
        longest = max(map(len, found), default=0)
        begins = {w[:k] for w in found for k in range(3, len(w))}
        _RANKS[key] = dict.fromkeys(begins, 0) | found, longest
    return _RANKS[key]


def segments(value: str, model: GuessModel) -> Iterator[list[tuple[int, str, float]]]:
    """For each place of the value, the end, kind and cost of every segment from there that isn't brute force."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain, (rank, longest) = low.translate(LEET), ranks(model)
    repeats = re.finditer(rf"(.{{1,{model.unit}}}?)\1+", value, re.S)
    repeat = next(repeats, None)
    run_from = walk_from = 0
    for i in range(n):
        found: list[tuple[int, str, float]] = []
        if low[i].isalpha() or plain[i].isalpha():
            for j in range(i + 3, min(n, i + longest) + 1):
                own, leet = low[i:j], plain[i:j]
                form, extra = (own, 0.0) if rank.get(own) else (leet, 0.5)
                if rank.get(form):
                    part = value[i:j]
                    cased = 0.0 if part == own else 0.3 if part[0].isupper() and part[1:] == low[i + 1 : j] or part.isupper() else 1.0
                    found.append((j, "word", math.log10(rank[form] + 1) + extra + cased))
                if own not in rank and leet not in rank:
                    break
        if value[i].isdigit() and (m := DATE.match(value, i)):
            found.append((m.end(), "date", 2.1 if m.end() - i <= 4 else 4.6))
            if m.end() - i > 4 and YEAR.match(m[0]):
                found.append((i + 4, "date", 2.1))
        if i >= run_from and i + 2 < n:
            step = ord(low[i + 1]) - ord(low[i])
            j = i + 1
            while j < n and abs(step) <= 1 and ord(low[j]) - ord(low[j - 1]) == step and low[j].isalnum():
                j += 1
            if j - i >= 3:
                found.append((j, "run" if step else "repeat", (0.6 if low[i] in "a10z9" else 1.4) + math.log10(j - i)))
            run_from = max(i + 1, j - 1)
        if i >= walk_from and i + 3 < n:
            j, turns, way = i + 1, 0, 0
            while j < n and low[j] in NEAR.get(low[j - 1], ""):
                now = ord(low[j]) - ord(low[j - 1])
                turns, way = turns + (now != way), now
                j += 1
            if j - i >= 4:
                found.append((j, "walk", 1.7 + 0.3 * (j - i) + 0.3 * turns))
            walk_from = max(i + 1, j - 1)
        if repeat is not None and repeat.start() == i:
            unit, times = repeat[1], (repeat.end() - i) // len(repeat[1])
            if repeat.end() - i >= 3:
                found.append((repeat.end(), "repeat", (cost(unit, model) if len(unit) > 1 else 1.0) + math.log10(times)))
            repeat = next(repeats, None)
        yield found


YEAR = re.compile(r"(?:19|20)\d\d")


def cost(value: str, model: GuessModel, enough: float = math.inf) -> float:
    """The least log10 of guesses over all cuts of the value; a cost of ``enough`` or more may be any such number.

    A cut of k segments costs the sum of theirs and k - 1 joins. Brute-force spans cost their length times the log10 of
    how many characters their classes have.
    """
    best, ahead = 0.0, {}  # of cuts that end here; of cuts that end further on
    brute = [math.inf] * len(ALPHABET)  # of cuts that are in a brute-force span of these classes here
    for i, found in enumerate(segments(value, model)):
        join = model.join if i else 0.0
        for j, _, c in found:
            total = best + join + c
            if total < ahead.get(j, math.inf):
                ahead[j] = total
        own = next(k for k, (x, _) in enumerate(CLASSES) if x.match(value[i]))
        least = math.inf
        for m in _WITH[own]:
            brute[m] = min(brute[m], best + join) + ALPHABET[m]
            least = min(least, brute[m])
        for m in _WITHOUT[own]:
            brute[m] = math.inf
        best = min(least, ahead.pop(i + 1, math.inf))
        if best >= enough and all(c >= enough for c in ahead.values()) and all(c >= enough for c in brute):
            return best
    return best


_WITH = [[m for m in range(len(ALPHABET)) if m >> k & 1] for k in range(len(CLASSES))]
_WITHOUT = [[m for m in range(len(ALPHABET)) if not m >> k & 1] for k in range(len(CLASSES))]


ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#@]*(?:[/?#]|$)")


def _reach(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts of spans in order, and how far the spans up to each reach."""
    order = sorted((a, b) for a, _, b in spans)
    return [a for a, _ in order], list(accumulate((b for _, b in order), max))


def value_at(text: str, at: int, model: GuessModel) -> re.Match | None:
    """The value that begins here: up to the quote's partner where one opens right before, else up to a blank, quote, comma or bracket."""
    quoted = QUOTED[text[at - 1]].match(text, at) if text[at - 1] in QUOTED else None
    if quoted and len(quoted[1].split()) <= model.phrase:
        return quoted
    return VALUE.match(text, at)


def scan(text: str | None, model: GuessModel = GuessModel()) -> list[tuple[int, int, int]]:
    """start, number in KINDS and end of every span, in order."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(k in low for k in ASSIGN_KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if any(k in low for k in CONTEXT_KEYS):
        for pattern in (NAMED, BEARER):
            starts, upto = _reach(found)
            for m in pattern.finditer(text):
                if pattern is NAMED:
                    m = value_at(text, m.end(), model) if CREDENTIAL.search(m[1]) else None
                    if m is None:
                        continue
                a = m.start(m.re.groups)
                value = m[m.re.groups] if m.re in QUOTED.values() else m[m.re.groups].rstrip(".?:")
                b = a + len(value)
                at = bisect_right(starts, a)
                if len(value) >= model.least and not (at and upto[at - 1] >= b) and not ADDRESS.match(value) and cost(value, model, model.threshold) >= model.threshold:
                    found.append((a, 3, b))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, model: GuessModel = GuessModel(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of kind, start and end (code points, end exclusive), for each row."""
    source = docs.select(docs[id_col], docs[text_col])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(x, model)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, model: GuessModel = GuessModel(), text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[redacted]") -> DataFrame:
    """All rows and columns, with every span of the text replaced by the mask, and its length corrected."""
    names = docs.columns
    at, length = common.place_of(names, text_col), common.place_of(names, length_col)

    def masked(text: str | None) -> str | None:
        spans = scan(text, model)
        if not spans:
            return text
        out, upto = [], 0
        for a, _, b in spans:
            if a >= upto:
                out += [text[upto:a], mask]
            upto = max(upto, b)
        return "".join(out) + text[upto:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = list(map(masked, old))
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                was = columns[length].to_pylist()
                columns[length] = pa.array([w if a == b else len(b) for a, b, w in zip(old, new, was, strict=True)], pa.int64()).cast(columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(common.table(spark, sf_dir, "documents"))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
