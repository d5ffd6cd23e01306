"""Quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text goes with them. A
document is judged alone, so this is one narrow pass: no shuffle, no state
beyond a batch.

Edge cases: a null or empty text has no words, so it fails the base rule and is
rejected; repeated rows are each judged, and equal figures at a bound pass it;
a text of any length is judged whole, in memory of a small multiple of its size; columns other than the text (and
``n_chars``, which follows it) pass through :func:`clean` untouched, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
#: Characters that prose has few of.
ODD = b"#*$%&|<>!?=~^_{}[]\\/@+"
BARS = re.compile(r"[\x20\x09-\x0D][|»›•·>/][\x20\x09-\x0D]")
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|copyright ©|terms (?:of|and) (?:use|service|conditions)|privacy policy|cookie policy|"
    r"(?:we|site|website) uses? cookies|accept (?:all )?cookies|skip to (?:main )?content|sign (?:in|up) (?:now|here|to)|"
    r"subscribe to (?:our|the)|click here|read more|share (?:this|on) |follow us|back to top|enable javascript|lorem ipsum"
)
#: One of these is in every line that the two patterns can match, so most long lines aren't searched; the last are letters that fold to ASCII ones.
BAR_BYTES = tuple(x.encode() for x in "|»›•·>/")
PHRASE_BYTES = tuple(x.encode() for x in ("rights reserved", "copyright", "terms ", "policy", "cookies", "skip to", "sign ", "subscribe", "click here", "read more", "share ", "follow us", "back to top", "javascript", "lorem", "\u017f", "\u212a", "\u0131", "\u0130"))


@dataclass(frozen=True)
class Rules:
    """Bounds of the line rules and of the document rule.

    odd_share: odd punctuation among a line's characters, at most.
    run_share: words that end in two or more marks (``!!``, ``###``), at most this share.
    upper_share: words in capitals, at most, in lines of ``min_words`` or more.
    bars: spaced separators of menus for each word, at most.
    distinct_share, stutter_share: distinct words at least, and words equal to the
    one before them at most, in lines of ``repeat_words`` or more.
    long_words: beyond this length the distinct words asked for grow with the square root of the line's.
    Menus and boilerplate phrases are looked for in every line; one with
    ``repeat_words`` or more needs a phrase for each run of so many words, so
    prose that names one is spared.
    lost_share: share of a document's non-white characters that it may lose.
    min_doc_words, repeat_percent: the base rules for whole documents.
    """

    odd_share: float = 0.12
    run_share: float = 0.4
    upper_share: float = 0.7
    bars: float = 0.25
    min_words: int = 3
    distinct_share: float = 0.25
    stutter_share: float = 0.3
    repeat_words: int = 12
    long_words: int = 400
    lost_share: float = 0.5
    min_doc_words: int = 50
    repeat_percent: int = 50


MARKS = (b"!!", b"??", b"**", b"##", b"$$", b"%%", b"&&", b"~~", b"==")


def line_fails(line: bytes, words: list[bytes], r: Rules) -> str:
    """The first rule that the line breaks, or the empty string."""
    n = len(words)
    if not n:
        return ""
    odd = len(line) - len(line.translate(None, ODD))
    if odd:
        if odd > r.odd_share * len(line) and odd > 2:
            return "punctuation"
        if n >= r.min_words and sum(w.endswith(MARKS) for w in words) > r.run_share * n:
            return "punctuation"
        if b"|" in line or b">" in line or b"/" in line:
            if sum(w in (b"|", b">", b"/") for w in words) > r.bars * n:
                return "navigation"
    if n >= r.min_words and sum(map(bytes.isupper, words)) > r.upper_share * n:
        return "punctuation"
    if n >= r.repeat_words:
        if len(set(words)) < r.distinct_share * min(n, math.sqrt(n * r.long_words)):
            return "boilerplate"
        if sum(map(bytes.__eq__, words, words[1:])) > r.stutter_share * n:
            return "boilerplate"
        low = line.lower()
        menu, told = any(x in line for x in BAR_BYTES), any(x in low for x in PHRASE_BYTES)
        if not (menu or told):
            return ""
    said = line.decode("utf-8", "surrogatepass")
    if len(BARS.findall(said)) > r.bars * n:
        return "navigation"
    if BOILERPLATE.search(said) and sum(1 for _ in BOILERPLATE.finditer(said)) * r.repeat_words > n:
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judge(text: str | None, r: Rules) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_failed, cleaned text."""
    text = text or ""
    whole = text.encode("utf-8", "surrogatepass")
    words = whole.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(whole) - len(whole.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    seen: set[bytes] = set()
    dup = failed = lost = 0
    left = []
    for line in whole.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, own, r):
                failed += 1
                lost += sum(map(len, own))
                continue
        left.append(line)
    base_failed = n < r.min_doc_words or 100 * repeats > r.repeat_percent * n
    kept = not base_failed and lost <= r.lost_share * sum(map(len, words))
    return n, chars, symbols, dup, repeats, base_failed, kept, failed, b"\n".join(left).decode("utf-8", "surrogatepass") if failed else text


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_failed long"
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]


def measure(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the base figures and the verdict."""
    source = docs.select(docs[id_col], docs[text_col])

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x, rules)[:8] for x in batch.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(x.split()[0] for x in MEASURES.split(", "))])

    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, f"`{id_col}` {kind}, {MEASURES}")


def clean(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents, all columns as they are but for the text, without its failing lines, and its length."""
    names = docs.columns
    at, length = common.place_of(names, text_col), common.place_of(names, length_col)

    @common.quietly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x, rules) for x in batch.column(at).to_pylist()]
            stay = [i for i, x in enumerate(rows) if x[6]]
            columns = [c.take(pa.array(stay, pa.int64())) for c in batch.columns]
            columns[at] = pa.array([rows[i][8] for i in stay], columns[at].type)
            if length is not None:
                columns[length] = pa.array([len(rows[i][8]) for i in stay], pa.int64()).cast(columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


_W = r"[^\x20\x09-\x0D]+"
_R = Rules()
SQL = f"""
WITH wd AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
wp AS (SELECT doc_id, i AS p, ws[i] AS w, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM wd, unnest(range(1, len(ws) + 1)) AS u(i)),
wc AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS times FROM wp WHERE w3 IS NOT NULL),
rp AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM wc, (VALUES (0), (1), (2)) AS v(k) WHERE times > 1 GROUP BY 1),
ls AS (SELECT doc_id, i AS ln, string_split(text, chr(10))[i] AS line FROM wd, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
lw AS (SELECT doc_id, ln, line, regexp_extract_all(line, '{_W}') AS ws FROM ls),
lx AS (SELECT doc_id, ln, i, ws[i] AS w, i > 1 AND ws[i] = ws[i - 1] AS again FROM lw, unnest(range(1, len(ws) + 1)) AS u(i)),
la AS (SELECT doc_id, ln, count(*) AS n, sum(strlen(w)) AS bytes, count(DISTINCT w) AS kinds, count(*) FILTER (again) AS stutter,
  count(*) FILTER (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS upper,
  count(*) FILTER (regexp_matches(w, '(!!|\\?\\?|\\*\\*|##|\\$\\$|%%|&&|~~|==)$')) AS marked, count(*) FILTER (w IN ('|', '>', '/')) AS menu FROM lx GROUP BY 1, 2),
lo AS (SELECT la.*, line, len(regexp_extract_all(line, '[#*$%&|<>!?=~^_{{}}\\[\\]\\\\/@+]')) AS odd, len(regexp_extract_all(line, '{BARS.pattern}')) AS bars,
  len(regexp_extract_all(line, '{BOILERPLATE.pattern}')) AS boiler FROM la JOIN ls USING (doc_id, ln)),
lf AS (SELECT *, odd > 2 AND odd > CAST({_R.odd_share} AS DOUBLE) * strlen(line) OR n >= {_R.min_words} AND marked > CAST({_R.run_share} AS DOUBLE) * n OR menu > CAST({_R.bars} AS DOUBLE) * n
  OR n >= {_R.min_words} AND upper > CAST({_R.upper_share} AS DOUBLE) * n
  OR n >= {_R.repeat_words} AND (kinds < CAST({_R.distinct_share} AS DOUBLE) * least(n, sqrt(n * {_R.long_words})) OR stutter > CAST({_R.stutter_share} AS DOUBLE) * n)
  OR bars > CAST({_R.bars} AS DOUBLE) * n OR boiler * {_R.repeat_words} > n AS fails FROM lo),
ld AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_failed, coalesce(sum(bytes) FILTER (fails), 0) AS lost, sum(bytes) AS bytes FROM lf GROUP BY 1),
al AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_failed, 0) AS n_lines_failed, coalesce(lost, 0) AS lost, coalesce(bytes, 0) AS bytes
  FROM wd LEFT JOIN rp USING (doc_id) LEFT JOIN ld USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_R.min_doc_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_doc_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words) AND lost <= CAST({_R.lost_share} AS DOUBLE) * bytes AS kept, n_lines_failed FROM al
"""


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return measure(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
