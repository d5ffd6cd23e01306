"""Main text of web pages by the distribution of text over lines.

A page becomes a sequence of lines, one for each block that its markup opens.
Lines of menus, headers, footers, sidebars, notices, adverts, forms and
comments carry no text, and neither does a line that is all links, but they
keep their places; tags with nothing between them make no lines. The lengths of
text are summed over a sliding window of lines; text surges where the sum rises
over a bound, dives where the window is empty again, and what lies between is
kept, with up to a window of short lines right before it. This holds on every
page. Where all text is short the bound is a share of its largest sum. Text
inside an ``article`` or ``main`` element weighs more; windows don't reach over
the element's ends, and text outside of it is kept where it surges by itself.
An article inside a hidden element is hidden with it, if that element closes;
``main`` ends what only a class, an id or a role hides.

A page is read alone, in one narrow pass. Nothing is collected or shuffled.

Edge cases: null, empty and text-free pages give an empty text; an element
that never closes ends with its page, but paragraphs, list items and cells end
where the next one or their list ends; a quote that never closes ends with its
tag; a cut-off tag or comment at the end is dropped; repeated rows are each
read, whatever their order; a page of any length is read whole, in time and
memory of a small multiple of its size; other columns aren't touched, and one that is named
like the result gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Comments, raw text up to its end or the page's, embedded content (which :func:`tokens_of` skips where it closes), declarations, tags. A quote
#: in a tag that doesn't close before white space, ``/`` or ``>`` is no quote, and the tag ends at its first ``>``.
EMBEDDED = "template|svg|select|object|canvas|math|audio|video"
TAG = r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"<>]*\"|\"[^\"]*\"(?=[\s/>])|'[^'<>]*'|'[^']*'(?=[\s/>]))*+(?=>|\Z)|[^>]*)(?:>|\Z)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|textarea|iframe)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)" + rf"|<(?P<embed>{EMBEDDED})\b[^>]*>|<[!?][^>]*(?:>|\Z)|{TAG}",
    re.S | re.I,
)
TAG_ALONE = re.compile(TAG, re.S | re.I)
EMBED_END = re.compile(rf"</({EMBEDDED})\s*>", re.I)
#: Elements whose text never belongs to the article.
ASIDE = frozenset("nav header footer aside form button dialog menu figcaption label option title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that open a new line.
BLOCK = frozenset("p div article main section ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre figure hr address details summary body head html center fieldset".split()) | ASIDE | HEADINGS
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that end without a tag: what starts after them, and elements that hold them or stand in them.
SIBLINGS = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr", "tbody", "tfoot"])}
HOLDERS = frozenset("ul ol menu dl table div section article main body html aside nav header footer blockquote form details figure fieldset".split())
#: Words in the class and id names of blocks that aren't the article, and words that only place a block. A name counts if
#: it has one of the first and, parted at hyphens, underscores, digits and capitals, nothing else than both.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored sponsorship promo promos promotion
    promotions cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription comment comments commentlist respond
    replies disqus nav navbar navigation topnav subnav menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets related recommend recommended
    recommendations share shares sharebar sharing social footer header masthead toolbar pagination pager login signup search""".split()
)
PLACES = frozenset(
    """box boxes bar bars block blocks container wrap wrapper area section list lists item items inner outer main site page top bottom left right center
    middle global primary secondary tertiary button buttons link links icon icons media row rows col column panel slot unit form group post posts article
    articles story stories entry thread count body content text title heading small large mobile desktop sticky fixed sub the and us on""".split()
)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: With one of these a header is the article's own.
OWN = frozenset("article post entry story".split())
#: Elements that no class, id or role hides.
NEVER = HEADINGS | {"body", "html", "article", "main"}
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class LineBlocks:
    """window: lines summed together; surge: characters in a window from which text begins; link_share: share of a line's text in links from which it is a menu's;
    weight: how many characters one in an article or main element counts for; peak_share: text surges at this share of its largest sum, too."""

    window: int = 3
    surge: int = 80
    link_share: float = 0.6
    weight: int = 4
    peak_share: float = 0.5


@dataclass
class Line:
    text: str
    inside: bool
    off: bool


class Token(NamedTuple):
    """A piece of markup, from start to end; what has no name is skipped."""

    start: int
    end: int
    name: str | None
    ends: bool
    rest: str


def tokens_of(page: str) -> list[Token]:
    """The page's markup in order. Where embedded elements close is found once, so elements that never do cost nothing more."""
    out: list[Token] = []
    ends: dict[str, tuple[list[int], list[int]]] | None = None
    at = 0
    while m := TOKEN.search(page, at):
        if m["embed"]:
            if ends is None:
                ends = {}
                for x in EMBED_END.finditer(page, m.end()):
                    places = ends.setdefault(x[1].lower(), ([], []))
                    places[0].append(x.start())
                    places[1].append(x.end())
            starts, stops = ends.get(m["embed"].lower(), ([], []))
            i = bisect_left(starts, m.end())
            if i < len(starts):
                out.append(Token(m.start(), stops[i], None, False, ""))
                at = stops[i]
                continue
            m = TAG_ALONE.match(page, m.start())
        name = m["name"]
        out.append(Token(m.start(), m.end(), name.lower() if name is not None else None, bool(m["end"]), m["rest"] or ""))
        at = m.end()
    return out


def aside_name(value: str) -> bool:
    """Whether a class or id attribute names a block that isn't the article."""
    for token in value.split():
        parts = {x.lower() for x in PARTS.findall(token)}
        if parts & NAMES and parts <= NAMES | PLACES and not (parts & OWN and parts & NAMES == {"header"}):
            return True
    return False


def closing(tokens: list[Token]) -> set[int]:
    """Where the elements start that are closed again."""
    opened: dict[str, list[int]] = {}
    closed = set()
    for m in tokens:
        if m.name is not None:
            held = opened.setdefault(m.name, [])
            if not m.ends:
                held.append(m.start)
            elif held:
                closed.add(held.pop())
    return closed


def lines_of(page: str, rule: LineBlocks) -> list[Line]:
    """The page's lines with text, and one for each hidden block."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = total = 0
    off = ""  # the element that hides text, how deep it stands in itself, where it starts, whether by its name alone
    depth = begins = article = anchor = inner = 0  # inner: holders that are open in a hidden element that may end without a tag
    by_tag = False
    upto = 0
    tokens = tokens_of(page)
    closed: set[int] | None = None

    def close() -> None:
        nonlocal linked, total
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append(Line(text, article > 0, linked > rule.link_share * total and article == 0))
        parts.clear()
        linked = total = 0

    for m in tokens:
        if m.start > upto and not off:
            part = page[upto : m.start]
            parts.append(part)
            total += len(part)
            linked += len(part) if anchor else 0
        upto = m.end
        if m.name is None:
            continue
        name, ends = m.name, m.ends
        if name == "a":
            anchor = 0 if ends else 1
        elif name == "br" and not off:
            parts.append(" ")
        if off:
            if name in ("article", "main") and not ends and off != name:
                if closed is None:
                    closed = closing(tokens)
                if begins not in closed or name == "main" and not by_tag:
                    off, depth = "", 0  # what never closed ends here
            elif off in SIBLINGS:
                over = name == off if ends and not inner else False
                if over or not inner and (name in HOLDERS or off in ("td", "th") and name == "tr" if ends else name in SIBLINGS[off]):
                    lines.append(Line("", article > 0, True))
                    off = ""
                    if over:
                        continue
                elif name in HOLDERS:
                    inner += -1 if ends else 1
            elif name == off:
                depth += -1 if ends else 1
                if not depth:
                    if off in BLOCK:
                        lines.append(Line("", article > 0, True))
                    off = ""
                    continue
            if off:
                continue
        if name in BLOCK:
            close()
        if not ends and name not in VOID:
            hides = by_tag = name in ASIDE
            if not hides and m.rest and name not in NEVER:
                for key, *values in ATTRIBUTE.findall(m.rest):
                    value = "".join(values)
                    coded = name not in BLOCK and value.lower() == "comment"  # as in marked-up program text
                    hides |= value.lower() in ROLES if key.lower() == "role" else aside_name(value) and not coded
            if hides and not (name == "header" and article and not m.rest.strip()):
                off, depth, begins, inner = name, 1, m.start, 0
                continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if ends else 1))
    if upto < len(page) and not off:
        parts.append(page[upto:])
        total += len(page) - upto
        linked += len(page) - upto if anchor else 0
    close()
    return lines


def main_text(page: str | None, rule: LineBlocks = LineBlocks()) -> str:
    """The article's blocks in page order, two line breaks between them."""
    if not page:
        return ""
    lines, w = lines_of(page, rule), rule.window
    marked = any(x.inside for x in lines)
    kept = []
    for within, run in itertools.groupby(lines, lambda x: x.inside):
        run = list(run)
        size = [0 if x.off else len(x.text) * (rule.weight if within else 1) for x in run]
        sums = [sum(size[i : i + w]) for i in range(len(run))]
        bound = rule.surge if marked and not within else min(rule.surge, rule.peak_share * max(sums))
        inside, upto = False, 0  # what lies before upto is settled
        for i in range(len(run)):
            if inside:
                inside = sums[i] > 0
            elif sums[i] >= bound and size[i]:
                inside, first = True, i
                while first > max(upto, i - w) and size[first - 1]:
                    first -= 1
                kept += [x.text for x in run[first:i]]
            if inside:
                upto = i + 1
                if size[i]:
                    kept.append(run[i].text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, rule: LineBlocks = LineBlocks(), html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """All columns but the html, and the main text under ``out_col``."""
    at = common.place_of(pages.columns, html_col)
    rest = [f for i, f in enumerate(pages.schema) if i != at and f.name.lower() != out_col.lower()]
    source = pages.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{html_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.small_batches(batch):
                texts = [main_text(x, rule) for x in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(texts, pa.string())], names=[*(f.name for f in rest), out_col])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out_col}` string"]))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
