"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass labels each
block from its place in the page, its length, its link density and the share
of stop words of the page's own language: good, bad, or ambiguous (short, mostly
linked within the article, or neither clearly prose nor clearly boilerplate).  In the second pass each
ambiguous block takes the label of the nearest decided block, first of those
in the same article, then of the page; where both sides are equally near and
disagree, the block is bad unless it stands in the article.  Where no block of
the page is good by itself, the ambiguous ones are: those of at least ``SHORT``
characters, or all of more than one letter if there are none.  Where the stop
words of no listed language fit the page, length and link density decide alone.

Forms, and class and id names, mark boilerplate, but a marked element is lifted,
and what it holds is judged like the rest, if it holds the main element or
outweighs what is not marked (see ``_lift``).

Good blocks are joined in page order by one space; white space inside a block
becomes one space and character references are decoded.  Nothing is capped.

Defined results: a null or empty page, or one without a good block, has an
empty text of 0 characters.  Repeated rows give repeated results; columns
beside the named ones are not read, whatever their names.  Unclosed tags end with what contains them; an
unclosed comment, script or style runs to the page's end.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import keep, schema_with

#: Blocks shorter than this are ambiguous; prose of at least LONG characters is good on its own.
SHORT, LONG = 70, 200
#: Share of linked characters above which a block is bad, and shares of stop words.
LINKED, FEW_STOPS, MANY_STOPS = 0.5, 0.10, 0.25

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that for it was on with as are be this by at from or an have not he she they we you which but".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "le la les de des du et un une en est que qui dans pour au aux par sur pas plus ne se ce il elle avec sont son ou".split(),
    "es": "el la los las de del y en un una es que por con para al se no su lo como más o pero sus le ya este fue ha".split(),
}
# Elements that start a block, and elements whose text is never content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("head nav footer aside menu dialog button select noscript template svg math object canvas audio video label fieldset datalist".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
INLINE = frozenset("span b i em strong u small font abbr cite code time mark".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words in class or id names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar sidebars aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs"
    " footer header masthead topbar cookie cookies consent gdpr notice notices alert disclaimer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended teaser"
    " newsletter subscribe subscription signup login popup modal overlay pagination pager paging toolbar copyright legal skip hidden".split()
)
# Those of them that a wrapper of the whole page bears for what stands beside the text.
BESIDE = frozenset("ad ads sidebar sidebars widget widgets nav navbar navigation menu menus header masthead topbar toolbar banner banners share sharing social".split())
# Those of them that are also what a text can be about, so that a longer name tells of its topic.
TOPICS = frozenset("notice notices alert legal copyright disclaimer discussion social related consent".split())
# Words of which a short block beside the article with two different ones asks for consent.
ASKING = frozenset("cookie cookies consent gdpr privacy accept preferences datenschutz zustimmung akzeptieren einwilligung confidentialité consentement accepter privacidad consentimiento aceptar".split())
# First words of names that say what an element has or lacks, not what it is.
HAVING = frozenset("has have with without no".split())
# Words in class or id names that mark the main column.
COLUMN = frozenset("article content main post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b(?=.{0,20}(?:©|\(c\)|\d{4})))", re.I | re.S)
_STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}
GOOD, BAD, AMBIGUOUS = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    #: number of the innermost marked element around it; 0 for none
    mark: int
    #: number of the article (or, failing that, main) element around it; 0 for none
    article: int
    main: int
    heading: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


@dataclass
class Mark:
    """An element that a class or id name calls boilerplate."""

    names: frozenset[str]
    #: number of the marked element around it; 0 for none
    parent: int
    main: bool = False


def _marked(raw: str) -> bool | frozenset[str] | None:
    """Whether a start tag's attributes hide it; the names that mark it; None: the main column."""
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I):
        return True
    parts = [[w.lower() for w in _NAME.findall(x)] for k in ("class", "id") if k in a for x in a[k].split()]
    # "notice-of-award" is about notices; "cookie-notice" and "notice-bar" are some
    topical = lambda x: MARKS.intersection(x) <= TOPICS and len(MARKS.symmetric_difference(x) - MARKS) > 1
    names = frozenset(w for x in parts if x and x[0] not in HAVING and not topical(x) for w in x)
    return names & MARKS or (None if a.get("role", "").lower() == "main" or not names.isdisjoint(COLUMN) else False)


def blocks_of(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's blocks of text in order, each with its place, and its marked elements; the first stands for none."""
    found: list[Block] = []
    marks = [Mark(frozenset(), 0)]
    parts: list[str] = []
    linked, in_link, number, heading = 0, 0, 0, False
    #: open containers: tag, outside and mark, article, main
    stack: list[tuple[str, tuple[bool, int], int, int]] = [("", (False, 0), 0, 0)]

    def close_block() -> None:
        nonlocal linked, heading
        if parts:
            if text := " ".join("".join(parts).split()):
                _, (outside, mark), article, main = stack[-1]
                found.append(Block(text, linked, outside, mark, article, main, heading))
            parts.clear()
        linked, heading = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                linked += len(parts[-1].strip())

    at, search, is_open = 0, _TAG.search, Counter()
    tags_end = max(page.rfind(">") + 1, page.rfind("<!--") + 4)  # nothing behind can be a whole tag
    while m := search(page, at, tags_end):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if ends else 1
            continue
        if tag in RAW and not ends:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        block = tag in BLOCKS
        if block:
            close_block()
        if ends:
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag) if is_open[tag] else 0
            if k:
                if not block and any(stack[j][1] != stack[k - 1][1] for j in range(k, len(stack))):
                    close_block()
                if block:
                    in_link = 0
                is_open.subtract(x[0] for x in stack[k:])
                del stack[k:]
            continue
        if tag in VOID or attributes.endswith("/") and not block:
            continue
        if block and stack[-1][0] == "p" or tag == "body" and stack[-1][0] == "head" or tag == "li" and stack[-1][0] == "li":
            is_open[stack.pop()[0]] -= 1
        _, (outside, mark), article, main = stack[-1]
        marked = _marked(attributes) if attributes and not outside and tag not in ("html", "body") else False
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        column = tag == "main" or marked is None and not main and tag not in INLINE
        hides = outside or marked is True or tag in OUTSIDE or tag == "header" and not article
        within = mark
        names = (marked if isinstance(marked, frozenset) else frozenset()) | ({"form"} if tag == "form" else set())
        if names and not hides:
            marks.append(Mark(frozenset(names), mark))
            within = len(marks) - 1
        if not hides and (tag == "main" or "main" in attributes and _attributes(attributes).get("role", "").lower() == "main"):
            marks[within].main = True
        if tag == "article" and not hides or column:
            number += 1
        place = (hides, within)
        if block or place != (outside, mark) or tag == "span":
            if place != (outside, mark) and not block:
                close_block()
            is_open[tag] += 1
            stack.append((tag, place, number if tag == "article" and not hides and not article else article, number if column and not hides else main))
    add(page[at:])
    close_block()
    return found, marks


def stop_counts(words: list[str]) -> dict[str, int]:
    return {k: sum(w in s for w in words) for k, s in _STOPS.items()}


def _language(blocks: list[Block], words: list[list[str]]) -> frozenset[str] | None:
    """Stop words of the page's language; None if those of none fit its unlinked blocks of at least ``SHORT`` characters."""
    total, prose, number = dict.fromkeys(_STOPS, 0), dict.fromkeys(_STOPS, 0), 0
    for b, w in zip(blocks, words):
        if not b.outside:
            counts = stop_counts(w)
            long = len(b.text) >= SHORT and b.linked <= LINKED * len(b.text)
            number += len(w) * long
            for k, n in counts.items():
                total[k] += n
                prose[k] += n * long
    best = max(total, key=lambda k: total[k])
    return None if number and max(prose.values()) < MANY_STOPS * number else _STOPS[best]


def _lift(blocks: list[Block], marks: list[Mark], words: list[list[str]]) -> None:
    """Blocks under marks that hold become outside; elements with equal names are lifted together.

    A mark that holds the main element is lifted.  Of the others the heaviest
    is, with those around it: one of names in ``BESIDE`` if it outweighs the
    unmarked text, or half of it where no article but its own is to be seen;
    one of other names only if no unmarked text is dense, and if there is none
    at all or it holds an article that outweighs it.  Weight is the length of
    unlinked blocks that are in an article or main column or dense.
    """
    if len(marks) == 1:
        return
    stops = _language(blocks, words)
    own, loose = [0] * len(marks), 0
    framed = [False] * len(marks)
    for b, w in zip(blocks, words):
        size = len(b.text)
        if b.outside or b.linked > LINKED * size:
            continue
        loose += size if not b.mark else 0
        framed[b.mark] |= b.article > 0
        dense = size >= SHORT and (stops is None or sum(x in stops for x in w) >= FEW_STOPS * len(w))
        own[b.mark] += size if dense or b.article or b.main else 0
    lifted = [not k or m.main for k, m in enumerate(marks)]
    for k in range(len(marks) - 1, 0, -1):
        lifted[marks[k].parent] |= lifted[k]
    if not any(lifted[1:]):
        weight: dict[frozenset[str], int] = Counter()
        article: set[frozenset[str]] = set()
        for k, m in enumerate(marks[1:], 1):
            weight[m.names] += own[k]
            if framed[k]:
                article.add(m.names)

        def may(names: frozenset[str]) -> bool:
            w = weight[names]
            if names <= BESIDE:
                return w > own[0] or names in article and not framed[0] and 2 * w > own[0]
            return not own[0] and w > 0 and (not loose or names in article and w > loose)

        best = max((n for n in weight if may(n)), key=lambda n: (weight[n], sorted(n)), default=None)
        for k in range(len(marks) - 1, 0, -1):
            lifted[k] |= marks[k].names == best and own[k] > 0
            lifted[marks[k].parent] |= lifted[k]
    shown = [True] * len(marks)
    for k, m in enumerate(marks[1:], 1):
        shown[k] = lifted[k] and shown[m.parent]
    for b in blocks:
        b.outside |= not shown[b.mark]


def label(blocks: list[Block], marks: list[Mark]) -> list[bool]:
    """Both passes: whether each block is main text."""
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    _lift(blocks, marks, words)
    stops = _language(blocks, words)
    place = [0 if b.outside else b.article for b in blocks]
    if not any(place):
        place = [0 if b.outside else b.main for b in blocks]
    framed = any(place)

    first = []
    for b, w, p in zip(blocks, words, place):
        size = len(b.text)
        density = FEW_STOPS if stops is None else sum(x in stops for x in w) / len(w) if w else 0.0
        if b.outside or framed and not p or b.linked > LINKED * size and not p:
            first.append(BAD)
        elif size < LONG and (_RIGHTS.match(b.text) or not p and b.text[:9].lower() == "copyright"):
            first.append(BAD)
        elif not p and size < 2 * LONG and len(ASKING.intersection(w)) > 1:
            first.append(BAD)
        elif b.linked > LINKED * size:  # in the article: a linked title, a reference, a paragraph with a long link
            first.append(AMBIGUOUS)
        elif size < SHORT:
            first.append(AMBIGUOUS)
        elif density >= MANY_STOPS and size >= LONG:
            first.append(GOOD)
        elif density >= FEW_STOPS or p:
            first.append(AMBIGUOUS if size < LONG else GOOD)
        else:
            first.append(BAD)

    if GOOD not in first:
        unsure = [i for i, x in enumerate(first) if x == AMBIGUOUS]
        for i in [i for i in unsure if len(blocks[i].text) >= SHORT] or [i for i in unsure if place[i] or sum(map(len, words[i])) > 1]:
            first[i] = GOOD

    def decided(order: range) -> list[int | None]:
        """For each block the last decided one before it in this order, in the same article or else on the page."""
        out: list[int | None] = [None] * len(blocks)
        last: dict[int, int] = {}
        for i in order:
            out[i] = last.get(place[i])
            if first[i] != AMBIGUOUS and not blocks[i].outside:
                last[place[i]] = i
        return out

    before, after = decided(range(len(blocks))), decided(range(len(blocks) - 1, -1, -1))
    out = []
    for i, (b, x) in enumerate(zip(blocks, first)):
        if x == AMBIGUOUS:
            near = [j for j in (before[i], after[i]) if j is not None]
            if b.heading and after[i] is not None:  # a heading belongs to what follows
                near = [after[i]]
            least = min((abs(j - i) for j in near), default=0)
            labels = {first[j] for j in near if abs(j - i) == least}
            if place[i]:
                x = labels.pop() if len(labels) == 1 else GOOD
            elif labels:
                x = labels.pop() if len(labels) == 1 else BAD
            else:
                x = GOOD if len(b.text) >= SHORT else BAD
        out.append(x == GOOD)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, marks = blocks_of(page)
    return " ".join(b.text for b, good in zip(blocks, label(blocks, marks)) if good)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` of every page; one pass without a shuffle."""
    out = keep(pages, *carry, html_col)
    schema = schema_with(out, list(carry), "text string, n_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(html_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*carry, "text", "n_chars"])

    return out.mapInArrow(run, schema)
